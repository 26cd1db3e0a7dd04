"""Raw pages into tables: legal text pages in three layouts, and listing pages.

Python only turns markup into flat elements: one row per tag with its place, parent, class and
text. Everything after that, from the layout to articles, paragraphs and structure, is Spark work
on those rows. Text pieces are joined with one blank. A page that cannot be read fails the job and is
named; only where it is asked for are such pages left out, which ``broken_pages`` then reports.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import slashed_to_iso
from palimpsest.functions.text import group, strip_space
from palimpsest.operators.core import first_seen
from palimpsest.session import Parts, packed, written
from palimpsest.sources.structured import clauses, footnotes, parse_structured, within

ELEMENTS = "seq int, parent int, last int, tag string, id string, cls string, href string, path array<int>, text string"
# tags that never hold others
VOID = ("br", "hr", "img", "meta", "link", "input", "col", "wbr")
# tags whose text is read; blocks above them would only repeat it, so of blocks only a few kinds are
TEXT_TAGS = ("p", "td", "th", "span", "a")
TEXT_BLOCKS = ("inline-element", "norm", "grid-list-column-1", "grid-list-column-2")


def _reads(tag: str, ident: str, cls: str) -> bool:
    return tag in TEXT_TAGS or tag == "div" and (ident.startswith("cit_") or not set(TEXT_BLOCKS).isdisjoint(cls.split()))


# tags written in the plainest way, which most are; all others are left to the parser
PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z]+="[^"<>&]*")*)>')
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
# one piece of a page in which every tag is plain: a start (closed by itself or not), an end, a text, or what is never read
PLAIN_PIECE = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z]+="[^"<>&]*")*)(/?)>|</([a-z][a-z0-9]*)>|([^<]+)')
UNREAD = re.compile(r"[^<]*</(script|style)>")
ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')
# tags after which the parser reads text in another way
RAW_TAGS = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class _Flat(HTMLParser):
    """Open and close events to rows [seq, parent, last, tag, id, class, href, path, pieces]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        # of the open elements: places, tags, and the pieces of those whose text is read
        self.open: list[int] = []
        self.tags: list[str] = []
        self.into: list[list | None] = []
        self.skip = 0

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if not plain or plain[1] in RAW_TAGS:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], ATTRIBUTE.findall(plain[2]))
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "p" and self.tags and self.tags[-1] == "p":
            self.handle_endtag("p")  # an open paragraph ends where the next one starts
        a = dict(attrs)
        seq = len(self.rows)
        row = [seq, self.open[-1] if self.open else -1, seq, tag, a.get("id") or "", a.get("class") or "", a.get("href") or "", self.open.copy(), []]
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(seq)
            self.tags.append(tag)
            self.into.append(row[8] if _reads(tag, row[4], row[5]) else None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag not in self.tags:
            return
        last = len(self.rows) - 1
        while self.open:
            self.rows[self.open.pop()][2] = last
            self.into.pop()
            if self.tags.pop() == tag:
                return

    def handle_data(self, data):
        piece = " ".join(data.split())
        if piece and not self.skip:
            for pieces in self.into:
                if pieces is not None:
                    pieces.append(piece)

    def finish(self) -> list[list]:
        for seq in self.open:
            self.rows[seq][2] = len(self.rows) - 1
        return self.rows


@lru_cache(4096)
def _start(tag: str, attributes: str) -> tuple[str, str, str, bool]:
    """Id, class and link of a plain start tag, and whether the text in it is read."""
    a = dict(ATTRIBUTE.findall(attributes))
    ident, cls = a.get("id", ""), a.get("class", "")
    return ident, cls, a.get("href", ""), _reads(tag, ident, cls)


def _plain(html: str) -> list[list] | None:
    """The rows of a page in which every tag is plain, as the parser gives them; else none."""
    rows: list[list] = []
    # of the open elements: places, tags, and the pieces of those whose text is read
    places: list[int] = []
    tags: list[str] = []
    into: list[list | None] = []

    def end(tag: str) -> None:
        if tag in tags:
            last = len(rows) - 1
            while True:
                rows[places.pop()][2] = last
                into.pop()
                if tags.pop() == tag:
                    return

    at, size, piece = 0, len(html), PLAIN_PIECE.match
    while at < size:
        found = piece(html, at)
        if not found:
            return None
        at = found.end()
        tag, attributes, closed, ended, text = found.groups()
        if text is not None:
            said = " ".join((unescape(text) if "&" in text else text).split())
            if said:
                for pieces in into:
                    if pieces is not None:
                        pieces.append(said)
        elif ended is not None:
            if tags and tags[-1] == ended:
                tags.pop()
                into.pop()
                rows[places.pop()][2] = len(rows) - 1
            else:
                end(ended)
        else:
            if tag in RAW_TAGS:
                unread = None if closed else UNREAD.match(html, at)
                if not unread or unread[1] != tag:
                    return None
                at, closed = unread.end(), True
            if tag == "p" and tags and tags[-1] == "p":
                end("p")  # an open paragraph ends where the next one starts
            ident, cls, href, reads = _start(tag, attributes)
            seq, pieces = len(rows), []
            rows.append([seq, places[-1] if places else -1, seq, tag, ident, cls, href, places.copy(), pieces])
            if not closed and tag not in VOID:
                places.append(seq)
                tags.append(tag)
                into.append(pieces if reads else None)
    for seq in places:
        rows[seq][2] = len(rows) - 1
    return rows


class UnreadablePage(ValueError):
    """The parser refuses a page's markup."""


def _flatten(html: str) -> list[list]:
    rows = _plain(html)
    return _parsed(html) if rows is None else _joined(rows)


def _parsed(html: str) -> list[list]:
    parser = _Flat()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError as refused:  # how the standard library's parser says so
        raise UnreadablePage(str(refused)) from refused
    return _joined(parser.finish())


def _joined(rows: list[list]) -> list[list]:
    for r in rows:
        r[8] = " ".join(r[8])
    return rows


def page_elements(pages: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """(page_id, seq, parent, last, tag, id, cls, href, path, text) for pages (page_id, html); ``path`` lists
    the places of the elements around one. Page ids are kept as they are, numbers or texts. A page without
    ``html`` has no elements. One that cannot be read fails the job, so that its parts are not missing from
    a result unseen; with ``skip_unreadable`` it has no elements either, for use with ``broken_pages``."""

    kind = pages.schema["page_id"].dataType.simpleString()
    names = [field.split()[0] for field in ELEMENTS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.string()] * 4 + [pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, html = batch.column("page_id"), batch.column("html")
            of, columns, ends, places = [], [[] for _ in kinds[:-2]], [0], []
            texts: list[str] = []

            def made() -> pa.RecordBatch:
                arrays = [*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())), pa.array(texts, pa.string())]
                return pa.record_batch([ids.take(pa.array(of, pa.int64())), *arrays], names=["page_id", *names])

            for at in range(batch.num_rows):
                try:
                    found = _flatten(html[at].as_py() or "")
                except UnreadablePage as why:
                    if not skip_unreadable:
                        raise UnreadablePage(f"page {ids[at].as_py()!r} cannot be read: {why}") from why
                    continue
                if not found:
                    continue
                # columns at once: rows kept as lists would be walked again and again by the collector
                of.extend([at] * len(found))
                *most, paths, said = zip(*found)
                for column, values in zip(columns, most):
                    column.extend(values)
                for path in paths:
                    places.extend(path)
                    ends.append(len(places))
                texts.extend(said)
                if len(of) >= 20_000:
                    yield made()
                    of, columns, ends, places, texts = [], [[] for _ in kinds[:-2]], [0], [], []
            if of:
                yield made()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {ELEMENTS}")


def broken_pages(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages without a single element, with a ``parse_error`` flag."""
    return pages.select("page_id").join(elements.select("page_id").distinct(), "page_id", "left_anti").withColumn("parse_error", F.lit(True))


def has_class(name: str, col: str = "cls") -> Column:
    return F.array_contains(F.split(F.col(col), r"\s+"), name)


# Classes of the parts in each layout, and the forms of headings and labels.
LAYOUTS = {
    "legacy": {"article": "ti-art", "subtitle": "sti-art", "text": "normal", "division": "ti-section-1", "division_title": "ti-section-2", "title": "doc-ti"},
    "flat": {"article": "title-article-norm", "subtitle": "stitle-article-norm", "text": "norm", "division": "title-division-1", "division_title": "title-division-2", "title": "title-doc-first"},
}
ARTICLE_HEAD = r"(?i)^(?:Article|Articolul|Artikel|Articolo|Artículo)\s+(\d+[a-z]*)"
DIVISIONS = (
    ("title", r"(?i)^(?:TITLUL|TITLE|TITRE)\s+([IVXLCDM]+)"),
    ("chapter", r"(?i)^(?:CAPITOLUL|CHAPTER|CHAPITRE)\s+(\d+|[IVXLCDM]+)"),
    ("section", r"(?i)^(?:Secțiunea|Section|Sektion)\s+(\d+)"),
)
PARAGRAPH_LABEL = r"^\((\d+[a-z]*)\)"
CLAUSE_LABEL = r"^(\([a-z]+\))"
LIST_PARTS = ("inline-element", "grid-container", "grid-list-column-1", "grid-list-column-2", "list")
ANNEX_HEAD = r"(?i)^ANEX[AĂE]\s+[IVXLCDM\d]+"


def page_layout(elements: DataFrame) -> DataFrame:
    """(page_id, layout): structured where the container is there, else legacy, else flat."""
    return _layouts(elements).where("layout IS NOT NULL")


def _layouts(elements: DataFrame) -> DataFrame:
    """The same with the pages of no layout."""
    seen = elements.groupBy("page_id").agg(
        F.bool_or((F.col("tag") == "div") & has_class("eli-container")).alias("s"),
        F.bool_or((F.col("tag") == "p") & has_class("ti-art")).alias("l"),
        F.bool_or((F.col("tag") == "p") & has_class("title-article-norm")).alias("f"),
    )
    return seen.select("page_id", F.when(F.col("s"), "structured").when(F.col("l"), "legacy").when(F.col("f"), "flat").alias("layout"))


def _marks(elements: DataFrame, layouts: DataFrame) -> DataFrame:
    """Paragraph-like elements with the part they play in their page's layout."""
    role = None  # of pages whose lines follow one another; others name their parts by blocks
    for layout, classes in LAYOUTS.items():
        for part, cls in classes.items():
            fits = (F.col("layout") == layout) & has_class(cls)
            role = F.when(fits, part) if role is None else role.when(fits, part)
    p = elements.where("tag = 'p'").join(layouts, "page_id")
    # notices of amendments stand between the lines and are none
    notice = (F.col("layout") == "flat") & (has_class("modref") | has_class("arrow"))
    return p.withColumn("part", role).where("part IS NOT NULL").where(~notice)


def _flat_blocks(elements: DataFrame, layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the flat layout that are a line or a clause as a whole, and the clauses inside them.

    Blocks (page_id, seq, parent, kind, label, text): ``line`` for a text block with a text of its own,
    ``clause`` for a grid outside of text blocks and for a block without class beside the headings that
    holds a line, ``none`` for blocks that say nothing. What stands inside a block is read with it.
    Clauses (page_id, block, seq, label, text) are the grids inside text blocks, at any depth.
    """
    flat = layouts.where("layout = 'flat'").select("page_id")
    if flat.isEmpty():
        none = lambda *columns: elements.sparkSession.createDataFrame([], f"page_id {elements.schema['page_id'].dataType.simpleString()}, {', '.join(columns)}")
        return none("seq int", "parent int", "kind string", "label string", "text string"), none("block int", "seq int", "label string", "text string")
    e = elements if layouts.where("layout <> 'flat'").isEmpty() else elements.join(flat, "page_id", "left_semi")
    heads = e.where("tag = 'p'").where(has_class("title-article-norm"))
    beside = heads.select("page_id", "parent").distinct().withColumn("_beside", F.lit(True))
    around = heads.select("page_id", F.explode("path").alias("seq")).distinct()
    part_of_list = F.lit(False)
    for name in LIST_PARTS:
        part_of_list = part_of_list | has_class(name)
    form = F.when(has_class("grid-container") & has_class("grid-list"), "grid").when(has_class("norm") & ~part_of_list, "block").when(F.trim("cls") == "", "bare")
    found = e.where("tag = 'div'").withColumn("form", form).where("form IS NOT NULL").join(around, ["page_id", "seq"], "left_anti").join(beside, ["page_id", "parent"], "left")
    found = found.where("form <> 'bare' OR _beside").select("page_id", "seq", "parent", "path", "form")
    at = found.select("page_id", F.col("seq").alias("at"))
    inner = within(found.select("page_id", "seq", "path"), at).select("page_id", "seq").distinct()
    outer = written(found.join(inner, ["page_id", "seq"], "left_anti").select("page_id", "seq", "parent", "form"), "blocks")
    of = lambda form: outer.where(F.col("form") == form).select("page_id", F.col("seq").alias("at"))

    # a text block says its direct lines, or else those of the boxes in it
    said = e.where("tag IN ('p', 'span') AND text <> ''").where((F.col("tag") == "span") | ~(has_class("title-article-norm") | has_class("stitle-article-norm")))
    said = said.select("page_id", "seq", "tag", "text", F.col("parent").alias("at"))
    boxes = e.where("tag = 'div'").where(has_class("inline-element")).select("page_id", F.col("seq").alias("at"), F.col("parent").alias("_block"))
    boxes = boxes.join(of("block").withColumnRenamed("at", "_block"), ["page_id", "_block"])
    direct = said.join(of("block"), ["page_id", "at"]).select("page_id", "at", F.lit(0).alias("k"), "seq", "text")
    boxed = said.where("tag = 'p'").join(boxes, ["page_id", "at"]).select("page_id", F.col("_block").alias("at"), F.lit(1).alias("k"), "seq", "text")
    lines = direct.unionByName(boxed).groupBy("page_id", "at").agg(F.sort_array(F.collect_list(F.struct("k", "seq", "text"))).alias("l"))
    own = F.filter("l", lambda x: x["k"] == F.col("l")[0]["k"])
    lines = lines.select("page_id", "at", F.lit(None).cast("string").alias("label"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"))

    columns = e.where("tag = 'div'").withColumn("_n", F.when(has_class("grid-list-column-1"), 1).when(has_class("grid-list-column-2"), 2)).where("_n IS NOT NULL")
    columns = within(columns.select("page_id", "seq", "_n", "text", "path"), of("grid"))
    column = lambda n: F.min_by(F.when(F.col("_n") == n, F.col("text")), F.when(F.col("_n") == n, F.col("seq")))
    grids = columns.groupBy("page_id", "at").agg(column(1).alias("label"), column(2).alias("_text")).where("label IS NOT NULL AND _text IS NOT NULL")
    grids = grids.select("page_id", "at", "label", F.concat_ws(" ", "label", "_text").alias("text"))
    bare = within(e.where("tag = 'p'").where(has_class("norm")).select("page_id", "seq", "text", "path"), of("bare")).groupBy("page_id", "at").agg(F.min_by("text", "seq").alias("text"))
    bare = bare.select("page_id", "at", F.coalesce(group(F.col("text"), CLAUSE_LABEL, 1), F.lit("")).alias("label"), "text")
    texts = lines.unionByName(grids).unionByName(bare).withColumnRenamed("at", "seq").where("text <> ''")
    # a block without class and without a line is nothing at all
    kept = outer.join(texts, ["page_id", "seq"], "left").where("form <> 'bare' OR text IS NOT NULL")
    kind = F.when(F.col("text").isNull(), "none").when(F.col("form") == "block", "line").otherwise("clause")
    blocks = written(kept.select("page_id", "seq", "parent", kind.alias("kind"), "label", "text"), "blocks")
    owners = blocks.where("kind = 'line'").select("page_id", F.col("seq").alias("paragraph_at"), F.lit(None).cast("int").alias("article_at"), F.lit(1).alias("mode"))
    return blocks, clauses(e, owners).select("page_id", F.col("paragraph_at").alias("block"), "seq", "label", "text")


def parse_pages(elements: DataFrame) -> dict[str, DataFrame]:
    """Titles, structure, articles, paragraphs, sub-clauses, preamble, annexes and footnotes of the
    pages behind ``elements``, whatever their layout."""
    # parsed once: every part below reads the elements again
    elements = packed(elements)
    layouts = written(_layouts(elements), "layouts")
    blocks = F.col("layout") == "structured"
    there = {r["blocks"] for r in layouts.where("page_id IS NOT NULL").select(blocks.alias("blocks")).distinct().collect()}
    # where all pages are of one kind, the elements stay as they are
    alone = len(there) == 1 and layouts.where("page_id IS NULL").isEmpty()
    of = lambda which: elements if alone else written(elements.join(layouts.where(blocks == which).select("page_id"), "page_id", "left_semi"), "lines")
    named = [parse(of(which), layouts.where(blocks == which)) for which, parse in ((True, lambda e, _: parse_structured(e)), (False, _parse_lines)) if which in there]
    named = named or [_parse_lines(elements.limit(0), layouts.limit(0))]
    return Parts({part: lambda part=part: reduce(DataFrame.unionByName, [tables[part] for tables in named]) for part in named[0]})


def _parse_lines(elements: DataFrame, layouts: DataFrame) -> dict[str, DataFrame]:
    """The layouts whose lines follow one another. A page is one input row, so its parts fit one window.

    Each line belongs to the last article heading before it, each article to the last division
    heading before it, each unlabelled line to the labelled paragraph before it.
    """
    blocks, nested = _flat_blocks(elements, layouts)
    marks = _marks(elements, layouts).select("page_id", "seq", "parent", "path", "part", "text")
    held = within(marks.where("part = 'text'").select("page_id", "seq", "path"), blocks.select("page_id", F.col("seq").alias("at"))).select("page_id", "seq").distinct()
    marks = marks.join(held, ["page_id", "seq"], "left_anti").drop("path")
    as_mark = F.when(F.col("kind") == "line", "text").otherwise("clause").alias("part")
    marks = marks.unionByName(blocks.where("kind <> 'none'").select("page_id", "seq", "parent", as_mark, "text"))
    before = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("part") == "article", group(F.col("text"), ARTICLE_HEAD, 1))
    # a page ends its articles at its first annex heading or the line drawn before it
    stop = elements.where(((F.col("tag") == "p") & has_class("title-annex-1")) | ((F.col("tag") == "hr") & has_class("separator-annex"))).groupBy("page_id").agg(F.min("seq").alias("_stop"))
    body = marks.join(stop, "page_id", "left").where("_stop IS NULL OR seq < _stop").drop("_stop")
    body = body.withColumn("article", F.last(F.when(F.col("part").isin("article", "division"), F.struct(F.when(number.isNotNull(), F.col("seq")).alias("at"), number.alias("number"))), ignorenulls=True).over(before))
    body = body.withColumn("division_at", F.last(F.when(F.col("part") == "division", F.col("seq")), ignorenulls=True).over(before))
    titles = marks.where("part = 'title'").groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("title"))

    kind = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for level, form in DIVISIONS:
        kind = F.coalesce(kind, F.when(F.col("text").rlike(form), level))
        name = F.coalesce(name, group(F.col("text"), form, 1))
    heads = body.where("part = 'division'").select("page_id", F.col("seq").alias("division_at"), kind.alias("level"), name.alias("number"))
    names = body.where("part = 'division_title'").groupBy("page_id", "division_at").agg(F.min_by("text", "seq").alias("title"))
    chain = Window.partitionBy("page_id").orderBy("division_at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda level: F.last(F.when(F.col("level") == level, F.col("division_at")), ignorenulls=True).over(chain)
    structure = heads.where("level IS NOT NULL").withColumn("_t", last("title")).withColumn("_c", last("chapter"))
    # a chapter closes with its title; a section hangs on the chapter that is still open
    open_chapter = F.when(F.coalesce(F.col("_c") > F.col("_t"), F.col("_t").isNull()), F.col("_c"))
    parent = F.when(F.col("level") == "chapter", F.col("_t")).when(F.col("level") == "section", open_chapter)
    structure = structure.withColumn("parent_at", parent).drop("_t", "_c").join(names, ["page_id", "division_at"], "left")

    inside = body.where("article.at IS NOT NULL").select("page_id", "seq", "parent", "part", "text", "division_at", F.col("article.at").alias("article_at"), F.col("article.number").alias("number"))
    sub = inside.where("part = 'subtitle'").groupBy("page_id", "article_at").agg(F.min_by("text", "seq").alias("article_title"))
    # lines inside table cells are sub-clauses, read from the cells below
    cells = elements.where("tag = 'td'").select("page_id", F.col("seq").alias("cell"), F.col("last").alias("cell_last"), F.col("parent").alias("row"), "text")
    # only paragraphs and blocks are lines, and only cells are looked for in recitals
    at_cell = cells.select("page_id", F.col("cell").alias("at"))
    in_cell = within(elements.where("tag IN ('p', 'div')").select("page_id", "seq", "path"), at_cell).select("page_id", "seq").distinct()
    lines = inside.where("part IN ('text', 'clause')").join(in_cell, ["page_id", "seq"], "left_anti")
    label = F.when(F.col("part") == "text", group(F.col("text"), PARAGRAPH_LABEL, 1))
    in_article = Window.partitionBy("page_id", "article_at").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("paragraph_at", F.coalesce(F.last(F.when(label.isNotNull(), F.col("seq")), ignorenulls=True).over(in_article), F.col("article_at")))
    placed, lines = lines, lines.where("part = 'text'")
    # clauses before any line make a paragraph without text
    paragraphs = placed.groupBy("page_id", "article_at", "paragraph_at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == "text", F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("text")
    )
    paragraphs = paragraphs.withColumn("label", F.coalesce(F.concat(F.lit("("), group(F.col("text"), PARAGRAPH_LABEL, 1), F.lit(")")), F.lit("")))
    # first two cells of a row: label and text; the row belongs to the paragraph it follows
    nth = F.row_number().over(Window.partitionBy("page_id", "row").orderBy("cell"))
    pair = cells.withColumn("_n", nth).where("_n <= 2").groupBy("page_id", "row").agg(F.max(F.when(F.col("_n") == 1, F.col("text"))).alias("label"), F.max(F.when(F.col("_n") == 2, F.col("text"))).alias("text"), F.count(F.lit(1)).alias("_c"))
    spots = lines.select("page_id", F.col("seq").alias("at"), "article_at", "paragraph_at").unionByName(pair.where("_c = 2").select("page_id", F.col("row").alias("at"), F.lit(None).cast("int").alias("article_at"), F.lit(None).cast("int").alias("paragraph_at")))
    around = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("paragraph_at").isNotNull(), F.struct("article_at", "paragraph_at")), ignorenulls=True).over(around)
    rows = spots.withColumn("_o", owner).where("paragraph_at IS NULL AND _o IS NOT NULL").select("page_id", F.col("at").alias("row"), F.col("_o.article_at").alias("article_at"), F.col("_o.paragraph_at").alias("paragraph_at"))
    subclauses = pair.drop("_c").join(rows, ["page_id", "row"]).select("page_id", "article_at", "paragraph_at", F.col("row").alias("seq"), "label", F.concat_ws(" ", "label", "text").alias("text"))
    owners = placed.select("page_id", F.col("seq").alias("block"), "article_at", "paragraph_at")
    alone = blocks.where("kind = 'clause'").select("page_id", F.col("seq").alias("block"), "seq", "label", "text")
    subclauses = subclauses.unionByName(alone.unionByName(nested).join(owners, ["page_id", "block"]).drop("block"))

    first = inside.where("part = 'article'").select("page_id", "article_at", "number", "division_at")
    # a repeated number: the last article of that number is the effective one
    newest = first.groupBy("page_id", "number").agg(F.max("article_at").alias("_last"))
    parts = paragraphs.where("text <> ''").select("page_id", "article_at", F.col("paragraph_at").alias("at"), "text").unionByName(subclauses.select("page_id", "article_at", F.col("seq").alias("at"), "text"))
    texts = parts.groupBy("page_id", "article_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("_body"))
    articles = first.join(sub, ["page_id", "article_at"], "left").join(texts, ["page_id", "article_at"], "left").join(newest, ["page_id", "number"])
    articles = articles.select(
        "page_id", "article_at", "number", "division_at", F.coalesce("article_title", F.lit("")).alias("article_title"), (F.col("article_at") == F.col("_last")).alias("effective"),
        F.concat_ws("\n", F.concat(F.lit("Articolul "), F.col("number")), F.nullif("article_title", F.lit("")), "_body").alias("full_text"),
    )

    div = elements.where("tag = 'div'")
    recital_blocks = div.where(F.col("id").rlike(r"^rct_\d+")).select("page_id", F.col("seq").alias("rct"), "id")
    recital_cells = within(elements.where("tag = 'td'").select("page_id", F.col("seq").alias("cell"), "text", "path"), recital_blocks.withColumnRenamed("rct", "at")).withColumnRenamed("at", "rct")
    order = Window.partitionBy("page_id", "rct").orderBy("cell")
    recitals = recital_cells.withColumn("_n", F.row_number().over(order)).groupBy("page_id", "rct", "id").agg(F.max(F.when(F.col("_n") == 1, F.col("text"))).alias("_l"), F.max(F.when(F.col("_n") == 2, F.col("text"))).alias("text"))
    recitals = recitals.select("page_id", F.col("rct").alias("seq"), F.lit("recital").alias("kind"), F.coalesce(group(F.col("_l"), r"^\(?(\d+)\)?", 1), F.regexp_replace("id", "^rct_", "")).alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    citations = div.where(F.col("id").rlike(r"^cit_\d+")).select("page_id", "seq", F.lit("citation").alias("kind"), F.col("id").alias("number"), "text")
    return {
        "titles": titles, "structure": structure, "articles": articles, "paragraphs": paragraphs, "subclauses": subclauses,
        "preamble": citations.unionByName(recitals), "annexes": page_annexes(elements), "footnotes": footnotes(elements),
    }


def page_annexes(elements: DataFrame) -> DataFrame:
    """Annexes: lines from one annex heading to the next."""
    p = elements.where("tag = 'p' AND text <> ''").withColumn("_head", has_class("title-annex-1") & F.col("text").rlike(ANNEX_HEAD))
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("annex_at", F.last(F.when(F.col("_head"), F.col("seq")), ignorenulls=True).over(w)).where("annex_at IS NOT NULL")
    second = has_class("title-annex-2")
    rest = F.when(~F.col("_head") & ~second, F.struct("seq", "text"))
    out = p.groupBy("page_id", "annex_at").agg(
        F.min_by("text", "seq").alias("_t"), F.min_by(F.when(second, F.col("text")), F.when(second, F.col("seq"))).alias("_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(rest)), lambda x: x["text"]), "\n").alias("text"),
    )
    title = F.concat_ws(" — ", "_t", "_s")
    return out.select("page_id", "annex_at", F.regexp_replace(F.lower("_t"), "[^A-Za-z0-9]", "_").alias("annex_id"), title.alias("title"), "text")


# The numbered link of a result and the markers around the issuer.
RESULT_LINK = r"/Public/DetaliiDocument/(\d+)"
RESULT_HEAD = r"^\d+\.\s+(\S+)\s+(\S+)\s+(\S+)"


def parse_listings(elements: DataFrame) -> DataFrame:
    """Results of listing pages: numbered links with the description and issuer that follow them;
    the first of each id per page stays."""
    # the paragraph after the one that holds the link, found by one walk back over the page
    back = Window.partitionBy("page_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = elements.where("tag IN ('p', 'a')").withColumn("p_text", F.last(F.when(F.col("tag") == "p", F.col("text")), ignorenulls=True).over(back))
    links = rows.where("tag = 'a'").where(F.col("href").rlike(RESULT_LINK)).where(F.col("text").rlike(r"^\d+\.\s+\S+\s+"))
    hit = links.select("page_id", "seq", "parent", F.regexp_extract("href", RESULT_LINK, 1).alias("ver_id"), "text", "p_text")
    out = first_seen(hit, ["page_id", "ver_id"], ["seq"])
    head = lambda i: F.regexp_extract("text", RESULT_HEAD, i)
    raw = F.coalesce("p_text", F.lit(""))
    cut = F.instr(raw, "EMITENT:")
    description = F.when(cut > 1, F.substring(raw, F.lit(1), cut - 1)).otherwise(raw)
    return out.select(
        "page_id", "seq", "ver_id", F.when((head(1) != "") & (head(2) != ""), F.concat(head(1), F.lit(" nr. "), head(2))).otherwise(F.col("text")).alias("title"),
        strip_space(F.regexp_replace(F.regexp_replace(description, r"\s+", " "), "^﻿+", "")).alias("description"), head(1).alias("doc_type"), head(2).alias("number"), head(3).alias("date"),
        strip_space(F.regexp_extract(raw, r"EMITENT:\s*(.+?)(?:\s*PUBLICAT\s|$)", 1)).alias("issuer"), slashed_to_iso(F.nullif(head(3), F.lit(""))).alias("date_iso"),
    )
