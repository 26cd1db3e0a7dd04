"""Main text of web pages by composite text density.

A page becomes a tree (unclosed and misnested tags as browsers take them, in the main). Each node gets
its link-adjusted characters per tag: characters over tags, weighed by the logarithm of how its text
and tags divide into links and others, to a base that depends on the page. A node's sum is that of its
children's densities. The node with the largest sum is the core; from it the choice widens to a parent
while the parent's density stays above the threshold, which is a share of the least density on the
path from the body to the core, or while it stays in the same ``article`` or ``main``.

What is no article is left out before densities are taken and when the text is read: menus, headers
(their headings stay inside an article), footers, sidebars, scripts, styles, media, hidden parts, and by
role, class or id also cookie notices, adverts and reader comments, whatever their length. A part named
so stays only if no paragraphs are left outside it. Words that articles use as well (related, share,
notice) say so of parts that are mostly links, have no paragraphs or lie outside the chosen node.
A form's controls and labels go; the form goes too unless it holds paragraphs: enough of them for the
fields it has, or all that the page has.

Character references are decoded; white space inside a block becomes one space; blocks are joined by
one space. A null or empty page has an empty text. Pages are read whole, whatever their length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

#: Fixed values of HTML: elements without content, with raw content, that end a paragraph, in running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre section summary table ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("td", "th", "tr", "tbody")}
SCOPES = frozenset("ul ol dl table td th select html body article main section div".split())

#: Elements, roles and words of classes and ids of what is no article.
APART = frozenset("nav aside footer button select textarea script style noscript template iframe svg canvas object video audio map menu dialog head title input datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo sidebar sidenav aside menu submenu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter"
    " pagination pager".split()
)
#: Words that say so only together with links, or outside the article.
GENERIC = frozenset(
    "notice notices notification alert promotion subscribe subscription signup login share sharing social related recommended recommendations"
    " widget widgets skip copyright disclaimer".split()
)
#: Beginnings of class names that speak of the page or its subject.
ABOUT = ("has", "with", "no", "without", "category", "tag")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Characters of running text, links apart, that make a block a paragraph.
PARAGRAPH = 50
#: Elements that are no article unless they hold paragraphs, and controls that are filled in.
FORMS = frozenset(("form", "label"))
NO_FIELDS = frozenset("hidden submit button image reset".split())
#: Characters of paragraphs that make a form a part of the article, and more for each of its fields.
FORM_TEXT = 100
#: Share of the least density on the body's path that a wider choice must keep.
WIDEN = 0.5

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[a-z]+")
#: Kinds of parts by class or id.
PART, COMMENT, MAYBE = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "apart", "kind", "children", "chars", "links", "tags", "link_tags", "density", "total", "running", "prose", "lines", "fields", "field")

    def __init__(self, tag: str, parent: Node | None, apart: bool = False, kind: int = 0) -> None:
        self.tag, self.parent, self.apart, self.kind = tag, parent, apart, kind
        self.field = 0
        self.children: list[Node | str] = []
        if parent is not None:
            parent.children.append(self)


def _kind(names: str) -> int:
    """What class names or an id say of a part."""
    words = {w for name in names.lower().split() if (of := _WORD.findall(name)) and (len(of) == 1 or of[0] not in ABOUT) for w in of}
    if not COMMENTS.isdisjoint(words):
        return COMMENT
    return PART if not WORDS.isdisjoint(words) else MAYBE if not GENERIC.isdisjoint(words) else 0


def _says_apart(tag: str, raw: str) -> tuple[bool, int]:
    """Whether an element is no article for sure, and what its class or id says."""
    if tag in APART or tag == "header":
        return True, 0
    if not raw or "=" not in raw and "hidden" not in raw:
        return False, 0
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        found.setdefault((name or bare).lower(), entities.unescape(a or b or c))
    style = found.get("style", "").lower().replace(" ", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, 0
    if tag in ("html", "body", "main", "article"):
        return False, _kind(found.get("class", "")) if tag == "article" else 0
    role = found.get("role", "").lower()
    if role in ROLES and (tag, role) != ("form", "form"):
        return True, 0
    return False, _kind(f"{found.get('class', '')} {found.get('id', '')}")


def _is_field(raw: str) -> bool:
    kind = next((a or b or c for name, a, b, c, _ in _ATTRIBUTE.findall(raw) if name.lower() == "type"), "")
    return kind.strip().lower() not in NO_FIELDS


def parse(page: str) -> Node:
    """The tree of a page; texts are decoded strings among the children."""
    root = Node("#page", None)
    open_nodes, at = [root], 0

    def close(names: tuple[str, ...] | frozenset[str], until: frozenset[str] = frozenset()) -> None:
        for k in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[k].tag in names:
                del open_nodes[k:]
                return
            if open_nodes[k].tag in until:
                return

    def add(text: str) -> None:
        if text:
            open_nodes[-1].children.append(entities.unescape(text))

    search = _MARKUP.search
    while (m := search(page, at)) is not None:
        add(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m.group(2):
            tag, raw = m.group(2).lower(), m.group(3)
            if tag in ("html", "head", "body"):
                if tag == "body":
                    close(("head",))
                if any(n.tag == tag for n in open_nodes):
                    continue
            elif open_nodes[-1].tag == "head" and tag not in ("meta", "title", "link", "script", "style", "base", "noscript", "template"):
                close(("head",))
            if tag in BLOCKS:
                close(("p",), frozenset(("button", "td", "th", "table")))
            if tag in HEADINGS and open_nodes[-1].tag in HEADINGS:
                del open_nodes[-1:]
            if tag in CLOSES:
                close(CLOSES[tag], frozenset(("ul", "ol", "dl", "select")) if tag in ("li", "dt", "dd", "option") else frozenset(("table",)))
            node = Node(tag, open_nodes[-1], *_says_apart(tag, raw))
            node.field = int(tag in ("select", "textarea") or tag == "input" and _is_field(raw))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if not raw.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use"):
                open_nodes.append(node)
        elif m.group(1):
            tag = m.group(1).lower()
            if tag == "p" and all(n.tag != "p" for n in open_nodes):
                Node("p", open_nodes[-1])
            elif tag == "br":
                Node("br", open_nodes[-1])
            elif tag in INLINE:
                # an inline end does not close the block it stands in
                close((tag,), BLOCKS | frozenset(("li", "td", "th", "body")))
            elif tag not in ("html", "body"):
                close((tag,), frozenset(("td", "th")) if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table") else frozenset())
    add(page[at:])
    return root


def _measure(root: Node) -> None:
    """Characters, link characters, tags and link tags of each node, without what is apart; of these also
    the characters of running text (of the node's own block), of paragraphs and of ``p`` elements, links apart."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node) and not c.apart]
        node.chars = own + sum(c.chars for c in below)
        node.links = node.chars if node.tag == "a" else sum(c.links for c in below)
        node.tags = sum(c.tags + 1 for c in below)
        node.link_tags = node.tags if node.tag == "a" else sum(c.link_tags + (c.tag == "a") for c in below)
        node.running = 0 if node.tag == "a" else own + sum(c.running for c in below if c.tag in INLINE)
        node.fields = node.field + sum(c.fields for c in node.children if isinstance(c, Node) and not c.kind)
        node.prose, node.lines = sum(c.prose for c in below), sum(c.lines for c in below)
        if node.tag not in INLINE:
            node.prose += node.running if node.running >= PARAGRAPH else 0
            node.lines += node.running if node.tag == "p" else 0
        if node.tag in ("article", "main") and not node.prose:
            node.prose = node.chars - node.links


def _set_apart(root: Node) -> None:
    """Settles the parts named by class or id: all are apart, but if no paragraphs are left outside them,
    the outermost one that has some; reader comments are the last choice, and only if nothing else is left."""
    named, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.kind:
            named.append((depth, node))
            node.apart, depth = True, depth + 1
        stack.extend((c, depth) for c in reversed(node.children) if isinstance(c, Node) and (c.kind or not c.apart))
    _measure(root)
    if not named or root.prose:
        return
    choices = [(n.kind == COMMENT, d, -n.prose, k) for k, (d, n) in enumerate(named) if n.prose and (n.kind != COMMENT or not root.lines)]
    if not choices:
        choices = [(n.kind == COMMENT, d, n.links - n.chars, k) for k, (d, n) in enumerate(named) if n.chars and not root.chars]
    if choices:
        node = named[min(choices)[-1]][1]
        while node is not None:
            node.apart, node = False, node.parent
        _measure(root)


def _set_forms_apart(root: Node) -> None:
    """Forms and labels without paragraphs go; so do forms with too few for their fields, if paragraphs are
    left outside them. Forms stay if no text is left without them."""
    forms = [n for n in _walk(root) if n.tag in FORMS]
    if not forms:
        return
    for node in forms:
        enough = node.prose if node.tag == "label" else node.prose >= FORM_TEXT * (1 + node.fields) or node.prose and node.prose == root.prose
        node.apart = not enough
    _measure(root)
    if not root.prose and not root.lines:
        gone = [n for n in forms if n.apart and n.tag == "form"]
        texts = [n for n in gone if n.prose] or [n for n in gone if n.lines]
        for node in texts:
            node.apart = False
        if texts:
            _measure(root)


def _readmit(core: Node) -> None:
    """Parts of the chosen node whose class or id may be the article's own: with paragraphs, and not mostly links."""
    for node in [n for n in _below(core) if n.kind == MAYBE and n.apart][::-1]:
        node.apart = not (node.prose or node.lines) or 2 * node.links >= node.chars
        above = node
        while not node.apart and above is not core and (above := above.parent) is not None:
            above.prose, above.lines = above.prose + node.prose, above.lines + node.lines
            above.chars, above.links = above.chars + node.chars, above.links + node.links
            if above.kind == MAYBE and above.apart:
                break


def _below(node: Node) -> Iterator[Node]:
    """A node and all below it, without what is apart for other reasons than a generic word."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node) and (not c.apart or c.kind == MAYBE))


def _densities(root: Node, body: Node) -> None:
    share = max(1, body.links) / max(1, body.chars)
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        chars, links, tags, link_tags = node.chars, max(1, node.links), max(1, node.tags), max(1, node.link_tags)
        node.density = 0.0
        if chars:
            plain = max(1, chars - node.links)
            base = math.log(chars / plain * links + share * chars + math.e)
            node.density = chars / tags * math.log(max(1.0 + 1e-9, chars / links * tags / link_tags)) / base
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.apart)


def _core(root: Node) -> Node:
    body = next((n for n in _walk(root) if n.tag == "body"), root)
    _densities(root, body)
    best = body
    for node in _walk(body):
        if node.total > best.total:
            best = node
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    for home in ("article", "main"):
        homes = [n for n in path if n.tag == home]
        if homes:
            return homes[-1]
    chosen = best
    for node in path[1:]:
        if node.density < WIDEN * chosen.density or node.density < least:
            break
        chosen = node
    return chosen


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.apart)


def _text(core: Node) -> str:
    """Texts in page order; a block's edges are white space, running tags are none."""
    out, stack = [], [(core, False)]
    while stack:
        item, only_headings = stack.pop()
        if isinstance(item, str):
            if not only_headings:
                out.append(item)
            continue
        if item.apart:
            if item.tag != "header" or item.parent.tag not in ("article", "main"):
                continue
            only_headings = True
        elif item.tag in HEADINGS:
            only_headings = False
        if item.tag not in INLINE:
            out.append(" ")
            stack.append((" ", False))
        stack.extend((c, only_headings) for c in reversed(item.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _set_apart(root)
    _set_forms_apart(root)
    core = _core(root)
    _readmit(core)
    return _text(core)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text of each row."""
    kept = [f for f in pages.schema if f.name not in (html_col, out_col)]
    names = [f.name for f in kept]
    rows = pages.select(*names, text_of(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = pa.array([main_text(p) for p in batch.column("_html").to_pylist()], pa.string())
            yield pa.record_batch([*batch.select(names).columns, texts], names=[*names, out_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out_col}` string"]))
