"""Readers on small files, streams run twice, page layouts."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import modeltext as M
from palimpsest.functions import text as X
from palimpsest.sources import pages as P
from palimpsest.sources import rates as R
from palimpsest.operators import logs as L
from palimpsest.streaming import jobs as J

XML = """<?xml version="1.0"?><DataSet xmlns="http://example.org/x"><Header><Date>x</Date></Header><Body>
<Cube date="2026-03-06"><Rate currency="EUR">4.9741</Rate><Rate currency="HUF" multiplier="100">1.1</Rate>
<Rate currency="USD">bad</Rate><Rate currency="GBP" multiplier="x">5.7</Rate><Rate>1.0</Rate></Cube></Body></DataSet>"""


def test_fx_xml_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = {(str(r.date), r.currency, r.rate, r.multiplier) for r in R.read_fx_xml(spark, str(tmp_path)).collect()}
    assert rows == {("2026-03-06", "EUR", 4.9741, 1), ("2026-03-06", "HUF", 1.1, 100), ("2026-03-06", "GBP", 5.7, 1)}


def test_rate_table_files(spark, tmp_path):
    page = "<table><tr><th>Data</th><th>O/N</th><th>T/N</th><th>1 luna</th></tr><tr><td>27 Apr 2026</td><td>5,69</td><td>5,7</td><td>-</td></tr></table>"
    (tmp_path / "a.html").write_text(page)
    (tmp_path / "b.html").write_text("<p>no table")
    rows = [(str(r.date), r.tenor, r.rate) for r in R.read_rate_table_html(spark, str(tmp_path), "ROBOR").collect()]
    assert rows == [("2026-04-27", "ON", 5.69)]


def test_seed_round_trip(spark, tmp_path):
    with gzip.open(tmp_path / "s.csv.gz", "wt") as fh:
        fh.write("date,rate_type,tenor,rate\n2024-01-02,ROBOR,3M,5.5\nbad,ROBOR,3M,1\n2024-01-03,,,6\n2024-01-04,X,1M,-\n")
    df = R.read_rate_seed(spark, str(tmp_path / "s.csv.gz"))
    R.write_rate_seed(df, str(tmp_path / "out"))
    again = R.read_rate_seed(spark, str(tmp_path / "out"))
    want = {("2024-01-02", "ROBOR", "3M", 5.5), ("2024-01-03", "ROBOR", "", 6.0)}
    assert {(str(r.date), r.rate_type, r.tenor, r.rate) for r in again.collect()} == want


def test_stream_rates_rerun_adds_nothing(spark, tmp_path):
    landing, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("date,rate_type,tenor,rate\n2024-01-02,ROBOR,3M,5.5\n")
    J.stream_rates(spark, landing, target, check).awaitTermination()
    (tmp_path / "in" / "2.csv").write_text("date,rate_type,tenor,rate\n2024-01-02,ROBOR,3M,9.9\n2024-01-01,ROBOR,3M,5.0\n")
    J.stream_rates(spark, landing, target, check).awaitTermination()
    J.stream_rates(spark, landing, target, check).awaitTermination()
    rows = {(str(r.date), r.rate) for r in spark.read.parquet(target).collect()}
    assert rows == {("2024-01-02", 5.5), ("2024-01-01", 5.0)}
    assert spark.read.parquet(target).count() == 2


def test_stream_history(spark, tmp_path):
    landing, known, notices, check = (str(tmp_path / n) for n in ("in", "known", "notices", "check"))
    (tmp_path / "in").mkdir()
    rows = [{"law_id": 1, "pos": 0, "ver_id": 11, "date": "02.03.2020"}, {"law_id": 1, "pos": 1, "ver_id": 10, "date": "01.01.2019"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    versions = spark.createDataFrame([(10, 1, 10)], "version_id long, law_id long, ver_id long")
    laws = spark.createDataFrame([(1, "T", "31", 1990)], "law_id long, title string, law_number string, law_year int")
    for _ in range(2):
        J.stream_history(spark, landing, known, versions, laws, notices, check).awaitTermination()
    got = {(r.ver_id, r.is_current) for r in spark.read.parquet(known).collect()}
    assert got == {(11, True), (10, False)}
    assert [r.message for r in spark.read.parquet(notices).collect()] == ["1 new version(s) discovered for Legea 31/1990."]
    # later batches write the laws they read and no others; a batch that is run again changes nothing
    rows = [{"law_id": 2, "pos": 0, "ver_id": 20, "date": "02.03.2020"}, {"law_id": 3, "pos": 0, "ver_id": None, "date": "02.03.2020"}]
    (tmp_path / "in" / "2.json").write_text("\n".join(map(json.dumps, rows)))
    J.stream_history(spark, landing, known, versions, laws, notices, check).awaitTermination()
    (tmp_path / "in" / "3.json").write_text(json.dumps({"law_id": 1, "pos": 0, "ver_id": 12, "date": "01.01.2021"}))
    for again in (False, True):
        if again:
            last = max((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        J.stream_history(spark, landing, known, versions, laws, notices, check).awaitTermination()
        got = {(r.law_id, r.ver_id, r.is_current) for r in J.known_history(spark, known).collect()}
        assert got == {(1, 12, True), (1, 11, False), (1, 10, False), (2, 20, True)}
    assert [spark.read.parquet(f"{known}/batch={n}").count() for n in range(3)] == [2, 1, 3]


def test_stream_history_start(spark, tmp_path):
    """What was known before the first batch; no files and no table give no rows."""
    known = str(tmp_path / "known")
    assert J.known_history(spark, known).count() == 0
    spark.createDataFrame([(1, 9, None, True), (4, 40, None, True)], J.KNOWN).write.parquet(f"{known}/start")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"law_id": 1, "pos": 0, "ver_id": 11, "date": "02.03.2020"}))
    versions = spark.createDataFrame([], "version_id long, law_id long, ver_id long")
    laws = spark.createDataFrame([], "law_id long, title string, law_number string, law_year int")
    J.stream_history(spark, str(tmp_path / "in"), known, versions, laws, str(tmp_path / "n"), str(tmp_path / "c")).awaitTermination()
    assert {(r.law_id, r.ver_id, r.is_current) for r in J.known_history(spark, known).collect()} == {(1, 9, False), (1, 11, True), (4, 40, True)}


def test_stream_run_logs(spark, tmp_path):
    """Equal to the batch view over all files, after more files, a restart and a batch that is run again."""
    landing, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    runs = [("ok", "HIGH", 2.0, 0.5), ("ok", "LOW", 0.0, 0.0), ("running", "HIGH", 1.0, 9.0), ("error", "LOW", 3.0, None), ("ok", "HIGH", 5.0, 0.25), ("odd", None, None, 0.1)]
    for part, rows in enumerate((runs[:4], runs[4:])):
        lines = [json.dumps(dict(zip(("run_id", "overall_status", "overall_confidence", "total_duration_seconds", "estimated_cost"), (part, *r)))) for r in rows]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
        for _ in range(2):
            J.stream_run_logs(spark, landing, target, check).awaitTermination()
    # the last batch is planned but not committed, as after a failure
    commits = sorted((int(p.name), p) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    commits[-1][1].unlink()
    (tmp_path / "check" / "commits" / f".{commits[-1][0]}.crc").unlink(missing_ok=True)
    J.stream_run_logs(spark, landing, target, check).awaitTermination()
    counts = J.run_log_counts(spark, target)
    assert {(r.overall_status, r.runs, r.high, r.seconds) for r in counts.collect()} == {("ok", 3, 2, 7.0), ("error", 1, 0, 3.0), ("odd", 1, 0, None)}
    batch = spark.createDataFrame(runs, "overall_status string, overall_confidence string, total_duration_seconds double, estimated_cost double")
    assert J.health_from_counts(counts).first().asDict() == L.run_health(batch).first().asDict()


def test_flat_layout(spark):
    page = (
        '<html><body><p class="title-doc-first">REGULAMENT</p><p class="title-division-1">TITLUL I</p><p class="title-division-2">Generale</p>'
        '<p class="title-division-1">CAPITOLUL 1</p><p class="title-article-norm">Articolul 1</p><p class="stitle-article-norm">Obiect</p>'
        '<p class="norm">(1) unu</p><p class="norm">doi</p><p class="norm">(2) trei</p><p class="title-annex-1">ANEXA II</p><p class="norm">corp</p></body></html>'
    )
    out = P.parse_pages(P.page_elements(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")))
    assert [r.title for r in out["titles"].collect()] == ["REGULAMENT"]
    assert {(r.level, r.number, r.title, r.parent_at is None) for r in out["structure"].collect()} == {("title", "I", "Generale", True), ("chapter", "1", None, False)}
    assert [r.text for r in out["paragraphs"].orderBy("paragraph_at").collect()] == ["(1) unu doi", "(2) trei"]
    assert [(r.number, r.article_title) for r in out["articles"].collect()] == [("1", "Obiect")]
    assert [(r.annex_id, r.text) for r in out["annexes"].collect()] == [("anexa_ii", "corp")]


def test_flat_layout_grids(spark):
    """Text blocks, grids in and beside them, clauses without class; blocks that only hold the page are none."""
    grid = lambda label, inner: f'<div class="grid-container grid-list"><div class="list grid-list-column-1"><span>{label}</span></div><div class="grid-list-column-2">{inner}</div></div>'
    page = (
        '<body><div><p class="title-article-norm">Articolul 1</p>' + grid("(x)", '<p class="norm">fara alineat</p>')
        + '<p class="title-article-norm">Articolul 2</p><p class="norm">intro</p><p class="modref">M1</p><div class="norm"><div class="inline-element"><p class="norm">(1) in casuta</p></div>'
        + grid("(a)", '<p class="norm">unu</p>' + grid("(i)", "<p>doi</p>" + grid("1.", "<p>trei</p>")) + grid("(ii)", "<p>patru</p>"))
        + '</div><div class="norm">' + grid("(z)", '<p class="norm">bloc fara text</p>') + '</div><div class="grid-container grid-list"><p class="norm">fara coloane</p></div>'
        + '<div><div><p class="norm">(b) veche</p></div></div><div><p>nimic</p></div><p class="norm">coada</p><hr class="separator-annex"><p class="norm">dupa</p></div></body>'
    )
    out = P.parse_pages(P.page_elements(spark.createDataFrame([(1, page), (2, '<p class="title-article-norm">Articolul 7</p>')], "page_id long, html string")))
    take = lambda part, *cols: [tuple(r[c] for c in cols) for r in out[part].orderBy("page_id", "article_at", *[c for c in ("paragraph_at", "seq") if c in out[part].columns]).collect()]
    assert take("paragraphs", "label", "text") == [("", ""), ("", "intro"), ("(1)", "(1) in casuta coada")]
    assert take("subclauses", "label", "text") == [
        ("(x)", "(x) fara alineat"), ("(a)", "(a) unu\n(i) doi\n1. trei\n(ii) patru"), ("(i)", "(i) doi\n1. trei"), ("1.", "1. trei"), ("(ii)", "(ii) patru"), ("(b)", "(b) veche")
    ]
    assert take("articles", "number", "full_text")[0] == ("1", "Articolul 1\n(x) fara alineat")
    assert [n for n, in take("articles", "number")] == ["1", "2", "7"]


def test_structured_layout_preamble(spark):
    page = (
        '<div class="eli-container"><div id="pbl_1"><div id="cit_1">avand in vedere</div><div id="rct_1"><table><tr><td>(1)</td><td>intrucat</td></tr></table></div></div>'
        '<div id="enc_1"><div id="art_5"><p class="oj-ti-art">Articolul 5</p><p class="oj-sti-art">Principii</p><p class="oj-normal">text</p></div></div>'
        '<p class="oj-note"><a id="ntr3">3</a> nota</p><p class="note">mai veche</p></div>'
    )
    out = P.parse_pages(P.page_elements(spark.createDataFrame([(1, page)], "page_id long, html string")))
    assert {(r.kind, r.number, r.text) for r in out["preamble"].collect()} == {("citation", "cit_1", "avand in vedere"), ("recital", "1", "intrucat")}
    assert [(r.number, r.full_text) for r in out["articles"].collect()] == [("5", "Articolul 5\nPrincipii\ntext")]
    assert [(r.number, r.text) for r in out["footnotes"].collect()] == [("3", "3 nota")]


def test_blocks_name_their_parts(spark):
    grid = lambda label, inner: f'<div class="grid-container grid-list"><div class="list grid-list-column-1"><span>{label}</span></div><div class="grid-list-column-2">{inner}</div></div>'
    page = (
        '<div class="eli-container"><div class="eli-main-title"><p class="oj-doc-ti">REGULAMENT</p></div><div id="enc_1"><div id="cpt_I"><div class="eli-title"><p class="oj-ti-section-2">Capitol</p></div>'
        '<div id="cpt_I.sct_1"><p class="title-division-2">Sectiune</p><div id="art_1"><div class="norm"><span class="no-parag">(1)</span><div class="norm inline-element"><p class="norm">unu</p>'
        + grid("(a)", '<p class="norm">prima</p>' + grid("(i)", '<div class="inline-element"><p>adanc</p></div>'))
        + '</div></div><div class="norm"><span class="no-parag">(2)</span><div class="inline-element">fara p</div></div></div></div>'
        '<div id="art_2a"><p class="oj-normal">direct</p><table><tr><td>(a)</td><td><p class="oj-normal">tabel</p></td></tr></table></div></div>'
        '<div id="art_9"><p class="oj-normal">in afara capitolelor</p></div></div><div id="anx_I"><p class="oj-ti-section-1">ANEXA I</p><p class="oj-normal">corp</p></div></div>'
    )
    out = P.parse_pages(P.page_elements(spark.createDataFrame([("x", page)], "page_id string, html string")))
    take = lambda part, *cols: sorted(tuple(r[c] for c in cols) for r in out[part].collect())
    assert take("structure", "level", "number", "title") == [("chapter", "I", "Capitol"), ("section", "1", "Sectiune")]
    assert [n for n, in take("articles", "number")] == ["1", "2a"]
    assert take("paragraphs", "label", "text") == [("", "direct"), ("(1)", "unu prima adanc"), ("(2)", "fara p")]
    assert take("subclauses", "label", "text") == [("(a)", "(a) prima\n(i) adanc"), ("(a)", "(a) tabel"), ("(i)", "(i) adanc")]
    assert take("annexes", "annex_id", "title", "text") == [("anx_I", "ANEXA I", "corp")]
    assert take("titles", "title") == [("REGULAMENT",)]


def test_annotations(spark):
    note = "(la 01-02-2020, Litera a) din MONITORUL OFICIAL nr. 1 din 2020)"
    cases = {
        f"unu {note} doi": "unu doi",
        f"unu {note} , doi {note}": "unu, doi",
        "unu (la 01-02-2020, fara sfarsit": "unu (la 01-02-2020, fara sfarsit",
        f"a {note} b (la 03-04-2021, deschis": "a b (la 03-04-2021, deschis",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.strip_annotations(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == cases


def test_json_object(spark):
    cases = ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', '{"a": 1} // note', 'so {"a": {"b": "http://x"}} end }', "none { here", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", M.json_object(F.col("t")).alias("j"))
    got = {r.t: None if r.j is None else json.loads(r.j) for r in df.collect()}
    assert got == {cases[0]: {"a": 1}, cases[1]: {"a": 1}, cases[2]: {"a": 1}, cases[3]: {"a": {"b": "http://x"}}, cases[4]: None, None: None}


def test_tags_written_in_any_way_read_alike():
    from palimpsest.sources.pages import _flatten

    plain = '<html><head><style>p{}</style></head><body><div id="cit_1"><p class="ti-art">Articolul 1 &amp; 2</p><p>unu<br>doi</p><p>trei</div><textarea><p>x</p></textarea></body></html>'
    other = plain.replace("<p>", "<P >").replace('<p class="ti-art">', "<p  CLASS='ti-art'>").replace("</p>", "</p >").replace('id="cit_1"', "id=cit_1")
    assert _flatten(plain) == _flatten(other)
    assert [(r[3], r[8]) for r in _flatten(plain) if r[3] == "p"][:3] == [("p", "Articolul 1 & 2"), ("p", "unu doi"), ("p", "trei")]


def test_annotations_look_for_each_end_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(X.strip_annotations(F.concat("t", F.lit("mark"))).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MONITORUL") == 1 and plan.count("mark") == 1


def _document(version, *articles):
    note = {"note_id": "n", "text": "nou"}
    return (version, [{"book_id": "b", "articles": ["2", "1", "2"]}], [{"article_id": k, "label": k, "full_text": t, "notes": [note], "paragraphs": [{"label": "", "text": t}]} for k, t in articles], [])


def _shredded(spark, rows):
    from palimpsest.sources import documents as P

    lines = [json.dumps(dict(zip(("version_id", "books", "articles", "annexes"), r))) for r in rows]
    schema = f"version_id long, books {P.BOOKS}, articles {P.ARTICLES}, annexes {P.ANNEXES}"
    return P.shred_documents(spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", schema).alias("d")).select("d.*"))


def test_shredding_keeps_one_body_of_a_repeated_article(spark):
    rows = [_document(1, ("1", "a"), ("2", "b"), ("1", "c"), ("3", "d"), ("3", "e")), _document(None, ("1", "f")), (2, None, None, None)]
    found = _shredded(spark, rows)["articles"].select("version_id", "article_number", "full_text", "order_index", F.col("element_id").isNotNull().alias("listed")).collect()
    # listed: the last body at its place in the list; not listed: the first body at its own place
    assert {tuple(r) for r in found} == {(1, "1", "c", 1, True), (1, "2", "b", 0, True), (1, "3", "d", 3, False), (None, "1", "f", 0, False)}


def test_shredding_stores_less_than_the_texts(spark):
    from pathlib import Path

    from palimpsest.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    text = "Prevederile acestui articol se aplica. " * 50
    before = size()
    _shredded(spark, [_document(k, ("1", text), ("2", text), ("3", text)) for k in range(300)])
    assert size() - before < 300 * 3 * len(text)


def test_backfill_gathers_the_lines_once(spark, tmp_path):
    from palimpsest.plans.documents import backfill_report

    # two lines of one number, a line with a clean article, one with a label that is not stored
    lines = [(1, 1, 12, "N"), (1, 1, 13, "N"), (1, 2, 14, "A"), (2, 1, 22, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    report = backfill_report(spark, str(tmp_path))
    assert not [f for f in report.inputFiles() if "lineitem" in f]
    assert {r.what: r.n for r in report.collect()} == {
        "paragraph_notes_to_insert": 1, "article_notes_to_insert": 1, "article_text_clean": 1, "paragraph_text_clean": 1, "unknown_labels": 2,
    }


def test_plain_pages_are_read_as_the_parser_reads_them():
    pieces = ["<p>", "</p>", '<p class="a b">', "<td>", "</td>", '<div id="cit_1">', "</div>", " x ", "&amp;", "&lt", "<br/>", '<hr class="z"/>', "<style>p{}</style>", "<style>", "q<r", "<!-- c -->", "<title>", '<b x="1"/>', "<A>", "&copy"]
    pages, plain = ["".join(pieces[(i * k + i // 7) % len(pieces)] for k in range(1, 8)) for i in range(2000)], 0
    for page in pages:
        rows = P._plain(page)
        plain += rows is not None
        assert P._flatten(page) == P._parsed(page), page
    assert 200 < plain < 2000


def test_parts_of_pages_are_worked_out_when_asked_for(spark, monkeypatch):
    from palimpsest.sources import structured as S

    names, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: names.append(name) or keep(df, name))
    html = (
        '<div class="eli-container"><div id="enc_1"><div id="tis_I"><div class="eli-title"><p class="oj-ti-section-2">T</p></div><div id="art_1"><div id="001.001">'
        '<p class="oj-normal">(1) x</p><table><tr><td>(a)</td><td><p class="oj-normal">y</p></td></tr></table></div></div></div></div></div>'
    )
    parts = P.parse_pages(P.page_elements(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert [(r.level, r.number, r.title) for r in parts["structure"].collect()] == [("title", "I", "T")]
    assert "subclauses" not in names
    assert [(r.label, r.text) for r in parts["subclauses"].collect()] == [("(a)", "(a) y")]
    assert [(r.label, r.text) for r in parts["paragraphs"].collect()] == [("(1)", "(1) x")]
    assert names.count("subclauses") == 1


def test_shredding_writes_only_what_a_part_needs(spark, monkeypatch):
    from palimpsest.sources import documents as P

    names, keep = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: names.append(name) or keep(df, name))
    rows = [_document(1, ("1", "a"), ("2", "b"), ("1", "c"), ("3", "d"))[:3] + ([{"annex_id": "x", "title": "t", "text": "b", "notes": [{"text": "n"}]}, None],), (2, None, None, None)]
    assert [tuple(r) for r in _shredded(spark, rows)["annexes"].select("version_id", "source_id", "title", "full_text").collect()] == [(1, "x", "t", "b\n[Modificare: n]")]
    assert names == []
    alone = _shredded(spark, rows)
    assert alone["elements"].count() == 1 and "articles" not in names and "documents" not in names
    said = ["article_id", "paragraph_id", "note_source_id", "text"]
    notes = sorted(map(tuple, alone["notes"].select(said).collect()))
    assert "articles" not in names and [r[2:] for r in notes] == [("n", "nou")] * 3
    whole = _shredded(spark, rows)
    assert whole["articles"].count() == 3 and sorted(map(tuple, whole["notes"].select(said).collect())) == notes


def _unreadable(spark):
    good = '<p class="ti-art">Articolul 1</p><p class="normal">(1) x</p><p class="title-annex-1">ANEXA I</p><p>corp</p>'
    return spark.createDataFrame([(1, good), (7, "<![foo[x]]>"), (8, None)], "page_id long, html string")


def test_an_unreadable_page_is_no_page_without_parts(spark):
    with pytest.raises(Exception, match="page 7 cannot be read"):
        P.page_annexes(P.page_elements(_unreadable(spark))).collect()
    with pytest.raises(P.UnreadablePage):
        P._flatten("<![foo[x]]>")
    some = P.page_elements(_unreadable(spark), skip_unreadable=True)
    assert [r.text for r in P.page_annexes(some).collect()] == ["corp"]
    assert {r.page_id for r in P.broken_pages(_unreadable(spark), some).collect()} == {7, 8}


def test_only_the_parsers_refusal_is_skipped(spark, monkeypatch):
    def out_of_memory(html):
        raise MemoryError("no more")

    monkeypatch.setattr(P, "_flatten", out_of_memory)
    with pytest.raises(Exception, match="no more"):
        P.page_elements(_unreadable(spark), skip_unreadable=True).collect()


def test_paragraphs_are_not_counted_without_the_pages_that_cannot_be_read(spark, monkeypatch):
    from palimpsest.plans import pages as Q

    monkeypatch.setattr(Q, "legal_pages", lambda spark, d: _unreadable(spark))
    with pytest.raises(Exception, match="page 7 cannot be read"):
        Q.parse_page_paragraphs(spark, "").collect()
    monkeypatch.setattr(Q, "legal_pages", lambda spark, d: _unreadable(spark).where("page_id <> 7"))
    assert [tuple(r) for r in Q.parse_page_paragraphs(spark, "").collect()] == [(1, "(1)", 1)]


def test_articles_outside_of_divisions_and_unreadable_pages_are_not_lost(spark, monkeypatch):
    from palimpsest.plans import pages as Q

    article = lambda n: f'<div id="art_{n}"><div id="00{n}.001"><p class="oj-normal">(1) x</p></div></div>'
    html = f'<div class="eli-container"><div id="enc_1">{article(1)}{article(2)}</div></div>'
    pages = spark.createDataFrame([("a", html), ("b", "<p>x</p><![foo[x]]>")], "page_id string, html string")
    monkeypatch.setattr(Q, "block_pages", lambda spark, d: pages)
    with pytest.raises(Exception, match="page 'b' cannot be read"):
        Q.parse_block_articles(spark, "").collect()
    monkeypatch.setattr(Q, "block_pages", lambda spark, d: pages.where("page_id = 'a'"))
    found = Q.parse_block_articles(spark, "").select("page_id", "number", "held_by", "full_text").collect()
    assert {tuple(r) for r in found} == {("a", n, None, f"Articolul {n}\n(1) x") for n in "12"}


def test_pages_of_one_layout_are_written_once(spark, monkeypatch):
    names, keep = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: names.append(name) or keep(df, name))
    legacy = '<p class="ti-section-1">CAPITOLUL I</p><p class="ti-art">Articolul 1</p><p class="normal">(1) x</p><table><tr><td>(a)</td><td>y</td></tr></table>'
    flat = '<p class="title-article-norm">Articolul 2</p><div class="norm"><span>(1)</span> <p class="norm">z</p></div>'
    schema = "page_id long, html string"

    def said(*pages):
        out = P.parse_pages(P.page_elements(spark.createDataFrame(list(pages), schema)))
        return {(r.page_id, r.number, r.full_text) for r in out["articles"].collect()}

    one = (1, "1", "Articolul 1\n(1) x\n(a) y")
    assert said((1, legacy)) == {one}
    assert names == ["layouts"]
    two = (2, "2", "Articolul 2\n(1) z")
    assert said((1, legacy), (2, flat), (3, "<p>nothing</p>"), (None, legacy)) == {one, two}
