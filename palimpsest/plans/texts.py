"""Driver queries of the text functions, over texts built from what the tables hold, in every form."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ids as I
from palimpsest.functions import segments as G
from palimpsest.functions import text as X
from palimpsest.operators.core import spread
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY

add = REGISTRY.add


def _pick(forms, key):
    """The text of form ``key`` modulo their number."""
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(key % len(forms) == i, form).otherwise(out)
    return out


def _case(key: str, forms) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


# a note on order o: its start, its body, and its end
_DAY = "strftime(CAST(o_orderdate AS DATE), '%d-%m-%Y')"
_NOTE = f"'(la ' || {_DAY} || ', Articolul ' || o_custkey || ' a fost modificat; MONITORUL OFICIAL nr. ' || o_orderkey || ' din 2020)'"


@add("strip_annotations", "SELECT o_orderkey AS id, " + _case("o_orderkey", [
    "'Plata ' || o_orderpriority || ', se face.'",
    "'Plata ' || o_orderpriority || ' x'",
    f"'Plata ' || o_orderpriority || ' (la ' || {_DAY} || ', fără sfârșit'",
    # the marker begins within reach and closes beyond it
    f"'Plata (la ' || {_DAY} || repeat('z', 1480) || ' MONITORUL OFICIAL nr. ' || o_orderkey || ')'",
    "'Unu doi trei ' || o_custkey",
    f"'Unu doi (la ' || {_DAY} || ' rest ' || repeat('y', 1600) || ' ' || {_NOTE}",
    "'Fără note ' || o_orderpriority",
    # a note that closes just within reach goes
    "'Plata '  || o_custkey",
]) + " AS cleaned FROM orders")
def strip_annotations(spark, d):
    """X3 over notes of every kind."""
    o = spread(S.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    text = lambda c: F.col(c).cast("string")
    note = F.concat(F.lit("(la "), day, F.lit(", Articolul "), text("o_custkey"), F.lit(" a fost modificat; MONITORUL OFICIAL nr. "), text("o_orderkey"), F.lit(" din 2020)"))
    open_ = F.concat(F.lit("(la "), day)
    tail = F.concat(F.lit(" MONITORUL OFICIAL nr. "), text("o_orderkey"), F.lit(")"))
    forms = [
        F.concat(F.lit("  Plata "), "o_orderpriority", F.lit("  "), note, F.lit(" , se   face .")),
        F.concat(F.lit("Plata "), note, "o_orderpriority", note, F.lit("\t "), F.lit("x")),
        F.concat(F.lit("Plata "), "o_orderpriority", F.lit(" "), note, open_, F.lit(", fără sfârșit")),
        F.concat(F.lit("Plata "), open_, F.lit("z" * 1480), tail),
        F.concat(F.lit("Unu "), note, F.lit("doi "), note, F.lit(" trei "), text("o_custkey")),
        F.concat(F.lit("Unu doi "), open_, F.lit(" rest " + "y" * 1600 + " "), note),
        F.concat(F.lit("Fără note "), "o_orderpriority"),
        F.concat(F.lit("Plata "), open_, F.lit("z" * 1460), tail, F.lit(" "), text("o_custkey")),
    ]
    return o.select(F.col("o_orderkey").alias("id"), X.strip_annotations(_pick(forms, F.col("o_orderkey"))).alias("cleaned"))


_SUBJECTS = [
    # (text in SQL, article, paragraph, letter)
    ("'Litera b^1) a alineatului (' || n || ') al articolului ' || k", "k", "'(' || n || ')'", "'b^1)'"),
    ("'articolul ' || k || ', alineatul (' || n || '), litera c)'", "k", "'(' || n || ')'", "'c)'"),
    ("'Alineatul (' || n || '^2) al articolului ' || k || '^1'", "k || '^1'", "'(' || n || '^2)'", None),
    ("'După Articolul ' || k || ',  alineatul (' || n || ') se introduce'", "k", "'(' || n || ')'", None),
    ("'  Articolul ' || k || ' '", "k", None, None),
    ("'Punctul ' || n || '. al articolului ' || k || ' se modifică'", "k", None, None),
    ("'Articolul ' || k || ' se abrogă'", None, None, None),
    ("'Titlul ' || n", None, None, None),
    ("''", None, None, None),
]
_SUBJECT_ROWS = "(SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS n FROM part)"


@add("note_subjects", "SELECT p_partkey AS id, " + ", ".join(
    _case("p_partkey", [f"coalesce({form[i]}, '-')" if form[i] else "'-'" for form in _SUBJECTS]) + f" AS {name}" for i, name in ((1, "article"), (2, "paragraph"), (3, "letter"))
) + f" FROM {_SUBJECT_ROWS}")
def note_subjects(spark, d):
    """The six phrasings, and three that name nothing."""
    p = S.load(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("n"))
    subject = _pick([F.expr(form[0]) for form in _SUBJECTS], F.col("p_partkey"))
    found = p.select(F.col("p_partkey").alias("id"), X.parse_subject(subject).alias("s"))
    return found.select("id", *[F.coalesce(f"s.{a}", F.lit("-")).alias(b) for a, b in (("article", "article"), ("paragraph", "paragraph"), ("subparagraph", "letter"))])


_REPAIRS = [
    ("'?i ' || c_name || ' ?i'", "'și ' || c_name || ' și'"),
    ("c_name || '?i'", "c_name || 'ți'"),
    ("'?tiin?a ' || c_mktsegment", "'Știința ' || c_mktsegment"),
    ("c_mktsegment || '?t'", "c_mktsegment || 'șt'"),
    ("'?' || c_name", "'Ț' || c_name"),
    ("c_name || ' ? ' || c_mktsegment", "c_name || ' ț ' || c_mktsegment"),
    ("'şŞţŢ ' || c_name", "'șȘțȚ ' || c_name"),
    ("'Na?iunea ş ' || c_name", "'Națiunea ș ' || c_name"),
    ("c_name", "c_name"),
]


@add("repaired_letters", "SELECT c_custkey AS id, " + _case("c_custkey", [b for _, b in _REPAIRS]) + " AS repaired FROM customer")
def repaired_letters(spark, d):
    """Each rule, on names of the table."""
    return S.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.repair_letters(_pick([F.expr(a) for a, _ in _REPAIRS], F.col("c_custkey"))).alias("repaired"))


_REPEALS = [
    ("'  (Abrogat) ' || p_name", True, False), ("'abrogată ' || p_name", True, False), ("'Art. ' || p_size || ' Abrogat'", True, False),
    ("'Art. ' || p_size || ' ' || p_name || ' abrogat'", True, False), ("p_name || ' abrogat'", False, False), ("'(Abrogată).'", True, True), (" ' Abrogat '", True, True),
    ("'Art. x Abrogat'", False, False), ("repeat('a', 200) || 'Abrogat'", False, False), ("''", False, False), ("CAST(NULL AS VARCHAR)", False, False), ("'Abrogat' || p_name", True, False),
]


@add("repealed_texts", "SELECT p_partkey AS id, " + _case("p_partkey", [str(a).lower() for _, a, _ in _REPEALS]) + " AS repealed, "
     + _case("p_partkey", [str(b).lower() for _, _, b in _REPEALS]) + " AS repealed_whole FROM part")
def repealed_texts(spark, d):
    """F11, articles and paragraphs."""
    text = _pick([F.expr(t.replace("VARCHAR", "STRING")) for t, _, _ in _REPEALS], F.col("p_partkey"))
    p = S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("t"))
    return p.select("id", X.is_abrogated(F.col("t")).alias("repealed"), X.is_abrogated_paragraph(F.col("t")).alias("repealed_whole"))


_LABELS = [
    ("' (' || p_size || ')  ' || p_name", "'(' || p_size || ')'", "p_name"),
    ("'  ' || p_name || ' '", "''", "'  ' || p_name || ' '"),
    ("'  ' || p_name", "'a)'", "p_name"),
    ("'a) ' || p_name", "'a)'", "p_name"),
    ("'  ' || p_name", "CAST(NULL AS VARCHAR)", "'  ' || p_name"),
    ("''", "'a)'", "''"),
]


@add("unlabelled_texts", "SELECT p_partkey AS id, " + _case("p_partkey", [c for *_, c in _LABELS]) + " AS unlabelled FROM part")
def unlabelled_texts(spark, d):
    """X20."""
    k = F.col("p_partkey")
    text, label = (_pick([F.expr(f[i].replace("VARCHAR", "STRING")) for f in _LABELS], k) for i in (0, 1))
    return S.load(spark, d, "part").select(k.alias("id"), X.strip_label(text, label).alias("unlabelled"))


_KINDS = [*I.KIND_CODES.items(), ("lege", "other"), ("", "other")]
_STATES = [*I.STATE_CODES.items(), ("X", "actual")]


@add("code_labels", f"""SELECT p_partkey AS id, k.label AS kind, s.label AS state, CASE p_partkey % 4 WHEN 0 THEN '' ELSE p_partkey || '/' || (1990 + p_size) END AS law
 FROM part JOIN (VALUES {_values((i, c, n) for i, (c, n) in enumerate(_KINDS))}) k(i, code, label) ON k.i = p_partkey % {len(_KINDS)}
 JOIN (VALUES {_values((i, c, n) for i, (c, n) in enumerate(_STATES))}) s(i, code, label) ON s.i = p_partkey % {len(_STATES)}""")
def code_labels(spark, d):
    """X18 for every code, X23 in free text."""
    k, number = F.col("p_partkey"), F.concat(F.col("p_partkey").cast("string"), F.lit("/"), (F.col("p_size") + 1990).cast("string"))
    text = _pick([F.concat(F.lit("fără "), "p_name"), F.concat(F.lit("Legea "), number, F.lit(" și 7/1999")), number, F.concat(F.lit("OG nr."), number, F.lit("x"))], k)
    kind, state = (F.element_at(F.array(*[F.lit(c) for c, _ in codes]), (k % len(codes) + 1).cast("int")) for codes in (_KINDS, _STATES))
    return S.load(spark, d, "part").select(k.alias("id"), I.kind_label(kind).alias("kind"), I.state_label(state).alias("state"), I.law_key(text).alias("law"))


_CLASSES = [("'((' || p_size || '))'", "republished"), ("'(' || p_size || ')'", "numbered"), ("'a^' || p_size || ')'", "lettered"), ("'b)'", "lettered"), ("'- ' || p_name", "bullet"), ("'•'", "bullet"), ("p_name", "plain"), ("' '", "plain"), ("CAST(NULL AS VARCHAR)", "plain"), ("'A)'", "plain")]
_ITEMS = [
    ("'Se aprobă: ... 1. ' || p_name || ';... 2^1. Abrogat. ... 3. ' || p_size", "'|Se aprobă:|false;1.|' || p_name || ';|false;2^1.|Abrogat.|true;3.|' || p_size || '|false'"),
    ("p_name", "'|' || p_name || '|false'"),
    ("' ... 4. eliminată (la 01-02-2020, x)'", "'4.|eliminată (la 01-02-2020, x)|true'"),
    ("p_name || ' ...5 fără punct'", "'|' || p_name || ' ...5 fără punct|false'"),
]


@add("paragraph_items", "SELECT p_partkey AS id, " + _case("p_partkey", [f"'{c}'" for _, c in _CLASSES]) + " AS class, " + _case("p_partkey", [b for _, b in _ITEMS]) + " AS items, "
     + "CASE WHEN p_partkey % 3 = 0 AND length(p_name) <= 120 THEN p_name ELSE '-' END AS title FROM part")
def paragraph_items(spark, d):
    """Label classes, numbered items and marginal titles."""
    k = F.col("p_partkey")
    label = _pick([F.expr(a.replace("VARCHAR", "STRING")) for a, _ in _CLASSES], k)
    items = G.numbered_items(_pick([F.expr(a) for a, _ in _ITEMS], k))
    line = F.array_join(F.transform(items, lambda i: F.concat(F.coalesce(i["label"], F.lit("")), F.lit("|"), i["text"], F.lit("|"), i["repealed"].cast("string"))), ";")
    title = G.marginal_title(F.when(k % 3 == 1, "(1)"), F.col("p_name"), F.when(k % 3 == 2, 1).otherwise(2), F.lit(0))
    return S.load(spark, d, "part").select(k.alias("id"), G.label_class(label).alias("class"), line.alias("items"), F.coalesce(title, F.lit("-")).alias("title"))


_PARTS = [
    ("p_name", "'plain:' || p_name"),
    ("p_name || ' (la 01-02-2020, Articolul ' || p_size || ' din 2019) a fost (x 2020). Rest'", "'plain:' || p_name || ' |change:(la 01-02-2020, Articolul ' || p_size || ' din 2019) a fost (x 2020).|plain: Rest'"),
    ("'Notă: ' || p_name || '  Nota... doua'", "'remark:Notă: ' || p_name || '|remark:Nota... doua'"),
    ("p_name || '(la 01-02-2020, fără an'", "'plain:' || p_name || '|change:(la 01-02-2020, fără an'"),
    ("'Nota: (la 01-02-2020, x 2020) ' || p_size", "'remark:Nota: (la 01-02-2020, x 2020) ' || p_size"),
    ("'(la 01-02-2020, x 2020)Notă. ' || p_name || ' '", "'change:(la 01-02-2020, x 2020)|remark:Notă. ' || p_name"),
]


@add("note_segments", "SELECT p_partkey AS id, " + _case("p_partkey", [b for _, b in _PARTS]) + " AS segments FROM part")
def note_segments(spark, d):
    """Plain text, change notes and remarks."""
    found = G.note_segments(_pick([F.expr(a) for a, _ in _PARTS], F.col("p_partkey")))
    p = S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), found.alias("s"))
    return p.select("id", F.array_join(F.transform("s", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "|").alias("segments"))
