"""Text columns: folding, tokens, cleaning, note and query parsing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one ASCII-like base letter plus marks."""
    src, dst = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        if letter != letter.lower():
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(base) == 1 and base != letter:
            src.append(letter)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()

TOKEN = r"[\p{L}\p{N}]+"
# Letters a query word may hold.
QUERY_WORD = "[a-zA-ZăîâșțĂÎÂȘȚ]{3,}"


def fold(col: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col), FOLD_FROM, FOLD_TO)


def tokens(col: Column) -> Column:
    """Search tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(TOKEN), 0)


def repair_letters(col: Column) -> Column:
    """Put back letters lost as '?', then turn cedilla forms into comma-below forms."""
    steps = [
        (r"(?U)(?<!\w)\?i(?!\w)", "și"),
        (r"(?U)(?<!\w)\?(?=[tT])", "Ș"),
        (r"(?U)(?<=\w)\?(?=[tT])", "ș"),
        (r"(?U)(?<!\w)\?(?=\w)", "Ț"),
        (r"(?U)(?<=\w)\?(?=\w)", "ț"),
        (r"\?", "ț"),
    ]
    fixed = col
    for pattern, letter in steps:
        fixed = F.regexp_replace(fixed, pattern, letter)
    return F.translate(F.when(F.contains(col, F.lit("?")), fixed).otherwise(col), "şŞţŢ", "șȘțȚ")


# Start and end of an inline change annotation, and how far from the start the end may lie.
NOTE_START = r"\(la \d{1,2}[-./]\d{1,2}[-./]\d{2,4}"
NOTE_END = r"(?i:MONITORUL\s+OFICIAL)[^)]*\)"
NOTE_REACH = 1500


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is read."""
    return F.transform(F.array(value), use)[0]


def strip_annotations(col: Column) -> Column:
    """Drop inline annotations, marker and closing bracket included, if they close within reach of
    their start; from the first that does not on, the text stays as it is. Blanks left behind are
    collapsed."""
    return _bound(col, _strip_annotations)


def _strip_annotations(col: Column) -> Column:
    parts = F.split(col, rf"(?={NOTE_START})")
    # at: where the part begins; gone: up to where notes are dropped; open: a note without an end was met
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        def seen(head: Column) -> Column:
            begins = (head > 0) & (state["at"] >= state["gone"]) & ~state["open"]
            reach = F.substring(col, state["at"] + head + 1, F.lit(NOTE_REACH))
            # NULL where no note begins: only there its end is looked for
            rest = F.when(begins, F.length(F.regexp_extract(reach, rf"^[\s\S]*?{NOTE_END}", 0)))
            return F.struct(head.alias("head"), rest.alias("rest"))

        def next_(note: Column) -> Column:
            gone = F.when(note["rest"] > 0, state["at"] + note["head"] + note["rest"]).otherwise(state["gone"])
            open_ = state["open"] | F.coalesce(note["rest"] == 0, F.lit(False))
            left = F.substring(part, F.greatest(F.lit(0), gone - state["at"]) + 1, F.length(part))
            return F.struct((state["at"] + F.length(part)).alias("at"), gone.alias("gone"), open_.alias("open"), F.concat(state["kept"], F.array(left)).alias("kept"))

        head = F.length(F.regexp_extract(part, f"^{NOTE_START}", 0))
        return _bound(_bound(head, seen), next_)

    out = F.aggregate(parts, start, step, lambda state: F.array_join(state["kept"], ""))
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r" +([.,;:])", "$1")
    return F.when(F.length(col) == 0, col).otherwise(strip_space(out))


def strip_space(col: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(col, r"^(?U:\s+)|(?U:\s+)$", "")


# Label forms inside a note subject, and the six phrasings in order.
_LABEL = r"[A-Za-z0-9]+(?:\^[A-Za-z0-9]+)?"
_PAR = r"\([A-Za-z0-9]+(?:\^[A-Za-z0-9]+)?\)"
_LIT = rf"{_LABEL}\)"
SUBJECT_FORMS = (
    (rf"(?i)Litera\s+({_LIT})\s+a\s+alineatului\s+({_PAR})\s+al\s+articolului\s+({_LABEL})", (3, 2, 1)),
    (rf"(?i)Articolul\s+({_LABEL}),\s*alineatul\s+({_PAR}),\s*litera\s+({_LIT})", (1, 2, 3)),
    (rf"(?i)Alineatul\s+({_PAR})\s+al\s+articolului\s+({_LABEL})", (2, 1, None)),
    (rf"(?i)Articolul\s+({_LABEL}),\s*alineatul\s+({_PAR})", (1, 2, None)),
    (rf"(?i)^\s*Articolul\s+({_LABEL})\s*$", (1, None, None)),
    (rf"(?i)articolului\s+({_LABEL})", (1, None, None)),
)


def group(col: Column, pattern: str, idx: int | None) -> Column:
    """A regexp group, NULL where the pattern does not match or the group is empty."""
    if idx is None:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(col, pattern, idx), F.lit(""))


def parse_subject(col: Column) -> Column:
    """Note subject to struct(article, paragraph, subparagraph); first phrasing that fits wins."""
    s = strip_space(col)
    out = None
    for pattern, (art, par, sub) in reversed(SUBJECT_FORMS):
        hit = F.struct(
            group(s, pattern, art).alias("article"),
            group(s, pattern, par).alias("paragraph"),
            group(s, pattern, sub).alias("subparagraph"),
        )
        none = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("article", "paragraph", "subparagraph")])
        out = F.when(s.rlike(pattern), hit).otherwise(none if out is None else out)
    return out


# The three ways a repealed article starts.
ABROGATED = (r"^\s*\(?\s*[Aa]brogat", r"^\s*\(?\s*[Aa]brogat[ăa]\)", r"^\s*[Aa]rt\.\s*\d+.*[Aa]brogat")
ABROGATED_WHOLE = r"^\s*\(?\s*[Aa]brogat[ăa]?\s*\)?\.?\s*$"


def is_abrogated(col: Column) -> Column:
    """repealed, judged on the first 200 characters."""
    head = F.substring(F.coalesce(col, F.lit("")), 1, 200)
    return head.rlike(ABROGATED[0]) | head.rlike(ABROGATED[1]) | head.rlike(ABROGATED[2])


def is_abrogated_paragraph(col: Column) -> Column:
    """F11, paragraph form: nothing but the word."""
    return F.coalesce(col, F.lit("")).rlike(ABROGATED_WHOLE)


def effective_text(clean: Column, raw: Column) -> Column:
    """Cleaned text where it was stored, else the raw text."""
    return F.coalesce(clean, raw, F.lit(""))


def strip_label(text: Column, label: Column) -> Column:
    """Text without its own label in front."""
    head = F.ltrim(text)
    cut = F.ltrim(F.substring(head, F.length(label) + 1, F.length(head)))
    has = (F.coalesce(label, F.lit("")) != "") & F.startswith(head, label)
    return F.when((F.coalesce(label, F.lit("")) == "") | (text == ""), text).when(has, cut).otherwise(head)


# Words that carry no meaning in a search.
STOP_WORDS = (
    "de", "din", "si", "și", "la", "cu", "nr", "al", "ale", "a", "in", "în",
    "pe", "prin", "pentru", "sau", "care", "se", "le", "o", "un", "unei",
    "unui", "unor", "cel", "cea", "cei", "cele", "mai", "nu", "ca", "dar",
    "este", "sunt", "fie", "ori", "precum", "privind", "referitoare",
)


def words(col: Column) -> Column:
    """Split at white space, no empty words."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def significant(col: Column, most: int | None = 4) -> Column:
    """The first words that are neither stop-words nor one letter long."""
    kept = F.filter(words(F.lower(col)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 2))
    return F.slice(kept, 1, most) if most else kept


# Document type word to catalogue code.
TYPE_CODES = {
    "lege": "1", "legea": "1",
    "hotarare": "2", "hotararea": "2", "hg": "2",
    "decret": "3", "decretul": "3",
    "ordin": "5", "ordinul": "5",
    "ordonanta": "13", "ordonanța": "13", "og": "13",
    "decizie": "17", "decizia": "17",
    "oug": "18",
}
# The type words a numbered query may start with.
_TYPE_WORD = (
    r"legea?|oug|hg|og|ordin(?:ul)?|hotarare[a]?|decret(?:ul)?|ordona[nț](?:a|ța)?|decizie[a]?|codul?"
)
NUMBERED = rf"(?i)^({_TYPE_WORD})\s+(?:nr\.?\s*)?(\d+)(?:\s*[/-]\s*(\d{{4}}))?"
BARE_NUMBER = r"^(\d+)\s*[/-]\s*(\d{4})$"
TYPE_PREFIX = rf"(?i)^({_TYPE_WORD}|lege)\s+"


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small constant map; the default (NULL) where the key is missing."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), default if default is not None else F.lit(None))


def parse_query(col: Column) -> Column:
    """Search query to struct(title, doc_type, number)."""
    q = strip_space(col)
    number = F.regexp_extract(q, NUMBERED, 2)
    year = F.regexp_extract(q, NUMBERED, 3)
    numbered, bare = q.rlike(NUMBERED), q.rlike(BARE_NUMBER)
    return F.struct(
        F.when(numbered | bare, "").otherwise(q).alias("title"),
        F.when(numbered, lookup(TYPE_CODES, F.lower(F.regexp_extract(q, NUMBERED, 1)), F.lit(""))).otherwise("").alias("doc_type"),
        F.when(numbered, F.when(year != "", F.concat_ws("-", number, year)).otherwise(number))
        .when(bare, F.concat_ws("-", F.regexp_extract(q, BARE_NUMBER, 1), F.regexp_extract(q, BARE_NUMBER, 2)))
        .otherwise("")
        .alias("number"),
    )
