"""Licence recognition by sentences and ordered rules.

A text is cut into sentences; each is normalised (lower case, runs of other characters than letters
and digits as one space, a comment's marks at its start left out) and looked up among the known
licence sentences, built in or given as a table. A short notice may say what it is about before the
licence's name and where to read more after it. A licence is found where the identifiers of a rule occur one after the other among
the recognised sentences; a longer rule is tried before a shorter one and uses its sentences up.
Recognised sentences that no rule uses are reported as they are.

Sentences are read twice: from single lines, and from paragraphs whose lines are joined, so that both
one-line notices and wrapped licence texts are met; a sentence read both ways counts once, at the place
where it ends. Null and empty texts have none. Texts are read whole, but those without any of the key
words, of which each known sentence has one, are not cut. Sentences may be of any length; inside of
very long ones, as texts without punctuation have, the known ones are looked for as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

#: What may stand before and after the name of a licence in a short notice.
_LEAD = r"((this|these|the|all|it)( (?!not |nor |no |if |unless |whether )[a-z0-9]+){0,8} (is|are|may be) |it is )?"
_UNDER = _LEAD + r"((dual|also|hereby|freely) )?(licensed|released|distributed|published|provided|offered|available|made available) under (the |an? )?((terms|conditions|terms and conditions) of (the |an? )?)?"
_SEE = r"( (please )?(see|refer to|read)( [a-z0-9]+){1,12})?"
_LATER = r"(\+| or( at your option)?( any)? (later|newer)( versions?)?)"


def _gpl(version: int, later: str) -> str:
    return rf"{_UNDER}(gnu )?(general public license( gnu gpl| gpl)?|gpl) ?(version )?v?{version}( 0)?{later}( licen[sc]e)?( gpl ?v?{version}( 0)?{later})?{_SEE}"


def _cc(short: str, long: str) -> str:
    return rf"{_UNDER}(cc {short}|creative commons {long})( international)? 4 0( international)?( public)?( licen[sc]e)?( cc {short} 4 0)?{_SEE}"


#: Identifiers and normalised sentences, as patterns over the whole sentence.
SENTENCES = {
    "apache-2-short": rf"{_UNDER}apache( software)?( licen[sc]e)?( version)? v?2( 0)?( licen[sc]e)?( the licen[sc]e)?{_SEE}",
    "apache-2-may-not": r"you may not use this file except in compliance with the license",
    "apache-2-copy": r"you may obtain a copy of the license at( http.*)?",
    "apache-2-as-is": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": r"see the license for the specific language governing permissions and limitations under the license",
    "mit-short": rf"{_UNDER}(mit|expat)( licen[sc]e)?( mit)?{_SEE}",
    "mit-permission": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-no-warranty": r"the software is provided as is without warranty of any kind express or implied .*",
    "bsd-redistribution": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": r"(3 )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": r"this software is provided by .* as is and any express or implied warranties .*",
    "bsd-3-short": rf"{_UNDER}(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)( new or revised)? licen[sc]e{_SEE}",
    "bsd-2-short": rf"{_UNDER}(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)( simplified)? licen[sc]e{_SEE}",
    "gpl-3-short": _gpl(3, "( only)?"),
    "gpl-2-short": _gpl(2, "( only)?"),
    "gpl-3-later-short": _gpl(3, _LATER),
    "gpl-2-later-short": _gpl(2, _LATER),
    "gpl-3-redistribute": r".* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-redistribute": r".* is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-no-warranty": r".* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": r"see the gnu general public license for more details",
    "cc-by-nc-4": _cc("by nc", "attribution non ?commercial"),
    "cc-by-4": _cc("by", "attribution"),
    "cc-by-sa-4": _cc("by sa", "attribution share ?alike"),
    "cc0": rf"({_UNDER}|{_LEAD}dedicated to the public domain under (the )?)(cc0|creative commons (cc0|zero))( v?1 0)?( universal)?( licen[sc]e| public domain dedication)?{_SEE}",
    "public-domain": r"(this|these|the|it)( (?!not |nor |no |if |unless |whether )[a-z0-9]+){0,8} (is|are|has been|have been) (in|(released|placed|dedicated) (in|into|to)) the public domain",
    "mpl-2": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-short": rf"{_UNDER}(mozilla public licen[sc]e|mpl)( version)? v?2 0{_SEE}",
    "all-rights": r"(copyright .* )?all rights (are )?reserved",
}

#: Licences and the identifiers that make them, in order.
RULES = (
    ("Apache-2.0", ("apache-2-short", "apache-2-may-not", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("Apache-2.0", ("apache-2-short",)),
    ("MIT", ("mit-permission", "mit-notice", "mit-no-warranty")),
    ("MIT", ("mit-short",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("GPL-3.0-or-later", ("gpl-3-redistribute", "gpl-no-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-3-redistribute",)),
    ("GPL-2.0-or-later", ("gpl-2-redistribute", "gpl-no-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-redistribute",)),
    ("GPL-3.0-or-later", ("gpl-3-later-short",)),
    ("GPL-2.0-or-later", ("gpl-2-later-short",)),
    ("GPL-3.0", ("gpl-3-short",)),
    ("GPL-2.0", ("gpl-2-short",)),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("BSD-2-Clause", ("bsd-2-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Public-Domain", ("public-domain",)),
    ("MPL-2.0", ("mpl-2",)),
    ("MPL-2.0", ("mpl-2-short",)),
    ("All-Rights-Reserved", ("all-rights",)),
)

#: Each known sentence has one of these; single words, as white space and comment marks may stand between two.
KEY_WORDS = ("licen", "under", "permission", "copyright", "redistribut", "warrant", "reserved", "domain", "cc0")

#: A longer stretch without a sentence's end is no sentence alone: known ones are also looked for inside it.
LONGEST = 4000

_WORDS = re.compile(r"[a-z0-9]+(?:(?<=[0-9])\+)?")
_OPEN = r"\.\*|\([^()]*\.\*[^()]*\)\?"
_END = re.compile(r"[.!?:;](?=\s|$)|[\"')\]](?<=[.!?][\"')\]])(?=\s|$)")
_COMMENT = re.compile(r"^[\s#/*;%!<>-]+", re.M)
_OTHER = re.compile(r"(?:[^a-z0-9+]|(?<![0-9])\+)+")  # a plus after a number says: or later


class Known:
    """Sentences by identifier, as compiled patterns, and the words of which a text must hold one to be
    cut (none: every text is)."""

    def __init__(self, sentences: Mapping[str, str], key_words: Sequence[str] = ()) -> None:
        self.patterns = [(name, re.compile(pattern)) for name, pattern in sentences.items()]
        self.key_words = tuple(w.lower() for w in key_words)
        self.inside = [(name, _pieces(pattern)) for name, pattern in sentences.items()]

    def worth(self, low: str) -> bool:
        return not self.key_words or any(w in low for w in self.key_words)

    def name(self, sentence: str) -> str | None:
        return next((name for name, pattern in self.patterns if pattern.fullmatch(sentence)), None)

    def search(self, raw: str) -> list[tuple[int, int, str]]:
        """Where known sentences stand inside a text; of those that overlap the first, then the longest."""
        low = raw.lower()
        if len(low) != len(raw):  # a few letters become two
            low = "".join(c.lower()[0] for c in raw)
        words = [m.span() for m in _WORDS.finditer(low)]
        sentence, begins, ends, size = [], [], [], 0
        for begin, end in words:
            sentence.append(low[begin:end])
            begins.append(size)
            ends.append(size + end - begin)
            size += end - begin + 1
        joined, found = " ".join(sentence), []
        for name, pieces in self.inside:
            at = 0
            while (span := _span(joined, pieces, at)) is not None:
                found.append((words[bisect_left(begins, span[0])][0], words[bisect_left(ends, span[1])][1], name))
                at = max(span[1], span[0] + 1)
        out: list[tuple[int, int, str]] = []
        for begin, end, name in sorted(found, key=lambda f: (f[0], -f[1])):
            if not out or begin >= out[-1][1]:
                out.append((begin, end, name))
        return out


def _pieces(pattern: str) -> list[re.Pattern]:
    """A sentence's pattern without what stands open at its edges, parted where anything may stand between."""
    pattern = re.sub(rf"^(?:{_OPEN})|(?:{_OPEN})$", "", pattern)
    parts = re.split(r" ?\.\* ?", pattern)
    try:
        return [re.compile(rf"(?<![a-z0-9])(?<!not )(?:{p.strip()})(?![a-z0-9+])") for p in parts]
    except re.error:  # the parts are not patterns of their own
        return [re.compile(rf"(?<![a-z0-9])(?:{pattern})(?![a-z0-9+])")]


def _span(text: str, pieces: list[re.Pattern], at: int) -> tuple[int, int] | None:
    """The first place from ``at`` where the pieces stand one after the other."""
    begin = None
    for piece in pieces:
        m = piece.search(text, at)
        if m is None or m.end() == m.start():
            return None
        begin, at = m.start() if begin is None else begin, m.end()
    return begin, at


KNOWN = Known(SENTENCES, KEY_WORDS)


def known_sentences(spark: SparkSession) -> DataFrame:
    """The built-in sentences as ``(sentence, pattern, key_word)``, a start for one's own table."""
    rows = [(name, pattern, w) for name, pattern in SENTENCES.items() for w in KEY_WORDS]
    return spark.createDataFrame(rows, "sentence string, pattern string, key_word string")


def known_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as ``(place, license, sentences)``."""
    rows = [(k, licence, list(rule)) for k, (licence, rule) in enumerate(RULES)]
    return spark.createDataFrame(rows, "place int, license string, sentences array<string>")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def _cut(text: str, at: int) -> Iterator[tuple[int, str]]:
    """Sentences of a stretch of text that begins at ``at``, with their ends."""
    begin = 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        # a sentence may end at any of these marks, so that a list's heading or an initial does no harm
        yield at + begin, at + end, text[begin:end]
        begin = end


def recognise(text: str, known: Known = KNOWN) -> list[tuple[int, str]]:
    """Known sentences as ``(end, identifier)``, in order."""
    if not known.worth(text.lower()):
        return []
    found = []
    for stretch in re.finditer(r"[^\n]+", text):
        _look(stretch, found, 1, known)
    for stretch in re.finditer(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*", text):
        _look(stretch, found, 3, known)
    last: dict[str, list[int]] = {}
    out = []
    for begin, end, name in sorted(found):
        if name in last and begin < last[name][1]:  # read both ways
            last[name][1] = max(end, last[name][1])
        else:
            last[name] = place = [begin, end]
            out.append((place, name))
    return sorted((end, name) for (_, end), name in out)


def _look(stretch: re.Match, found: list, joined: int, known: Known) -> None:
    """Looks up the sentences of a stretch, and up to ``joined`` neighbours as one; what is found is not
    looked at again."""
    parts = list(_cut(stretch.group(), stretch.start()))
    k = 0
    while k < len(parts):
        begin, next_ = parts[k][0], k + 1
        for last in range(k, min(len(parts), k + joined)):
            raw = stretch.string[begin : parts[last][1]]
            if not known.worth(raw.lower()):
                continue
            sentence = normalise(_COMMENT.sub(" ", raw))
            name = known.name(sentence)
            if name:
                found.append((begin, begin + len(raw.rstrip()), name))
                next_ = last + 1
                break
            if last == k and len(raw) > LONGEST:
                found += [(begin + a, begin + b, name) for a, b, name in known.search(raw)]
        k = next_


def apply_rules(names: Sequence[str], rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> list[str]:
    """Licences of a sequence of identifiers, by where their first sentence stands; each once."""
    left, found = list(names), []
    for licence, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = 0
        while at + len(rule) <= len(left):
            if tuple(left[at : at + len(rule)]) == rule:
                found.append((at, licence))
                left[at : at + len(rule)] = [None] * len(rule)
            at += 1
    return list(dict.fromkeys(licence for _, licence in sorted(found)))


def _known_of(sentences: DataFrame | None) -> Known:
    if sentences is None:
        return KNOWN
    rows = sentences.select("sentence", "pattern", "key_word").collect()
    patterns = {r.sentence: r.pattern for r in rows}
    # one sentence without a key word has every text cut
    keyed = {r.sentence for r in rows if r.key_word}
    words = dict.fromkeys(r.key_word for r in rows if r.key_word)
    return Known(patterns, tuple(words) if keyed == set(patterns) else ())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Per row: ``(id, sentences, licenses)``; sentences are structs of their end and identifier.

    ``sentences`` and ``rules`` take the place of the built-in ones, in the form of ``known_sentences``
    and ``known_rules``; a sentence has a row for each key word of which its matches hold one, or one
    row with null if it has none. Among rules of one length the smaller ``place`` is tried first."""
    known = _known_of(sentences)
    ordered = RULES if rules is None else tuple((r.license, tuple(r.sentences)) for r in rules.orderBy("place").collect())
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    sentence = pa.list_(pa.struct([("end", pa.int64()), ("sentence", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [recognise(t, known) for t in batch.column("_text").to_pylist()]
            structs = pa.array([[{"end": e, "sentence": n} for e, n in f] for f in found], sentence)
            names = pa.array([apply_rules([n for _, n in f], ordered) for f in found], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(id_col), structs, names], names=[id_col, "sentences", "licenses"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, sentences array<struct<end: long, sentence: string>>, licenses array<string>")
