"""Licence sentences and rules."""

import pytest

from palimpsest.llm import licenses as L

MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
 */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

CASES = [
    (None, []), ("", []), ("no such words", []), ("the word licence alone", []),
    ("Text before.\nReleased under the MIT License.", ["MIT"]),
    ("no stop before\nLicensed under the Apache License, Version 2.0.\nand after", ["Apache-2.0"]),
    ("A. This work is licensed under the GNU General Public License, version 3. B.", ["GPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "All-Rights-Reserved"]),
    ("All rights reserved. All rights reserved.", ["All-Rights-Reserved"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under the Apache Licenses of old.", []),
    ("x " * 100000 + "\nReleased under the MIT License.", ["MIT"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_notices(text, want):
    assert L.apply_rules([n for _, n in L.recognise(text or "")]) == want


def test_whole_texts():
    assert L.apply_rules([n for _, n in L.recognise(MIT)]) == ["MIT"]
    assert [n for _, n in L.recognise(MIT)] == ["mit-permission", "mit-notice", "mit-no-warranty"]
    assert L.apply_rules([n for _, n in L.recognise(APACHE)]) == ["Apache-2.0"]
    assert L.apply_rules([n for _, n in L.recognise(APACHE + "\n\n" + MIT)]) == ["Apache-2.0", "MIT"]


def test_rules_take_the_longest_and_keep_order():
    bsd3 = ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]
    assert L.apply_rules(["mit-short", *bsd3, "gpl-3-short"]) == ["MIT", "BSD-3-Clause", "GPL-3.0"]
    assert L.apply_rules(bsd3[:3] + bsd3[4:]) == ["BSD-2-Clause"]
    assert L.apply_rules(bsd3[::-1]) == [] and L.apply_rules([]) == []


def test_each_known_sentence_has_a_key_word_and_a_rule():
    for name, pattern in L.SENTENCES.items():
        assert any(w in pattern for w in L.KEY_WORDS) or name in ("gpl-no-warranty",), name
    assert {n for _, rule in L.RULES for n in rule} <= set(L.SENTENCES)


def test_rows(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id or 0, r.licenses) for r in L.scan(docs).collect())
    assert got == [(i, w) for i, (_, w) in enumerate(CASES)]
    assert L.scan(docs.limit(0)).collect() == []


def test_query_against_plain_search(spark):
    from palimpsest.llm.queries import REGISTRY

    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "All-Rights-Reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r.licenses for r in REGISTRY.queries["op8_licenses"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs) and any(got.values())
    for row in docs:
        found = sorted((row.text.find(x), name) for x, name in lines.items() if x in (row.text or ""))
        assert got[row.doc_id] == ",".join(name for _, name in found)


#: Notices in other words than the tables'.
USUAL = {
    "This project is licensed under the MIT License.": ["MIT"],
    "This file is licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "This project is licensed under the MIT License - see the [LICENSE](LICENSE.md) file for details.": ["MIT"],
    "The source code in this folder is released under the terms of the MIT licence": ["MIT"],
    "It is made available under the Apache 2.0 license.": ["Apache-2.0"],
    "All files are distributed under the terms of the GNU GPL v3.": ["GPL-3.0"],
    "This program is licensed under GPLv3+.": ["GPL-3.0-or-later"],
    "This library is licensed under the GNU General Public License, version 2 or (at your option) any later version.": ["GPL-2.0-or-later"],
    "The documentation is licensed under a\nCreative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    "These texts are published under CC BY 4.0.": ["CC-BY-4.0"],
    "This work is licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
    "// This package is licensed under the BSD 3-Clause License.": ["BSD-3-Clause"],
    "The data set has been placed in the public domain.": ["Public-Domain"],
    "This project is not licensed under the MIT License.": [],
    "This is not to say that it is licensed under the MIT License.": [],
    "Licensed under the MIT Licenses of old.": [],
    "The river is under the bridge.": [],
}


@pytest.mark.parametrize("text", USUAL)
def test_usual_words(text):
    assert L.apply_rules([n for _, n in L.recognise(text)]) == USUAL[text]


@pytest.mark.parametrize("key_word", ["zlib", None])
def test_sentences_and_rules_are_tables(spark, key_word):
    docs = spark.createDataFrame([(1, "Use follows the zlib terms."), (2, "Released under the MIT License.")], "doc_id long, text string")
    sentences = L.known_sentences(spark).unionByName(spark.createDataFrame([("zlib-short", "use follows the zlib terms", key_word)], "sentence string, pattern string, key_word string"))
    rules = L.known_rules(spark).unionByName(spark.createDataFrame([(99, "Zlib", ["zlib-short"])], "place int, license string, sentences array<string>"))
    assert {r.doc_id: r.licenses for r in L.scan(docs, sentences=sentences, rules=rules).collect()} == {1: ["Zlib"], 2: ["MIT"]}
    assert {r.doc_id: r.licenses for r in L.scan(docs).collect()} == {1: [], 2: ["MIT"]}


@pytest.mark.parametrize("text,want", [
    ("This software is in the public\n * domain.", ["Public-Domain"]),
    ("All rights\n * reserved.", ["All-Rights-Reserved"]),
    ("All  rights  reserved.", ["All-Rights-Reserved"]),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, " + "word " * 2000, ["mit-no-warranty"]),
    ("Copyright " + "word " * 2000 + "all rights reserved", ["All-Rights-Reserved"]),
    ("word " * 2000 + "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ["GPL-3.0-or-later"]),
    ("word " * 2000 + "this software is released under the MIT License " + "word " * 2000 + "all rights reserved " + "word " * 9, ["MIT", "All-Rights-Reserved"]),
    ("word " * 2000 + "neither the name of " + "word " * 2000 + "may be used to endorse or promote products derived from this software without specific prior written permission", ["bsd-endorse"]),
    ("word " * 2000 + "not licensed under the MIT License", []),
])
def test_parted_words_and_long_stretches(text, want):
    names = [n for _, n in L.recognise(text)]
    assert (L.apply_rules(names) or names) == want


def test_places_inside_long_stretches():
    text = "İ " + "word " * 2000 + "released under the MIT License, then"
    assert L.recognise(text) == [(text.index(", then"), "mit-short")]
    assert L.recognise("neither the name of " * 20000 + "copyright " * 20000) == []
