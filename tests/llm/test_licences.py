import re

import pytest

from gaugeworks.llm import licences as L

TEXTS = {name + str(i): text for i, (name, text) in enumerate(L.KNOWN)}


def scan(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: (r["license"], r["notices"]) for r in L.scan_licenses(docs, **settings).collect()}


def test_known_texts_in_other_guises(spark):
    mit = L.KNOWN[0][1]
    wrapped = mit.replace(" ", "\n   ").upper().replace('"', "“")
    dressed = mit.replace("<year> <copyright holders>", "2019-2021 Somebody GmbH & Co").replace("MIT License", "\t* MIT LICENCE *")
    twice = mit.replace("Copyright (c) <year> <copyright holders>", "Copyright 2001 A\nCopyright © 2002 B\n(c) 2003 C\nAll rights reserved.")
    got = scan(spark, [mit, dressed, twice, mit + " Not quite", mit.replace("free of charge", "for a fee"), wrapped])
    assert [got[i][0] for i in range(5)] == ["MIT", "MIT", "MIT", None, None]
    assert got[5][0] is None  # wrapped inside the copyright line, its holder stays behind


def test_every_known_text_is_found(spark):
    got = scan(spark, [text for _, text in L.KNOWN])
    assert [got[i][0] for i in range(len(L.KNOWN))] == [name for name, _ in L.KNOWN]


def test_notices_are_whole_lines(spark):
    got = scan(spark, [
        "Some text.\n  licensed under the apache licence, version 2.0\nMore. Released under the MIT License.",
        "Released under the MIT License.\nreleased under THE MIT license!\nThis work is licensed under the GNU GPL, v3.",
        "Released under the MIT License.",
    ])
    assert got == {0: (None, "Apache-2.0"), 1: (None, "GPL-3.0,MIT"), 2: ("MIT", "MIT")}


@pytest.mark.parametrize("spelling,usual", L.EQUIVALENTS)
def test_spellings_agree_even_side_by_side(spark, spelling, usual):
    df = spark.createDataFrame([(f"a {spelling} {spelling} b", f"a {usual} {usual} b")], "x string, y string")
    digests = df.select(*[L.canonical_digest(L.canonical_lines(L.F.col(c))) for c in "xy"]).first()
    assert digests[0] == digests[1]


def test_edge_cases(spark):
    rows = [
        (None, 1, "x"), ("", 2, None), (" \n!\n", None, "y"), ("word\n" * 60_000, 4, "z"), ("Copyright (c) 2020 A", 5, ""),
        ("Released under the MIT License.", 6, ""), ("Released under the MIT License.", 6, ""),
    ]
    docs = spark.createDataFrame(rows, "text string, doc_id long, license string")
    got = sorted(((r["id"] or 0, r["license"], r["notices"]) for r in L.scan_licenses(docs).collect()), key=str)
    assert got == [(0, None, ""), (1, None, ""), (2, None, ""), (4, None, ""), (5, None, ""), (6, "MIT", "MIT"), (6, "MIT", "MIT")]
    assert L.scan_licenses(docs.limit(0)).count() == 0
    assert {r["license"] for r in L.scan_licenses(docs, known=[]).collect()} == {None}
    plan = L.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_table_names_the_usual_licences(spark):
    """Every text and notice of the package's table leads to its own licence."""
    known = list(L.known_texts())
    whole = {name for name, text in known if len(text) > 500}
    assert whole >= {
        "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "Apache-2.0", "GPL-1.0",
        "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "GFDL-1.2", "GFDL-1.3", "CC0-1.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "OFL-1.1", "Unicode-3.0",
    }
    got = scan(spark, [text for _, text in known])
    assert {i: got[i][0] for i in got} == {i: name for i, (name, _) in enumerate(known)}


def test_variants_and_notices_of_other_licences(spark):
    mit = L.KNOWN[0][1].split("\n", 1)[1]
    third = """Copyright 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + L.KNOWN[3][1][L.KNOWN[3][1].index("THIS SOFTWARE"):]
    got = scan(spark, [
        mit, third, "Text.\nLicensed under the GNU General Public License, version 2.\n", "Text.\n# SPDX-License-Identifier: BSD-3-Clause",
        "This work is licensed under CC BY 4.0.", "Released under the Mozilla Public Licence, v. 2.0\nText", "Licensed under AGPL-3.0\nText",
        third.replace("without specific", "with no"), "The GPL is one licence, MIT another.",
    ])
    assert got == {
        0: ("MIT", ""), 1: ("BSD-3-Clause", ""), 2: (None, "GPL-2.0"), 3: (None, "BSD-3-Clause"), 4: ("CC-BY-4.0", "CC-BY-4.0"),
        5: (None, "MPL-2.0"), 6: (None, "AGPL-3.0"), 7: (None, ""), 8: (None, ""),
    }


def test_no_line_is_dropped_but_statements_of_copyright(spark):
    """Every line with words of every known text keeps words, so any change to it shows."""
    states = re.compile(r"[^a-z0-9]*(copyright *(\(c\)|©|[0-9<\[{])|\(c\) *(copyright|[0-9<\[{])|©|all rights reserved)", re.I)
    texts = sorted({text for _, text in L.ALL_KNOWN})
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    kept = df.select("t", L.F.filter(L.canonical_lines(L.F.col("t")), lambda line: line != "").alias("lines"))
    for row in kept.collect():
        lines = [line for line in row["t"].split("\n") if re.search(r"[A-Za-z0-9\x80-\U0010ffff]", line.strip(" " + L._MARKS))]
        assert len(row["lines"]) == sum(not states.match(line) for line in lines)


def test_altered_items_of_clause_lists_are_not_the_licence(spark):
    found = {}
    for name, text in L.ALL_KNOWN:
        item = re.search(r"\n[ \t]*\(c\) [A-Za-z][^\n]*", text)
        if item and name not in found:
            found[name] = text, text.replace(item[0], "\n(c) You must pay one thousand dollars for every copy that You make.")
    assert {"Apache-2.0", "MPL-2.0"} <= set(found)
    got = scan(spark, [text for pair in found.values() for text in pair])
    assert [got[i][0] for i in range(len(got))] == [x for name in found for x in (name, None)]
