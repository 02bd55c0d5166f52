"""License scans: digests of canonical texts, hash-joined to those of known licences.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import json
import pkgutil
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

# Punctuation beyond ASCII that counts as a blank.
_MARKS = " «·»‐‑‒–—‘’“”•…"

# A line that states a copyright, not one that speaks of copyright notices or
# is item (c) of a list: a bare (c) needs a year, a placeholder or the word behind it.
_COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*(copyright|[0-9<\[{])|©|all rights reserved)[^\n]*"
)

# Spellings that count as the same, each a sequence of words.
EQUIVALENTS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
    ("gnu gpl", "gnu general public license"),
    ("v2", "version 2"),
    ("v3", "version 3"),
]

# A short list beside the package's table.
KNOWN = [
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def known_texts(data: str = "known_licences.json") -> Iterator[tuple[str, str]]:
    """Names and texts of the package's table of licences.

    A licence's texts are its bodies with each of its titles, endings and variants (values of
    the slots @0@, @1@ and so on); its notices are its names in each of the phrases.
    """
    listed = json.loads(pkgutil.get_data(__package__, data))
    for item in listed["licenses"]:
        for body in item["bodies"]:
            for title in item["titles"]:
                for ending in dict.fromkeys(item["endings"]):
                    whole = f"{title}\n{body}\n{ending}"
                    for values in item["variants"] or [[]]:
                        text = whole
                        for slot, value in enumerate(values):
                            text = text.replace(f"@{slot}@", value)
                        yield item["license"], text
        for name in item["names"]:
            for phrase in listed["phrases"]:
                yield item["license"], phrase.format(name)


ALL_KNOWN = [*KNOWN, *known_texts()]


def canonical_lines(text: Column) -> Column:
    """Lines of a text in canonical words: lower case (A-Z), no punctuation, no copyright
    lines, one spelling. A line without words is an empty string."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _LOWER + " " * len(_MARKS))
    stated = F.regexp_replace(lowered, _COPYRIGHT_LINE, "\n")
    # Words stand between two blanks on either side, so that neighbours can both be replaced.
    words = F.regexp_replace(stated, r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", "    ")
    spaced = F.concat(F.lit("  "), F.replace(words, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    respelled = spaced
    for spelling, usual in EQUIVALENTS:
        pair = (f"  {'    '.join(part.split())}  " for part in (spelling, usual))
        respelled = F.replace(respelled, *map(F.lit, pair))
    # Few texts hold any of these words; the others are spared a copy for each.
    firsts = "|".join(sorted({spelling.split()[0] for spelling, _ in EQUIVALENTS}))
    spaced = F.when(spaced.rlike(f"  (?:{firsts})  "), respelled).otherwise(spaced)
    return F.transform(F.split(spaced, "\n"), lambda line: F.trim(F.regexp_replace(line, " +", " ")))


def canonical_digest(lines: Column) -> Column:
    """SHA-256 of the canonical lines' words; line breaks count as blanks."""
    return F.sha2(F.array_join(F.filter(lines, lambda line: line != ""), " "), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = ALL_KNOWN) -> DataFrame:
    """Digests of known texts: digest and license, the first name for texts that agree."""
    listed = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(known)], "place int, license string, body string"
    )
    return listed.groupBy(canonical_digest(canonical_lines(F.col("body"))).alias("digest")).agg(
        F.min_by("license", "place").alias("license")
    )


def scan_licenses(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", known: Sequence[tuple[str, str]] = ALL_KNOWN
) -> DataFrame:
    """Licences of whole texts: id, text_digest, license, notices; one row per input row.

    `license` names the known text that a document's whole canonical text equals, null if
    none. `notices` is the sorted list, comma-separated, of known texts that whole lines of
    it equal, empty if none. Case, punctuation, white space, copyright lines and equivalent
    spellings make no difference; texts without words match nothing. The known digests, as
    many rows as the caller lists, are the broadcast side of the hash join for whole texts
    and a lookup table for lines, so documents are not shuffled. Null texts count as empty,
    null ids stay null, repeated rows are repeated, and an empty table gives an empty one.
    Other columns are left out.
    """
    names = known_digests(df.sparkSession, known)
    lookup = {row["digest"]: row["license"] for row in names.collect()}
    # One literal each, however many texts are known: a set that every line is looked up in, and
    # a map that is read for the lines found.
    listed = ", ".join(f"'{digest}'" for digest in sorted(lookup)) or "''"
    found_lines = F.expr(f"filter(lines, line -> sha2(line, 256) in ({listed}))")
    table_of_lines = F.from_json(F.lit(json.dumps(lookup)), "map<string, string>")
    read = df.select(F.col(f"`{id_column}`").alias("id"), canonical_lines(F.col(f"`{text}`")).alias("lines"))
    nothing = F.sha2(F.lit(""), 256)
    digested = read.select(
        "id",
        canonical_digest(F.col("lines")).alias("text_digest"),
        F.transform(found_lines, lambda line: F.element_at(table_of_lines, F.sha2(line, 256))).alias("hits"),
    )
    matched = digested.join(
        F.broadcast(names.where(F.col("digest") != nothing).withColumnRenamed("digest", "text_digest")), "text_digest", "left"
    )
    notices = F.array_sort(F.array_distinct(F.filter("hits", lambda hit: hit.isNotNull())))
    return matched.select("id", "text_digest", "license", F.array_join(notices, ",").alias("notices"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql(column: str) -> str:
    """The canonical lines in DuckDB's words."""
    sql = f"translate(coalesce({column}, ''), {_quoted(_UPPER + _MARKS)}, {_quoted(_LOWER + ' ' * len(_MARKS))})"
    pattern = _COPYRIGHT_LINE.replace("'", "''")
    sql = f"regexp_replace({sql}, '{pattern}', chr(10), 'g')"
    sql = f"regexp_replace({sql}, '[^a-z0-9\\n\\x{{80}}-\\x{{10FFFF}}]+', '    ', 'g')"
    sql = f"'  ' || replace({sql}, chr(10), '  ' || chr(10) || '  ') || '  '"
    for spelling, usual in EQUIVALENTS:
        before, after = (f"  {'    '.join(part.split())}  " for part in (spelling, usual))
        sql = f"replace({sql}, {_quoted(before)}, {_quoted(after)})"
    return f"list_transform(string_split({sql}, chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g')))"


_KNOWN_ROWS = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(KNOWN))
_TABLE = _quoted(pkgutil.get_data(__package__, "known_licences.json").decode())
_MOST_SLOTS = max(
    len(values) for item in json.loads(pkgutil.get_data(__package__, "known_licences.json"))["licenses"]
    for values in item["variants"] or [[]]
)


def _filled_sql(text: str) -> str:
    """A text with its slots filled from the list `filling`, null for those without slots."""
    for slot in range(_MOST_SLOTS):
        text = f"replace({text}, '@{slot}@', coalesce(filling[{slot + 1}], '@{slot}@'))"
    return text


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE = {
    "op9_license_scan": f"""
WITH whole_table AS (
  SELECT from_json({_TABLE}, '{{"licenses": [{{"license": "VARCHAR", "bodies": ["VARCHAR"], "titles": ["VARCHAR"],
    "endings": ["VARCHAR"], "variants": [["VARCHAR"]], "names": ["VARCHAR"]}}], "phrases": ["VARCHAR"]}}') AS t
), items AS (
  SELECT unnest(t.licenses) AS item, t.phrases AS phrases FROM whole_table
), bodies AS (
  SELECT item, unnest(item.bodies) AS body FROM items
), titled AS (
  SELECT item, unnest(item.titles) AS title, body FROM bodies
), ended AS (
  SELECT item, title || chr(10) || body || chr(10) || ending AS body
  FROM (SELECT item, title, body, unnest(item.endings) AS ending FROM titled)
), filled AS (
  SELECT item.license AS license, {_filled_sql('body')} AS body
  FROM (SELECT item, body, unnest(CASE WHEN len(item.variants) > 0 THEN item.variants ELSE [NULL] END) AS filling FROM ended)
), notices AS (
  SELECT license, replace(phrase, '{{}}', name) AS body
  FROM (SELECT license, name, unnest(phrases) AS phrase
        FROM (SELECT item.license AS license, unnest(item.names) AS name, phrases FROM items))
), short(place, license, body) AS (VALUES {_KNOWN_ROWS}),
listed AS (
  SELECT place, license, body FROM short
  UNION ALL SELECT 1000000, license, body FROM (SELECT DISTINCT license, body FROM filled UNION SELECT license, body FROM notices)
),
known AS (
  SELECT sha256(array_to_string(list_filter(lines, lambda l: l <> ''), ' ')) AS digest, min_by(license, place) AS license
  FROM (SELECT place, license, {_lines_sql('body')} AS lines FROM listed) GROUP BY 1
), read AS (
  SELECT doc_id, row_number() OVER () AS row_no, {_lines_sql('text')} AS lines FROM documents
), found AS (
  SELECT row_no, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT row_no, unnest(list_distinct(lines)) AS line FROM read) JOIN known ON sha256(line) = digest GROUP BY row_no
), whole AS (
  SELECT row_no, doc_id, sha256(array_to_string(list_filter(lines, lambda l: l <> ''), ' ')) AS text_digest FROM read
)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON text_digest = digest AND digest <> sha256('') LEFT JOIN found USING (row_no)""",
}
