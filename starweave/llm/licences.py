"""Licence scan: canonical digests of entire texts, hash-joined to the digests of known licences.

A text is made canonical: A-Z lower-cased, copyright lines dropped, every run of ASCII punctuation and white space one
blank, equivalent spellings one. Its SHA-256 digest meets the digests of the known texts in an equality join. Besides
the entire text each of its lines is looked up, for notices that stand on a line of their own, however much punctuation
and white space is around them; a line is tried if its canonical form is as long as that of some known notice.

The known side is broadcast only while its size, which is checked, stays within a limit. A hot digest (one licence in a
third of all documents) is no hot key then; in the shuffled form Spark splits the partitions of the inner join.

Cases: null and empty texts, and those with nothing left, have the digest of the empty text and never match; known
texts that become empty are left out; known texts with equal canonical forms share the smallest name; repeated rows and
ids get a row each (an id's notices are those of all its rows); extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starweave.llm.common import BROADCAST_LIMIT, LOWER, UPPER, ascii_lower, materialize
from starweave.llm.licence_digests import DIGESTS

# Spellings that count as equal (each second form is replaced by the first).
SPELLINGS = (("license", "licence"), ("acknowledgment", "acknowledgement"), ("authorize", "authorise"),
             ("organization", "organisation"), ("favor", "favour"), ("noninfringement", "non infringement"),
             ("merchantability", "merchantibility"), ("copyright holder", "copyright owner"), ("https", "http"))
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LINE_BREAKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"  # all of them but the line feed

# Texts of short licences and of notices that stand for one.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0")),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
      for end in ("", "-only", "-or-later")),
)
NOTICE_CHARS = 200  # known texts with a canonical form of up to this length are notices, looked up line by line


def _spaced(text: Column, breaks: str) -> Column:
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, breaks, " ")
    for to, spelled in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(to))
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text; null becomes empty."""
    return F.btrim(_spaced(text, BREAKS))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, in order: no step reaches past a line, so all are made in one go."""
    return F.transform(F.split(_spaced(text, LINE_BREAKS), "\n", -1), lambda x: F.btrim(x))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN,
                  digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(known_digest, licence) of the known texts, and of those of which only the digest is known."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    rows = rows.select("licence", canonical(F.col("text")).alias("c")).filter(F.col("c") != "")
    rows = rows.select("licence", F.sha2("c", 256).alias("known_digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "licence string, known_digest string"))
    return rows.groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN,
         digests: tuple[tuple[str, str], ...] = DIGESTS, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per document: its id, digest, licence (of the entire text, or null) and notices (sorted names of the
    licences that lines name, comma-joined, empty if none)."""
    spark = docs.sparkSession
    table = materialize(known_digests(spark, known, digests), "known-licences")
    table = F.broadcast(table) if table.count() * 128 <= limit else table
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    whole = narrow.select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    whole = whole.join(table, F.col("digest") == F.col("known_digest"), "left").drop("known_digest")

    long = F.char_length(canonical(F.col("text"))).alias("n")
    lengths = [r["n"] for r in spark.createDataFrame(list(known), "licence string, text string").select(long).distinct().collect()]
    lengths = [n for n in lengths if 0 < n <= NOTICE_CHARS]
    possible = lambda x: F.char_length(x).isin(lengths)
    lines = narrow.select("id", F.explode(F.filter(canonical_lines(F.col("text")), possible)).alias("line"))
    hits = lines.join(table, F.sha2("line", 256) == F.col("known_digest"))
    notices = hits.groupBy(F.col("id").alias("n_id")).agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    out = whole.join(notices, F.col("id").eqNullSafe(F.col("n_id")), "left")
    return out.select(F.col("id").alias(id_col), "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> str:
    """DuckDB SQL of ``scan`` over ``documents``: the same tables, the same rule for lines."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINE)}, '', 'g')"
        x = f"regexp_replace({x}, {quote(BREAKS)}, ' ', 'g')"
        for to, spelled in SPELLINGS:
            x = f"replace({x}, {quote(spelled)}, {quote(to)})"
        return f"trim({x}, ' ')"

    values = lambda rows: ", ".join(f"({quote(name)}, {quote(text)})" for name, text in rows)
    return f"""
WITH texts AS (SELECT n, {canon('t')} AS c FROM (VALUES {values(known)}) v(n, t)),
known AS (SELECT known_digest, min(n) AS licence FROM (
    SELECT sha256(c) AS known_digest, n FROM texts WHERE c <> '' UNION ALL SELECT d, n FROM (VALUES {values(digests)}) v(n, d)) GROUP BY 1),
lines AS (SELECT doc_id, {canon('line')} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
notices AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN known ON sha256(c) = known_digest
            WHERE length(c) IN (SELECT length(c) FROM texts WHERE length(c) BETWEEN 1 AND {NOTICE_CHARS}) GROUP BY 1)
SELECT x.doc_id, x.digest, k.licence, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, sha256({canon('text')}) AS digest FROM documents) x
LEFT JOIN known k ON x.digest = k.known_digest LEFT JOIN notices n ON x.doc_id = n.doc_id"""
