"""Licence scan by canonical digests, in DataFrame operations.

A text is brought into canonical form: lower case, copyright lines left out, equivalent spellings made one,
punctuation and white space to single spaces.  The digest of the canonical form is looked up among the digests of
known licences and licence notices.  Two units of every document are looked up whole: the document itself, and each
of its lines (a notice usually stands on a line of its own).  The known side is the fixed list below with the
whole texts in `licence_texts`, so its broadcast has a fixed size; a caller's own table is broadcast only under a measured bound.

Defined cases: a null or empty text matches nothing; lines without canonical words match nothing; a licence that
stands twice in a document is listed once and counted twice; repeated documents are each returned; extra columns pass,
those named like a result are replaced.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidebar.llm.tables import carried, small_or_shuffled

#: Identifiers with the short texts and notices they are known by.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
            "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
            "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
            "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Title lines that may stand over a text without one of its own.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
          "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)")}
END = "END OF TERMS AND CONDITIONS"


def _full_texts():
    """Whole texts, also without the appendix after the terms where there is one."""
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        yield file.stem, text
        if END in text:
            yield file.stem, text[:text.index(END) + len(END)]


KNOWN = (*NOTICES, *((name, f"{title}\n{text}") for name, text in NOTICES if len(text) > 500 for title in TITLES[name]),
         *_full_texts())
#: Spellings that licence matching treats as one.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"),
    ("favour", "favor"), ("neighbouring", "neighboring"), ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("copyright owner", "copyright holder"),
)
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©)[^a-z]*[0-9(©].*$"
ALL_RIGHTS = r"^[^a-z0-9]*all rights reserved[^a-z0-9]*$"


def canonical_line(line: Column) -> Column:
    low = F.lower(line)
    out = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, ""), ALL_RIGHTS, "")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def canonical(text: Column) -> Column:
    """Canonical lines of a text, those without words left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)
    return F.filter(lines, lambda x: x != "")


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """licence, digest of the known texts (columns licence, text; the fixed list where none are given)."""
    texts = texts if texts is not None else spark.createDataFrame(KNOWN, "licence string, text string")
    return texts.select("licence", F.sha2(F.array_join(canonical(F.col("text")), " "), 256).alias("digest")).groupBy(
        "digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """`docs` with whole_licence (null: the whole text is none), licences (sorted) and n_notices (matching lines)."""
    digests = small_or_shuffled(known_digests(docs.sparkSession, known), F.lit(120))
    rows = docs.select(carried(docs, "whole_licence", "licences", "n_notices").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("k"),
                       canonical(F.col(text).cast("string")).alias("lines"))
    units = rows.select("id", "k", F.explode(F.concat(
        F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))),
        F.array(F.struct(F.lit(True).alias("whole"), F.array_join("lines", " ").alias("unit"))))).alias("u"))
    # repeated documents give the same matches; distinct keeps one set of each
    met = units.select("id", "k", "u.whole", F.sha2("u.unit", 256).alias("digest")).join(digests, "digest")
    copies = docs.groupBy(F.col(doc_id).alias("id"), F.xxhash64(text).alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    found = met.groupBy("id", "k").agg(
        F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"),
        F.array_sort(F.collect_set("licence")).alias("licences"),
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n_notices"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.k") == F.col("b.k"))
    found = found.alias("a").join(copies.alias("b"), same).select(
        "a.id", "a.k", "whole_licence", "licences", F.expr("n_notices div copies").alias("n_notices"))
    same = F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.k") == F.col("f.k"))
    return rows.drop("lines").alias("r").join(found.alias("f"), same, "left").select(
        "row.*", "whole_licence", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
