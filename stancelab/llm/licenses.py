"""Licence scans by canonical digest lookup.

A text's lines are brought to a canonical form: lower case, equivalent spellings made one,
punctuation dropped, white space collapsed, copyright notices and empty lines removed.  The digest of
an entire canonical text - the whole document, or one of its lines, as notices stand alone in a
line - is looked up among the digests of known licence texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS

#: Spellings that licence matching treats as equal (the second form is kept).
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("modelling", "modeling"), ("noncommercial", "non-commercial"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("sub-license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("https:", "http:"),
)

#: Licence texts and the usual one-line notices.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)

_BSD = dict((i, t) for i, t in KNOWN if "\n\n" in t)["BSD-2-Clause"]
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED"""
#: Whole texts by id, without a title; a document may begin with one of the usual titles or with none.
UNTITLED = {
    "MIT": next(t for i, t in KNOWN if i == "MIT" and "\n\n" in t).split("\n", 1)[1],
    "ISC": next(t for i, t in KNOWN if i == "ISC").split("\n", 1)[1],
    "BSD-2-Clause": _BSD, "BSD-3-Clause": _BSD.replace("THIS SOFTWARE IS PROVIDED", _THIRD),
}
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("", "ISC License", "The ISC License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License"),
}
#: Titled whole texts, their conditions numbered or marked with a star.
WHOLE = tuple((i, f"{title}\n\n{re.sub(r'(?m)^[123][.] ', mark, text)}") for i, text in UNTITLED.items()
              for title in TITLES[i] for mark in ((r"\g<0>", "* ") if i.startswith("BSD") else (r"\g<0>",)))

#: Rows of a licence list that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 50_000

#: Words that begin terms, so a copyright notice beside them ends there.
TERMS = (
    "licen[sc]ed", "released", "distributed", "permission", "redistributions?", "everyone", "this", "these", "the above",
    "the software", "use of", "you may", "subject to", "spdx", "(?:made )?available under", "published under",
)

_YEAR = r"(?:19|20)[0-9]{2}(?![0-9])"
_BLANK = r"(?:<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|yyyy|year(?![a-z]))"
_MARKS = r"[\x00-\x20!-'*-/:-@\[-`{-~]*"
_RESERVED = r"all rights reserved"
#: A notice ends with its line, at "all rights reserved", before terms, or with its sentence; initials
#: and the abbreviations of companies end none.
_END = (rf"(?:$|(?=[\s.,;]*{_RESERVED})|(?=\s(?:{'|'.join(TERMS)})(?![a-z]))"
        r"|(?<=[a-z0-9>)\]]{3}[.;])(?<![ ,.](?:inc|ltd|corp|llc|gmbh|bros|assn|univ|dept)\.)(?=\s))")
#: Notices that name the owner, not the terms.  Behind other words only the sure forms count, as a
#: bare year may stand in prose; "copyright" before any other word is a part of the terms.
COPYRIGHT_NOTICE = (
    rf"(?s)(?:^{_MARKS}(?:copyright[\s:,]*(?:\(c\)|©|{_YEAR}|{_BLANK})|©|\(c\)\s*(?:{_YEAR}|{_BLANK}))"
    rf"|(?<![\p{{L}}\p{{N}}])copyright\s*(?:\(c\)|©|{_BLANK}))"
    rf".*?{_END}(?:[\s.,;]*{_RESERVED}(?![a-z])[.!]?)?")
RESERVED_LINE = rf"^{_MARKS}{_RESERVED}{_MARKS}$"


def canonical_lines(text: Column) -> Column:
    """Canonical non-empty lines of a text (null: none)."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\r\n|\n|\r")

    def terms(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, COPYRIGHT_NOTICE, " "), RESERVED_LINE, " ")
        return F.when(x.rlike(rf"copyright|©|\(c\)|{_RESERVED}"), bare).otherwise(x)

    def canon(x: Column) -> Column:
        spelt = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, terms(x))
        return F.trim(F.regexp_replace(F.regexp_replace(spelt, r"[!-/:-@\[-`{-~]", " "), r"[ \t\x0B\f]+", " "))

    return F.filter(F.transform(lines, canon), lambda x: x != "")


def whole(lines: Column) -> Column:
    """The entire canonical text: its lines joined by one space; spellings of two words may lie over a line's end."""
    spaced = [pair for pair in SPELLINGS if " " in pair[0]]
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), spaced, F.array_join(lines, " "))


def known_digests(spark: SparkSession, known=KNOWN + WHOLE, digests=DIGESTS) -> DataFrame:
    """(digest, license_id), one row per canonical text; a text under two ids keeps the smaller.

    known: (license_id, text); digests: (license_id, digest) of texts too long to be listed here.
    """
    table = spark.createDataFrame(list(known), "license_id string, text string")
    listed = table.select("license_id", F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"))
    told = spark.createDataFrame(list(digests), "license_id string, digest string")
    return listed.unionByName(told).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, text_license, line_licenses), a row for each row of ``docs``.

    docs: doc_id, text; other columns are not read.  known: (digest, license_id); broadcast only if
    it has at most ``BROADCAST_ROWS`` rows, else the planner chooses.
    text_digest: SHA-256 of the entire canonical text.  text_license: the licence with that digest,
    else null.  line_licenses: sorted distinct licences whose entire text is one of the lines.

    Null, empty and punctuation-only texts have the digest of the empty text and no licence.
    Null and repeated ids and repeated rows give a row each; a digest listed under two ids counts
    as the smaller.
    """
    table = known.where("digest IS NOT NULL AND license_id IS NOT NULL").groupBy("digest").agg(
        F.min("license_id").alias("license_id"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    lines = docs.select(F.col("doc_id"), canonical_lines(F.col("text").cast("string")).alias("lines")).select(
        "doc_id", F.sha2(whole(F.col("lines")), 256).alias("text_digest"), "lines")
    empty = F.sha2(F.lit(""), 256)
    units = lines.select("doc_id", "text_digest", F.posexplode(F.concat(
        F.array("text_digest"), F.transform("lines", lambda x: F.sha2(x, 256)))).alias("unit", "digest"))
    # whole texts stay, and the lines that are a licence; then a row for each row there was
    found = units.join(table, "digest", "left").where("unit = 0 OR license_id IS NOT NULL")
    own = F.when((F.col("unit") == 0) & (F.col("text_digest") != empty), F.col("license_id"))
    rows = found.groupBy("doc_id", "text_digest").agg(
        F.max(own).alias("text_license"),
        F.sort_array(F.collect_set(F.when(F.col("unit") > 0, F.col("license_id")))).alias("line_licenses"),
        F.count(F.when(F.col("unit") == 0, True)).alias("_rows"))
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_row", "_rows")
