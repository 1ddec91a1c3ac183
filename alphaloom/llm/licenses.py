"""Licence scans by canonical digests.

A text is made canonical - lower case, copyright lines left out, equivalent spellings unified,
punctuation and white space collapsed - and its digest is looked up in a hash join with the
digests of known licence texts, which are made canonical the same way. Whole texts are looked up
against full licence texts and notices, and so is each line of a text, since notices stand in lines
of their own. The known texts are ``KNOWN``, and those of a table that ``scan`` takes; ``folder_texts``
makes one of the whole texts that a system carries.

Defined results: a null text is empty; a text without any letter or digit has the digest of the
empty text and no licence; repeated rows give repeated results; a null id is kept; lines of any
length are looked up; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import row_key, stored

#: Spellings that licences use for the same word.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("favour", "favor"),
    ("http://", "https://"),
    ("copyright owner", "copyright holder"),
    ("&", " and "),
)
#: Lines that are left out: one that begins with a copyright mark and goes on with a year, "by" or a
#: second mark (not the words of a wrapped licence, nor a clause numbered (c)), and "all rights reserved" on the line after it.
MARK_LINE = "^[ \t]*((copyright|\\(c\\)|\u00a9)[ \t]*(\\(c\\)|\u00a9)?[ \t]*([0-9]{4}|by[ \t])|copyright[ \t]*(\\(c\\)|\u00a9))"
RIGHTS_LINE = "^[ \t]*all rights reserved[.]?[ \t\r]*\\z"
#: ASCII other than letters and digits, and typographic quotes and dashes.
PUNCTUATION = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f\u2013\u2014\u2018\u2019\u201c\u201d]+"

#: Public licence texts and usual notices.
PERMISSION_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
PERMISSION_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
PERMISSION_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
DISCLAIMER_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
CONDITIONS_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD_BSD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
DISCLAIMER_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXT_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = (
    ("MIT", PERMISSION_MIT),
    ("MIT", "MIT License\n\n" + PERMISSION_MIT),
    ("MIT", "The MIT License (MIT)\n\n" + PERMISSION_MIT),
    ("ISC", PERMISSION_ISC + "\n\n" + DISCLAIMER_ISC),
    ("ISC", "ISC License\n\n" + PERMISSION_ISC + "\n\n" + DISCLAIMER_ISC),
    ("0BSD", PERMISSION_0BSD + "\n\n" + DISCLAIMER_ISC),
    ("0BSD", "BSD Zero Clause License\n\n" + PERMISSION_0BSD + "\n\n" + DISCLAIMER_ISC),
    ("BSD-2-Clause", CONDITIONS_BSD + "\n\n" + DISCLAIMER_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + CONDITIONS_BSD + "\n\n" + DISCLAIMER_BSD),
    ("BSD-3-Clause", CONDITIONS_BSD + "\n\n" + THIRD_BSD + "\n\n" + DISCLAIMER_BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + CONDITIONS_BSD + "\n\n" + THIRD_BSD + "\n\n" + DISCLAIMER_BSD),
    ("Zlib", TEXT_ZLIB),
    ("Zlib", "zlib License\n\n" + TEXT_ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)


def _without_marks(c: Column) -> Column:
    """A text without its copyright lines."""
    lines = F.split(c, "\n", -1)
    mark = lambda x: x.rlike(MARK_LINE)
    kept = F.filter(lines, lambda x, i: ~mark(x) & ~((i > 0) & x.rlike(RIGHTS_LINE) & F.coalesce(mark(F.get(lines, i - 1)), F.lit(False))))
    return F.array_join(kept, "\n")


def canonical(c: Column) -> Column:
    """What equivalent writings of a licence share, from the text in lower case."""
    marked = F.contains(c, F.lit("copyright")) | F.contains(c, F.lit("(c)")) | F.contains(c, F.lit("\u00a9"))
    c = F.when(marked, _without_marks(c)).otherwise(c)
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, PUNCTUATION, " "))


def with_digest(rows: DataFrame, text: str) -> DataFrame:
    """The rows with the digest of the canonical text in place of the text."""
    lowered = rows.withColumn(text, F.lower(text))
    return lowered.withColumn("digest", F.sha2(canonical(F.col(text)).cast("binary"), 256)).drop(text)


def known(texts: DataFrame) -> DataFrame:
    """(digest, license) of known texts (license, known_text)."""
    digests = with_digest(texts.select("license", "known_text"), "known_text")
    # A text without letters or digits is no licence.
    return digests.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).groupBy("digest").agg(F.min("license").alias("license"))


def folder_texts(spark: SparkSession, folder: str, most: int = 16_000_000) -> DataFrame:
    """(license, known_text) of the files of a folder of the driver's, such as that of the licences that a system carries.

    The name is the file's. Links to other files of the folder are left out, and a folder of more
    than ``most`` bytes is refused: it is no list of licences.
    """
    files = sorted(f for f in Path(folder).iterdir() if f.is_file() and not f.is_symlink())
    if (size := sum(f.stat().st_size for f in files)) > most:
        raise ValueError(f"{folder} holds {size} bytes, more than {most}")
    return spark.createDataFrame([(f.name, f.read_text("utf-8", "replace")) for f in files], "license string, known_text string")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license, n_notices, notices): of the whole text, and of its lines (notices sorted, joined by commas).

    ``texts`` are known texts (license, known_text) beside those of ``KNOWN``.
    """
    rows = docs.sparkSession.createDataFrame(list(KNOWN), "license string, known_text string")
    licences = F.broadcast(known(rows)) if texts is None else stored(known(rows.unionByName(texts.select("license", "known_text"))), "licence-known")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), whole.alias("t"))
    lines = rows.select("row_key", F.posexplode(F.split("t", "\n", -1)).alias("line", "part"))
    found = with_digest(lines, "part").join(licences, "digest")
    # Exactly repeated rows share a key: their lines count once each.
    notices = found.groupBy("row_key").agg(F.count_distinct("line").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    notices = stored(notices, "licence-notices")
    texts = with_digest(rows, "t").join(licences, "digest", "left")
    joined = texts.join(notices, "row_key", "left")
    return joined.select(
        F.col("doc_id").alias(doc_id),
        F.col("digest").alias("text_digest"),
        "license",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )


def oracle_sql() -> str:
    """The same scan of the view ``documents`` in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pattern = lambda s: quoted(s.replace("\n", "\\n").replace("\t", "\\t"))

    def canon(c: str) -> str:
        mark = lambda x: f"regexp_matches({x}, {pattern(MARK_LINE)})"
        lines = f"string_split(lower({c}), chr(10))"
        after = f"(i > 1 AND regexp_matches(x, {pattern(RIGHTS_LINE)}) AND coalesce({mark(f'{lines}[i - 1]')}, false))"
        c = f"array_to_string(list_filter({lines}, lambda x, i: NOT {mark('x')} AND NOT {after}), chr(10))"
        for old, new in SPELLINGS:
            c = f"replace({c}, {quoted(old)}, {quoted(new)})"
        return f"sha256(trim(regexp_replace({c}, {pattern(PUNCTUATION)}, ' ', 'g')))"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT {canon("t")} AS digest, min(license) AS license FROM (VALUES {rows}) AS k(license, t) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS part FROM docs),
found AS (SELECT doc_id, license FROM (SELECT doc_id, {canon("part")} AS digest FROM lines) JOIN known USING (digest)),
notices AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM found GROUP BY doc_id)
SELECT doc_id, w.digest AS text_digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM (SELECT doc_id, {canon("t")} AS digest FROM docs) w LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)
"""
