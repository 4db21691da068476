"""Licence scans: entire texts, brought to a canonical form, are looked up by digest among known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that count as the same, the second standing for both.
SPELLINGS = [
    ("acknowledgment", "acknowledgement"),
    ("analog", "analogue"),
    ("analyze", "analyse"),
    ("artifact", "artefact"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("caliber", "calibre"),
    ("canceled", "cancelled"),
    ("center", "centre"),
    ("color", "colour"),
    ("favor", "favour"),
    ("fulfill", "fulfil"),
    ("initialize", "initialise"),
    ("license", "licence"),
    ("licenses", "licences"),
    ("licensed", "licenced"),
    ("organization", "organisation"),
    ("recognized", "recognised"),
    ("utilization", "utilisation"),
    ("whilst", "while"),
]

# Public licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Licences known without a table of one's own: (licence, a text of it).
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + _0BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# SHA-256 of the canonical form of full licence texts; where there are two, the second ends with the terms, without the notes on how to apply them.
KNOWN_DIGESTS = [
    ("Apache-2.0", "911a35cce2c56989e5e67f27aa6c66560c1838758a0d5cde7269f6a07ca18111"),
    ("Apache-2.0", "1345f2a4f4506363e1ce4a1b13fe4ed4b278f5e4e0d80a7a3e9472337bb07b11"),
    ("Artistic-1.0-Perl", "3f72fca8e9edf142b844df45d827a04462cb9a6dd286357a134eb8b2d030d707"),
    ("CC0-1.0", "400db3ed80e146737970d3ff856f201f0206119c2851164504a236a6893f845a"),
    ("GFDL-1.2", "ac81a42403a32befdf17483cc4ee404a41a09d303db55ab142815e14ec590bfb"),
    ("GFDL-1.3", "ed53f361223c7b690267ee5394fcd1971b117f3e0e0cfa03668d2b6e611fe294"),
    ("GPL-1.0", "607ceba73935741ef6455b50e5ec8efc239707fe76b9d4b1eaa1b8e320644284"),
    ("GPL-1.0", "2445f20d9e6976031a7a739dd7b7a64dc263b157ba147a1b7260f931acf9e30b"),
    ("GPL-2.0", "2392edd65cf1fdd6caae552fe39830d76d96c6ed5d6da7c6ceb8636b9853a646"),
    ("GPL-2.0", "8608a323c987f250e5558f19befdde4d64f55e34a53f15a592ea05cad06ab873"),
    ("GPL-3.0", "9fff53bc0ca7b2345b80d5bd9e3b3acebd7683bdb2c5f811cb8854c89691ac43"),
    ("GPL-3.0", "e03e5f24b994388c299af0abec17625cb4d319ae4b9946d7e95f7fdfde37e1f2"),
    ("LGPL-2.0", "78b687aec2866f50e0e6ef8026f8155354d7d06ee5e4f87e001ca9c5909d0714"),
    ("LGPL-2.0", "8b9d570afa8bc9a8573ef3b863b0c06642d59c5c4affa342dc2c5d8507020516"),
    ("LGPL-2.1", "aa258d9dbe859765ebf2b37e520946c82529230a67abac7cbab6d0c76080a799"),
    ("LGPL-2.1", "9a261b594525c57e7f7bdc9ac8101fee4828fecf2497d4f439d07d16c852dd66"),
    ("LGPL-3.0", "7d6e51c6bb80fc7a025c16e64157adf9c280c58dee4c4b2bf73e596166a2a08f"),
    ("MPL-1.1", "51f4a43f6ef5793cbf2bb8fb8576997d63a50adcccc653511516580edee37afd"),
    ("MPL-2.0", "c8e60f72d52871d5690b4af049697019f507e5be260a26ee687639bc5fa5d987"),
]


def canonical(text: Column) -> Column:
    """Lower case; lines that start with a copyright sign or the word and name a year or "all rights reserved" lines dropped; runs of anything but letters, digits and non-ASCII characters made one space; one spelling a word."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$|^[ \t]*all rights reserved\.?[ \t\r]*$", "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "  "), F.lit(" "))
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {kept} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    """licence, text of the licences that are built in as texts."""
    return spark.createDataFrame(KNOWN, "licence string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    """licence, digest of the licences that are built in as digests."""
    return spark.createDataFrame(KNOWN_DIGESTS, "licence string, digest string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the canonical text), licence (null if the text as a whole is none that is known).

    Known are the texts of `known` (licence, text), or the built-in texts and digests. A null text counts as empty, a very long one is read whole; an empty table gives no rows; a text that is empty in canonical form is no licence. Where
    several licences share a digest the first in order of names is meant. Repeated rows stay
    repeated, null ids stay null, other columns are ignored. Spark broadcasts the known digests
    only if their size is below its own threshold, and shuffles digests (not texts) otherwise.
    """
    spark = docs.sparkSession
    texts = known if known is not None else known_licences(spark)
    digests = texts.where("licence is not null").select("licence", canonical(F.col("text")).alias("c")).where("c <> ''").select("licence", F.sha2("c", 256).alias("digest"))
    if known is None:
        digests = digests.union(known_digests(spark))
    digests = digests.groupBy("digest").agg(F.min("licence").alias("licence"))
    return docs.select(F.col("doc_id"), F.sha2(canonical(F.col("text").cast("string")), 256).alias("digest")).join(digests, "digest", "left").select("doc_id", "digest", "licence")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the licence that each document is, if any."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, '(?m)^[ \\t]*(?:copyright\\b|\\(c\\)|©)[^\\n]*[0-9]{{4}}[^\\n]*$|^[ \\t]*all rights reserved\\.?[ \\t\\r]*$', '', 'g')"
    out = f"concat(' ', regexp_replace({out}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', '  ', 'g'), ' ')"
    for other, kept in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {kept} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE_SQL = f"""WITH k(licence, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
l(licence, digest) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)}),
d AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, sha256(c) AS digest FROM (SELECT licence, {_sql("text")} AS c FROM k) WHERE c <> '' UNION ALL FROM l) GROUP BY 1),
t AS (SELECT doc_id, sha256({_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, licence FROM t LEFT JOIN d USING (digest)"""
