"""Licence scans by canonical digest lookup.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space), digested whole, and joined
to the digests of known licences, which are made by the same expressions.  One-sentence licence notices, which sit on a
line of a larger text, are looked up line by line by the same digests: there are few of them, so they are a literal map
and no line leaves its row.  Native throughout.

Defined cases: a null or empty text has the digest of the empty text and no licence; every row is judged by itself, so ids
may repeat or be null; a text of any length is one row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm.text import once, table

#: Words that count as equal, by the SPDX matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: (pattern, replacement), in order, after copyright lines are gone; read alike by Java's regular expressions and by RE2.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?m)^[^\p{L}\n]*all rights reserved[^\p{L}\n]*$", " "),
    (r"https?://", " "),
    (r"©|\(c\)", " copyright "),
    (r"[^\p{L}\p{N}]+", " "),
)
#: A copyright line names a year or a holder: prose that a wrapping begins with 'copyright', or the item '(c)' of a list, is none.
_PROSE_WORDS = "notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|disclaimers?|treat(?:y|ies)|acts?|protections?|permissions?|infringements?|rights?|ownership|status|or|and|in|on|is|are|as|for|to|that|which|with|under|patent|trademark|the (?:software|program|library|work|document)"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\n]*(?:copyright\b(?!\s*(?:[,;.]|(?:{_PROSE_WORDS})\b))[^\n]*|©[^\n]*|\(c\)(?:[^\n]*(?:©|copyright \d|\b(?:19|20)\d\d\b)[^\n]*|[ \t]+[^\n,;:]{{1,40}}))$"
ANY_SPELLING = rf"\b({'|'.join(SPELLINGS)})\b"

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_POINTS = str.maketrans({"1": "*", "2": "*", "3": "*"})
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: Fixed values: (licence, text).  Short licences, and the header of Apache-2.0; a title line may or may not be there.
#: Longer ones are in the folder ``published``, see published().
LICENCES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("0BSD", f"{_GRANT}. {_AS_IS}"), ("0BSD", f"BSD Zero Clause License\n{_GRANT}. {_AS_IS}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"),
    ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_AS_IS), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_NAME + _BSD_AS_IS),
    ("Apache-2.0", _APACHE),
)
#: The BSD licences with points for the numbers of their list (no other digits are in them).
LICENCES += tuple((name, text.removeprefix(title).translate(_BSD_POINTS)) for name, text in LICENCES if name.startswith("BSD") for title in {"", f"{name[:3]} {name[4:]} License\n"})
#: Fixed values: (licence, a name that notices call it by).
NAMES: tuple[tuple[str, str], ...] = (
    ("0BSD", "BSD Zero Clause License"), ("AGPL-3.0", "GNU Affero General Public License"), ("AGPL-3.0", "GNU AGPL"), ("AGPL-3.0", "AGPL"),
    ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache"), ("Artistic-2.0", "Artistic License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Simplified BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "New BSD License"), ("BSL-1.0", "Boost Software License"),
    ("CC-BY-4.0", "CC BY"), ("CC-BY-4.0", "Creative Commons Attribution"), ("CC-BY-NC-4.0", "CC BY-NC"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial"),
    ("CC-BY-SA-4.0", "CC BY-SA"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike"), ("CC0-1.0", "CC0"), ("EPL-2.0", "Eclipse Public License"),
    ("GPL-2.0", "GNU General Public License"), ("GPL-2.0", "GNU GPL"), ("GPL-2.0", "GPL"), ("GPL-3.0", "GNU General Public License"), ("GPL-3.0", "GNU GPL"), ("GPL-3.0", "GPL"),
    ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License"), ("LGPL-2.1", "LGPL"), ("LGPL-3.0", "GNU Lesser General Public License"), ("LGPL-3.0", "LGPL"),
    ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License"), ("MPL-2.0", "MPL"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"),
)
#: How a name goes on if the licence has a version.
VERSIONED = ("{name} {version}", "{name}, version {version}", "{name} v{version}", "{name} {version} License", "{name} {version} International License")
#: How a notice begins, in the normal form of its line; what follows is looked up.
OPENING = r"^ ?(?:spdx license identifier |(?:this (?:work|software|project|program|file|document|code) is )?(?:licen[cs]ed|released|distributed|available) under )(?:the )?(.+)$"


def _notices() -> tuple[tuple[str, str], ...]:
    """(licence, what a notice calls it): each name, with its version if it has one, and the licence's tag."""
    called = []
    for licence, name in NAMES:
        version = licence.rpartition("-")[2]
        if version.removesuffix(".0").replace(".", "").isdigit() and "." in version:
            called += [(licence, form.format(name=name, version=v)) for form in VERSIONED for v in dict.fromkeys((version, version.removesuffix(".0")))]
        else:
            called.append((licence, name))
    return (*called, *((licence, tag) for licence in dict(NAMES) for tag in (licence, f"{licence}-only", f"{licence}-or-later")))


NOTICES = _notices()


#: Every notice has this in it, whatever its spelling: other lines aren't normalised.
ANY_NOTICE = r"(?i)licen[cs]"


def _plain(text: Column) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    for pattern, replacement in ((COPYRIGHT_LINE, " "), *STEPS):
        plain = F.regexp_replace(plain, pattern, replacement)
    return plain


def _respelt(plain: Column) -> Column:
    """Few texts have a word to respell: one look spares many passes."""
    spelt = plain
    for word, other in SPELLINGS.items():
        spelt = F.regexp_replace(spelt, rf"\b{word}\b", other)
    return F.sha2(F.btrim(F.when(plain.rlike(ANY_SPELLING), spelt).otherwise(plain)).cast("binary"), 256)


def digested(rows: DataFrame, text: str) -> DataFrame:
    """rows without the column ``text``, but with ``digest``, that of its normal form."""
    others = [F.col(c) for c in rows.columns if c != text]
    rows = rows.select(*others, once(_plain(F.col(text))).alias("plain"))
    return rows.select(*others, _respelt(F.col("plain")).alias("digest"))


@cache
def published() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the folder ``published``: as published, and without the appendix that says how to apply it."""
    found = []
    for file in sorted(resources.files("quernal.llm").joinpath("published").iterdir(), key=lambda f: f.name):
        licence, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        found += [(licence, text), *([(licence, terms), (licence, terms + end)] if end else [])]
    return tuple(found)


def _known(spark: SparkSession, entries: tuple[tuple[str, str], ...]) -> DataFrame:
    """Digests of a fixed list of texts: as many rows as the list has."""
    rows = spark.createDataFrame(list(dict.fromkeys(entries)), "licence string, known_text string")
    return F.broadcast(digested(rows, "known_text").withColumnRenamed("digest", "known").distinct())


def _noticed(text: Column) -> Column:
    """The sorted licences that lines of a text give notice of."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(ANY_NOTICE)), _plain)
    digests = F.transform(F.transform(lines, lambda line: F.regexp_extract(line, OPENING, 1)), _respelt)
    known = F.create_map(*(F.lit(x) for digest, licence in sorted(noticed().items()) for x in (digest, licence)))
    return F.when(text.rlike(ANY_NOTICE), F.sort_array(F.array_distinct(F.array_compact(F.transform(digests, lambda d: F.element_at(known, d))))))


def licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, digest, licence, notices): the licence that the whole text is, or null, and the
    sorted licences that lines of it give notice of.  ``known`` (licence, text) has licences beside those of this module;
    of several with one digest the first by name counts, and texts without a word count for nothing."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(_noticed(F.col("text")), F.array().cast("array<string>")).alias("notices"), "text")
    texts = _known(spark, LICENCES + published())
    if known is not None:
        others = digested(known.select("licence", F.col("text").cast("string").alias("text")), "text").withColumnRenamed("digest", "known")
        others = others.where(F.col("known") != plain_digest(""))
        texts = texts.unionByName(others).groupBy("known").agg(F.min("licence").alias("licence"))
    whole = digested(rows, "text").join(texts, F.col("digest") == F.col("known"), "left")
    return whole.select("doc_id", "digest", "licence", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: digest, licence and notices of every document."""
    return licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def plain_digest(text: str) -> str:
    """The digest of a text in plain Python, for texts of ASCII letters and digits: tests and the oracle hold the expressions against it."""
    plain = text.lower()
    for pattern, replacement in ((COPYRIGHT_LINE, " "), *STEPS, *((rf"\b{word}\b", other) for word, other in SPELLINGS.items())):
        plain = re.sub(pattern.replace(r"[^\p{L}\n]", r"[^a-z\n]").replace(r"[^\p{L}\p{N}]", "[^a-z0-9]").replace(r"[^\p{L}]", "[^a-z]"), replacement, plain)
    return hashlib.sha256(plain.strip(" ").encode()).hexdigest()


@cache
def noticed() -> dict[str, str]:
    """The licence of each notice's digest."""
    return {plain_digest(notice): licence for licence, notice in NOTICES}


#: RE2 can't look ahead: prose that a line begins with gets a letter before it that no text has, and loses it afterwards.
_SHIELD = "\ua66e"
_SQL_STEPS = (
    (rf"(?m)^([^\p{{L}}\n]*)(copyright\s*(?:[,;.]|(?:{_PROSE_WORDS})\b))", rf"\1{_SHIELD}\2"),
    (re.sub(r"\(\?!.*?\)\\b\)\)", "", COPYRIGHT_LINE), " "),
    (_SHIELD, ""),
    *STEPS,
)


def _sql_plain(text: str) -> str:
    return _replaced(f"lower(coalesce({text}, ''))", _SQL_STEPS)


def _sql_digest(plain: str) -> str:
    return f"sha256(trim({_replaced(plain, ((rf'\b{word}\b', other) for word, other in SPELLINGS.items()))}))"


def _replaced(text: str, steps: Iterable[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _values(digests: dict[str, str]) -> str:
    return ", ".join(f"('{licence}', '{digest}')" for digest, licence in sorted(digests.items()))


ORACLE = f"""
WITH k(licence, digest) AS (VALUES {_values({plain_digest(text): name for name, text in LICENCES + published()})}),
n(licence, digest) AS (VALUES {_values(noticed())}),
d AS (SELECT doc_id, text, {_sql_digest(_sql_plain("text"))} AS digest FROM documents),
p AS (SELECT doc_id, {_sql_plain("line")} AS plain FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{ANY_NOTICE}')),
l AS (SELECT doc_id, {_sql_digest("called")} AS digest FROM (SELECT doc_id, regexp_extract(plain, '{OPENING}', 1) AS called FROM p)),
f AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS notices FROM l JOIN n USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(f.notices, []::VARCHAR[]) AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""
