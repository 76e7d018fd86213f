"""License scans (7): canonical digest lookup.

A text, and each of its paragraphs and lines, is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings), digested, and hash-joined with the digests of known texts: whole licences (short ones below, long ones
in licence_texts/), with and without their appendix, their standard headers, and the one-line notices that NAMES and NOTICES make.

A known text of several paragraphs is also found within a longer document, whole: its paragraphs' digests are one run, digested
again, which is looked up wherever a document's paragraph is the run's first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut

#: Spellings that license matching treats as one.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "favour": "favor", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "licence": "license",
    "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "noncommercial": "non commercial", "offence": "offense", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "per cent": "percent", "http": "https",
}

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
    "http://www.apache.org/licenses/LICENSE-2.0\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
    "either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu_header(name: str, version: str, later: bool = True) -> str:
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version}"
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}."


_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: licence -> how one-line notices name it.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    **{f"{k}-{v}": (f"{n}, version {v[0] if v.endswith('.0') else v}", f"{n} v{v}", f"{n} {v}", f"GNU {k} v{v[0] if v.endswith('.0') else v}", f"{k}-{v}") for k, n in _GNU.items() for v in (("2.1", "3.0") if k == "LGPL" else ("3.0",) if k == "AGPL" else ("2.0", "3.0"))},
    **{f"CC-{k}-4.0": (f"CC {k} 4.0", f"CC-{k}-4.0", f"Creative Commons {n} 4.0 International License", f"Creative Commons {n} 4.0 License") for k, n in _CC.items()},
}
NOTICES = (
    *(f"{verb} under {{}}" for verb in ("Licensed", "Released", "Distributed", "Available", "Published", "Provided")),
    *(f"This {thing} is {verb} under {{}}" for thing in ("work", "file", "software", "project", "document", "text", "page") for verb in ("licensed", "released", "distributed")),
)
_LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")


#: Where the terms of long licences end and an appendix begins.
_APPENDIX = re.compile(r"\n[ \t]*(?:END OF TERMS AND CONDITIONS|Exhibit A - )")


def _long(name: str) -> list[str]:
    """The whole text; up to the line that ends its terms, with and without that line."""
    text = resources.files(__package__).joinpath(f"licence_texts/{name}.txt").read_text("utf-8")
    if not (m := _APPENDIX.search(text)):
        return [text]
    return [text, text[: m.start()], *([text[: m.end()]] if "END" in m[0] else [])]


def _notices() -> list[tuple[str, str]]:
    made = [(k, n.format(f"{article}{name}.")) for k, names in NAMES.items() for name in names for article in ("the ", "") for n in NOTICES]
    return [x for x in made if _signed(x[1])] + [(k, f"SPDX-License-Identifier: {k}") for k in NAMES]


def _signed(text: str) -> bool:
    return any(sign in text.lower() for sign in SIGNS)


#: Every known text has one of these; units without are not digested.
SIGNS = ("licen", "permission", "redistribution", "copyright")
#: (licence, text); a licence may have several texts. A scan may be given any other list or table.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT", f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT_GRANT}, subject to the following conditions:\n{_MIT_NOTICE}\n{_MIT_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT_GRANT}.\n{_MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n{_ZLIB}"),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER),
    *((f"{k}-{v}.0", _gnu_header(n, v, later)) for k, n in _GNU.items() for v in ("2", "3") if (k, v) not in (("LGPL", "2"), ("AGPL", "2")) for later in (True, False)),
    *((name, text) for name in _LONG for text in _long(name)),
    *_notices(),
)
#: Digests are broadcast up to this number, shuffled beyond.
MOST_KNOWN = 100_000
#: Lines that name a holder or a year; not those of a text that happen to begin with the word.
_HOLDER = r"(?m)^[^\p{L}\p{N}(©]*(?:copyright\s*(?:\(c\)|©|[0-9<\[{]|by\s)|\(c\)\s*(?:copyright\s*)?[0-9<\[{]|©)[^\n]*$|(?m)^[^\p{L}\p{N}]*all rights reserved[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines; one spelling; letters and digits with single spaces."""
    low = F.regexp_replace(F.lower(text), _HOLDER, " ")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        plain = F.replace(plain, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(plain)


_PARAGRAPHS = r"\n[ \t\r]*\n"


def _paragraph_digests(text: Column) -> Column:
    """Digests of the paragraphs that have words, in order."""
    return F.transform(F.filter(F.transform(F.split(text, _PARAGRAPHS), canonical), lambda c: c != ""), F.md5)


def _run(digests: Column, at: Column, n: Column) -> Column:
    return F.md5(F.array_join(F.slice(digests, at + 1, n), ""))


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and licence found in it: doc_id, license, whole, n_units.

    known: pairs or a table (license, text); each text must hold one of SIGNS. whole: the text as a whole is the licence;
    n_units: how many of its distinct units (text, paragraphs, lines, and runs of paragraphs where a licence stands within a
    longer text) are. Null and empty texts and null ids have no row; rows of one doc_id are one document; an empty table gives
    an empty table. A known text that occurs in two licences gives a row for each. Other columns are not read.
    """
    if isinstance(known, DataFrame):
        texts, small = known.select("license", "text"), known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN
    else:
        if unmarked := [name for name, text in known if not _signed(text)]:
            raise ValueError(f"known texts without one of {SIGNS}: {unmarked}")
        texts, small = docs.sparkSession.createDataFrame(list(known), "license string, text string"), len(known) <= MOST_KNOWN
    table = texts.select("license", F.md5(canonical(F.col("text"))).alias("digest")).distinct()
    runs = texts.where(F.col("text").rlike(_PARAGRAPHS)).select("license", F.length(canonical(F.col("text"))).alias("chars"), _paragraph_digests(F.col("text")).alias("d")).where("size(d) > 1")
    runs = runs.select("license", F.get("d", F.lit(0)).alias("digest"), F.size("d").alias("n"), _run(F.col("d"), F.lit(0), F.size("d")).alias("run"), "chars")
    runs = cut(runs.distinct(), "runs")
    # no spelling doubles a word, so a text that holds a run has half its letters and digits
    least = (runs.agg(F.min("chars")).first()[0] or 0) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")

    def signed(c: Column) -> Column:
        low, out = F.lower(c), F.lit(False)
        for s in SIGNS:
            out = out | F.contains(low, F.lit(s))
        return out

    known_of = lambda df: F.broadcast(df) if small else df
    some = rows.where(signed(F.col("text")))
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", _PARAGRAPHS), F.split("text", r"\n")))
    each = some.select("doc_id", "text", F.explode(F.filter(units, signed)).alias("unit"))
    each = each.select("doc_id", (F.col("unit") == F.col("text")).alias("whole"), F.md5(canonical(F.col("unit"))).alias("digest"))
    found = each.join(known_of(table), "digest").select("doc_id", "license", "whole")
    marked = some.where((F.length("text") >= least) & F.col("text").rlike(_PARAGRAPHS)).select("doc_id", _paragraph_digests(F.col("text")).alias("d"))
    starts = marked.select("doc_id", "d", F.posexplode("d").alias("at", "digest")).join(known_of(runs.drop("chars").distinct()), "digest")
    # a text that is one run was found as a whole
    within = starts.where((F.size("d") > F.col("n")) & (_run(F.col("d"), F.col("at"), F.col("n")) == F.col("run")))
    within = within.select("doc_id", "license", "run").distinct().select("doc_id", "license", F.lit(False).alias("whole"))
    return found.unionByName(within).groupBy("doc_id", "license").agg(F.bool_or("whole").alias("whole"), F.count("*").alias("n_units"))


def _sql_canonical(text: str) -> str:
    low = f"regexp_replace(lower({text}), '{_HOLDER}', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


_SIGNED = " OR ".join("contains(lower({0}), '" + s + "')" for s in SIGNS)
_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
_BLANK = r"\n[ \t\r]*\n"


def _sql_runs(source: str, key: str) -> str:
    """(key, d: digests of paragraphs with words) of the rows of source (key, text)."""
    parts = f"SELECT {key}, unnest(string_split_regex(text, '{_BLANK}')) AS part, unnest(range(len(string_split_regex(text, '{_BLANK}')))) AS i FROM {source} WHERE regexp_matches(text, '{_BLANK}')"
    return f"SELECT {key}, list(md5(c) ORDER BY i) AS d FROM (SELECT {key}, i, {_sql_canonical('part')} AS c FROM ({parts})) WHERE c <> '' GROUP BY {key}"


#: The same scan for DuckDB.
SQL = rf"""
WITH texts AS (SELECT name AS license, t AS text, row_number() OVER () AS k FROM (VALUES {_VALUES}) AS k(name, t)),
known AS (SELECT DISTINCT license, md5({_sql_canonical("text")}) AS digest FROM texts),
runs AS (SELECT DISTINCT license, d[1] AS digest, len(d) AS n, md5(array_to_string(d, '')) AS run FROM ({_sql_runs("texts", "k")}) JOIN texts USING (k) WHERE len(d) > 1),
docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE {_SIGNED.format("text")}),
units AS (SELECT doc_id, text, unnest(list_distinct(list_concat([text], string_split_regex(text, '{_BLANK}'), string_split(text, chr(10))))) AS unit FROM docs),
found AS (SELECT doc_id, license, whole FROM (SELECT doc_id, unit = text AS whole, md5({_sql_canonical("unit")}) AS digest FROM units WHERE {_SIGNED.format("unit")}) JOIN known USING (digest)),
marked AS (SELECT r, d, unnest(d) AS digest, unnest(range(len(d))) AS place FROM ({_sql_runs("docs", "r")})),
within_ AS (SELECT DISTINCT doc_id, license, run FROM marked JOIN runs USING (digest) JOIN docs USING (r) WHERE len(d) > n AND md5(array_to_string(d[place + 1:place + n], '')) = run)
SELECT doc_id, license, bool_or(whole) AS whole, count(*) AS n_units FROM (SELECT * FROM found UNION ALL SELECT doc_id, license, false FROM within_) GROUP BY doc_id, license
"""
