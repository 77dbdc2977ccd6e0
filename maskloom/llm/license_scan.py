"""License scan: canonical digests of entire texts and lines, hash-joined to known digests.

A text is brought to a canonical form - copyright notices dropped, A-Z lower-cased, everything
but letters and digits made one blank, equivalent spellings replaced - and its SHA-256 is looked
up among the digests of known licences. Each of its lines is looked up in the same way among
known notices. The known texts go through the same expressions, so new ones are added as rows.

A line of a third of all documents costs nothing: lines are exploded and joined within tasks
while the known table is measured small, else its few hits follow one shuffle by digest. Only
documents with a hit leave their task, keyed by the hash of their text.

Defined results. A null or empty text has the digest of the empty string and no licence.
Repeated rows each get the result of their text. Very long texts are one string like others.
An empty table gives an empty result. Extra columns are carried; clashing ones are refused.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.llm.common import measured, saved, table

# Licence texts and notices, equivalent spellings.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
# Whole texts are files of this package, one for each licence: the names of the files are the SPDX ids.
_FILES = "Apache-2.0 Artistic-1.0-Perl CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0".split()
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMED = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License")}
#: SPDX id: names a notice gives the licence.
_NAMES = {
    "MIT": "MIT License",
    "ISC": "ISC License",
    "0BSD": "0BSD License|BSD Zero Clause License",
    "BSD-2-Clause": "BSD 2-Clause License|2-Clause BSD License|Simplified BSD License",
    "BSD-3-Clause": "BSD 3-Clause License|3-Clause BSD License|New BSD License",
    "Apache-2.0": "Apache License, Version 2.0|Apache License 2.0|Apache 2.0 License",
    "MPL-1.1": "Mozilla Public License, Version 1.1|Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License, Version 2.0|Mozilla Public License 2.0|MPL 2.0",
    **{f"{a}-{n}": "|".join(f"{w}{x}" for w in names for x in (f", version {n[:-2] if n.endswith('.0') else n}", f" version {n}", f" v{n}"))
       for a, names, versions in (("GPL", ("GNU General Public License", "GNU GPL", "GPL"), ("1.0", "2.0", "3.0")), ("LGPL", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), ("2.1", "3.0")), ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), ("3.0",)))
       for n in versions},
    **{f"CC-{a}-{n}": f"CC {a} {n}" for a in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for n in ("3.0", "4.0")},
    "CC0-1.0": "CC0 1.0|CC0 1.0 Universal",
    "Unlicense": "Unlicense",
    "Zlib": "zlib License",
    "BSL-1.0": "Boost Software License, Version 1.0|Boost Software License 1.0",
    "EPL-2.0": "Eclipse Public License, Version 2.0|Eclipse Public License 2.0",
}
_SAID = [f"{x}{y}" for x in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ") for y in ("Licensed under", "Released under", "Distributed under")]


def _known_texts() -> list[tuple[str, str]]:
    """Whole texts of common licences with and without title or appendix, and their standard headers."""
    folder, rows = files(__package__) / "licenses", []
    for name in _FILES:
        text = (folder / f"{name}.txt").read_text(encoding="utf-8")
        rows.append((name, text))
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        if end:
            rows += [(name, text[: end.start()]), (name, text[: end.end()])]
        # The appendix's own notice, which a user fills in, is dropped with other notices then.
        if "Copyright [yyyy]" in text:
            rows.append((name, re.sub(r"(?m)^.*Copyright \[yyyy\].*\n", "", text)))
        for begin, last in ((r"Licensed under the Apache License", r"limitations under the License\."), (r"This Source Code Form is subject", r"MPL/2\.0/\."), (r"This (?:program|library) is free software", r"licenses/>\.|MA +[-0-9]+,? +USA\.?|USA")):
            rows += [(name, y) for x in re.findall(rf"{begin}[\s\S]{{0,900}}?(?:{last})", text) for y in {x, x.replace("http:", "https:")}]
    for name, text in (("BSD-2-Clause", _BSD % ""), ("BSD-3-Clause", _BSD % _NAMED)):
        for body in (text, re.sub(r"(?m)^[123]\. ", "", text)):
            rows += [(name, body), *((name, f"{title}\n\n{body}") for title in _TITLES[name])]
    return rows


def _known_notices() -> list[tuple[str, str]]:
    rows = []
    for name, said in _NAMES.items():
        forms = [name, *(f"{name}-{x}" for x in ("only", "or-later") if "GPL-" in name)]
        rows += [(x, f"SPDX-License-Identifier: {x}") for x in forms]
        for x in said.split("|"):
            rows += [(name, f"{start} {the}{x}") for start in _SAID for the in ("", "the ")]
    return rows


KNOWN += [("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT), *_known_texts(), *_known_notices()]
SPELLINGS = [
    (" licence ", " license "),
    (" licences ", " licenses "),
    (" licenced ", " licensed "),
    (" sub license ", " sublicense "),
    (" sub licence ", " sublicense "),
    (" non commercial ", " noncommercial "),
    (" non infringement ", " noninfringement "),
    (" organisation ", " organization "),
    (" per cent ", " percent "),
    (" copyright owner ", " copyright holder "),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that follow "copyright" in the running text of licences, so a line may begin there.
_NO_HOLDER = (
    "notice notices holder holders owner owners law laws license licenses licence licences statement statements "
    "protection protections disclaimer and or to in of on for is are the this that permission interest interests "
    "treaty treaties rights right status conditions like doctrines industry as from under with can may shall"
).split()
_NO_HOLDER += [w for _, t in KNOWN for w in re.findall(r"copyright[ \t\n]+([a-z]+)", t.lower())]
# The same after "(c)", a list mark in running text.
_NO_HOLDER_C = [w for _, t in KNOWN for w in re.findall(r"\(c\)[ \t\n]*([a-z]+)", t.lower())] + ["you", "the"]
_FOREIGN = "\u00aa-\uffff"


def _other_word(words: list[str], first: bool = False) -> str:
    """Pattern of a word that is none of ``words``, without look-ahead, which RE2 lacks."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    heads = sorted(c for c in tails if c)
    free = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in heads)
    parts = [f"[{free}{_FOREIGN}]", *(c + _other_word(tails[c]) for c in heads)]
    ended = [] if first or "" in tails else [f"[^a-z{_FOREIGN}]", "$"]
    return f"(?:{'|'.join(parts + ended)})"


_MARK = r"(?:\(c\)|©|&copy;)"
# After any comment marks: a copyright notice with a mark, a year or a holder, or "all rights reserved" alone.
_COPYRIGHT = (
    r"^[ \t\x21-\x27\x29-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*(?:"
    rf"copyright[ \t:,]*(?:{_MARK}|[0-9])|copyright[ \t:]+{_other_word(_NO_HOLDER, True)}"
    r"|copyright[ \t]+the[ \t][a-z0-9 .,\x27&-]*(?:authors|contributors|developers|project|foundation)"
    rf"|{_MARK}[ \t]*(?:[0-9]|{_other_word(_NO_HOLDER_C, True)})"
    r"|all rights reserved[^a-z0-9]*$)"
)


def _lower_lines(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)


def _plain(text: Column) -> Column:
    """Blank-separated words with a blank at either end, equivalent spellings replaced."""
    text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for said, meant in SPELLINGS:
        text = F.replace(text, F.lit(said), F.lit(meant))
    return F.trim(text)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical(text: Column) -> Column:
    """Of an entire text; lines that begin as a copyright notice, behind comment marks or not, are dropped."""
    return _plain(F.array_join(F.filter(_lower_lines(text), lambda x: ~x.rlike(_COPYRIGHT)), " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "license string, text string")
    return rows.select(digest(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Add canonical_sha256, license (of the entire text) and notices (sorted licences of lines)."""
    clash = {"canonical_sha256", "license", "notices", "digest", "uid"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    known = measured(saved(known))
    uid = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("uid")
    lines = docs.where("text is not null").select(uid, F.explode(_lower_lines(F.col("text"))).alias("line"))
    lines = lines.select("uid", digest(_plain(F.col("line"))).alias("digest"))
    hits = lines.join(known, "digest").groupBy("uid").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    found = docs.withColumn("uid", uid).withColumn("canonical_sha256", digest(canonical(F.col("text"))))
    found = found.join(known.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left").join(measured(saved(hits)), "uid", "left")
    return found.select(*[f"`{c}`" for c in docs.columns], "canonical_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, known_digests(spark)).select("doc_id", "canonical_sha256", "license", "notices")


def _sql_plain(text: str) -> str:
    text = f"' ' || regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for said, meant in SPELLINGS:
        text = f"replace({text}, '{said}', '{meant}')"
    return f"trim({text}, ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_LINES = f"string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10))"
_SQL_WHOLE = _sql_plain(f"array_to_string(list_filter({_SQL_LINES}, lambda x: NOT regexp_matches(x, '{_COPYRIGHT}')), ' ')")
SQL = f"""
WITH known_texts(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
known AS (SELECT sha256({_SQL_WHOLE}) AS digest, min(license) AS license FROM known_texts GROUP BY 1),
lines AS (SELECT doc_id, unnest({_SQL_LINES}) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, sha256({_sql_plain('line')}) AS digest FROM lines) l JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, d.canonical_sha256, k.license, coalesce(h.notices, '') AS notices
FROM (SELECT doc_id, sha256({_SQL_WHOLE}) AS canonical_sha256 FROM documents) d
LEFT JOIN known k ON k.digest = d.canonical_sha256 LEFT JOIN hits h USING (doc_id)"""
