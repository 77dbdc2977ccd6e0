import hashlib
import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskloom.llm import license_scan as ls


def plain(t):
    t = " " + re.sub(r"[\W_]+", " ", t) + " "
    for a, b in ls.SPELLINGS:
        t = t.replace(a, b)
    return t.strip(" ")


def canonical(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return plain(" ".join(x for x in low.split("\n") if not re.match(ls._COPYRIGHT, x)))


def test_matches_brute_force(spark):
    mit = dict(ls.KNOWN[::-1])
    text = ls.KNOWN[0][1]
    rows = [
        (1, text), (2, "Copyright (c) 2001 A. Person\n\n" + text.upper().replace("SUBLICENSE", "sub-licence").replace("\n\n", "\n \n")), (3, text + " Really."), (4, None), (5, ""),
        (6, "Some words.\n  released under the MIT LICENCE!\nmore\nLicensed under CC BY-NC 4.0."), (7, "not released under the MIT License."), (8, "© me\n(C) you\nall rights reserved"), (9, ls._ISC), (9, ls._ISC), (None, ls._ISC), (10, "licence " * 20000),
    ]
    known = {hashlib.sha256(canonical(t).encode()).hexdigest(): name for name, t in ls.KNOWN}
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), ls.known_digests(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = hashlib.sha256(canonical(r.text).encode()).hexdigest()
        assert r.canonical_sha256 == want and r.license == known.get(want)
        lines = {known.get(hashlib.sha256(plain("".join(c.lower() if "A" <= c <= "Z" else c for c in x)).encode()).hexdigest()) for x in (r.text or "").split("\n")} - {None}
        assert r.notices == ",".join(sorted(lines))
    by = {r.doc_id: r for r in got}
    assert by[1].license == by[2].license == "MIT" and by[3].license is None and by[9].license == "ISC"
    assert by[6].notices == "CC-BY-NC-4.0,MIT" and by[7].notices == ""


def test_empty_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ls.scan(docs, ls.known_digests(spark)).count() == 0
    with pytest.raises(ValueError):
        ls.scan(docs.withColumn("License", F.lit(1)), ls.known_digests(spark))


def test_layout_does_not_matter(spark):
    """Wrap widths, comment marks and notices; running text that begins with "copyright" stays."""
    heads = ["", "Copyright (c) 2020 X\n\n", "Copyright Jane Doe\nAll rights reserved.\n\n", "(c) 2019 Lawson\n", "\u00a9 X Y\n", "Copyright Lawson Inc\n"]
    rows = []
    for name, text in ls.KNOWN:
        if len(text) < 200 or len(text) > 2500:
            continue
        for width in (30, 50, 72, 79, 10**6):
            body = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            for head in heads:
                for mark in ("", "# ", " * ", "// "):
                    rows.append((name, "\n".join(mark + x for x in (head + body).split("\n"))))
    isc = ls._ISC.replace("that the above copyright", "that the above\ncopyright")
    rows += [("ISC", isc), (None, "copyright notice\n" + isc)]
    got = ls.scan(spark.createDataFrame(rows, "want string, text string"), ls.known_digests(spark)).collect()
    assert [r for r in got if r.want != r.license] == []


def test_pattern_is_the_same_in_sql():
    lines = ["copyright notice", "copyright notices and", "copyright noticed 1", "copyright", "# copyright (c) x", "(c) you must", "(c) youth", "\u00a9 me", "all rights reserved.", "all rights reserved. use", "copyright \u00e9va", "// copyright 2020"]
    dropped = [False, False, True, False, True, False, True, True, True, False, True, True]
    assert [bool(re.match(ls._COPYRIGHT, x)) for x in lines] == dropped
    duckdb = pytest.importorskip("duckdb")
    assert [duckdb.execute("SELECT regexp_matches(?, '" + ls._COPYRIGHT + "')", [x]).fetchone()[0] for x in lines] == dropped


def test_common_licences_are_known(spark):
    known = Path(ls.__file__).with_name("licenses")
    rows = [(p.stem, "", p.read_text()) for p in sorted(known.glob("*.txt"))]
    bsd = ls._BSD % ls._NAMED
    rows += [("BSD-3-Clause", "", "Copyright (c) 2020, X\nAll rights reserved.\n\n" + bsd), ("BSD-2-Clause", "", "BSD 2-Clause License\n\nCopyright (c) 2020, X\n\n" + ls._BSD % "")]
    apache = (known / "Apache-2.0.txt").read_text()
    rows += [("Apache-2.0", "", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 X"))]
    rows += [(None, x, f"# {said}\ncode") for x, said in (("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"))]
    got = ls.scan(spark.createDataFrame(rows, "want string, line string, text string"), ls.known_digests(spark)).collect()
    assert [(r.want, r.license) for r in got if r.want != r.license] == []
    assert [r for r in got if r.line and r.notices != r.line] == []
    headers = {n for n, t in ls.KNOWN if 100 < len(t) < 1000 and ("free software" in t or "Apache License" in t or "Source Code Form" in t)}
    assert {"Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"} <= headers
