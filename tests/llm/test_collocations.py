import random
import re
from collections import Counter

import numpy as np
import pytest

from maskloom.llm import collocations as co

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_count, max_words=5, top=2000, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    good = {p: a for p, a in f.items() if a >= min_count and len(p) > 2}
    dropped = set()
    for p, a in good.items():
        for size in range(2, len(p) - 1):
            for i in range(1, len(p) - size + 1):
                sub = (p[0], *p[i : i + size])
                if 100 * a >= share * f[sub]:
                    dropped.add(sub)
    for p, a in good.items():
        if p in dropped:
            continue
        lang, w = p[0], p[1:]
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def run(spark, rows, min_count, slices=3, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(slices)
    got = [tuple(r) for r in co.collocations(docs, min_count, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def rows_of(seed, hot=0.0):
    rng = random.Random(seed)
    words = ["a", "B", "Ünder", "the", "of", "x\x00y", "né", "日本", "don't", "q", "(r)", " ", "wide gap"]
    rows = []
    for i in range(120):
        out = []
        for _ in range(rng.randrange(60)):
            out.append("the of" if rng.random() < hot else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\r\n", "!?"]))
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), "".join(out)))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " .,\n"), ("de", "a a a a a a a a a a a a"), ("de", "a b. a b, a b")] + [rows[0]] * 7


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.8)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    rows = rows_of(seed, hot)
    monkeypatch.setattr(co, "CHUNK", 300)
    want = brute(rows, 4)
    assert len(want) > 50
    assert run(spark, rows, 4) == want


def test_hot_leads_full_filters_and_many_tasks(spark, monkeypatch):
    rows = rows_of(5, 0.9) + [("en", "the of " + " ".join("n%d" % (i % 40) for i in range(j, j + 6))) for j in range(300)]
    monkeypatch.setattr(co, "TASK_SUFFIXES", 100)
    monkeypatch.setattr(co, "GATHERED", 50)
    monkeypatch.setattr(co, "NUMBERED", 3)
    assert run(spark, rows, 3, share=90, top=30) == brute(rows, 3, share=90, top=30)


def test_long_text_products_past_64_bits_and_ties(spark):
    rows = [("en", "alpha beta " * 30_000 + ". gamma delta, gamma delta")]
    assert run(spark, rows, 2) == brute(rows, 2)
    # 1000 * a * n alone would pass 2**63 from a = n = 1e8 on; the decimals hold 38 digits.
    assert spark.sql("select (cast(1000 * 30000000000000 as decimal(19,0)) * cast(90000000000000 as decimal(19,0))) div (cast(40000000000000 as decimal(19,0)) * cast(30000000000000 as decimal(19,0)))").first()[0] == 2250


def test_empty_rare_and_extra_columns(spark):
    assert run(spark, [], 2) == set() and run(spark, [("en", "one two three")], 2) == set() and run(spark, [(None, None)], 1) == set()
    docs = spark.createDataFrame([("en", "u v w", 1, 2, "x")] * 5, "lang string, text string, n long, a long, phrase string")
    assert {r.phrase for r in co.collocations(docs, 5).collect()} == {"u v w"}


@pytest.mark.parametrize("least,small", [(1, 0), (7, 0), (7, 20), (1, 64)])
def test_partition_sizes_are_counts(least, small):
    rng = np.random.default_rng(least + small)
    keys = np.minimum(rng.integers(0, 9, (3000, 4)), rng.integers(0, 9, (3000, 4)))
    for d in range(1, 4):
        keys[(rng.random(3000) < 0.1) | (keys[:, d - 1] < 0), d] = -1
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist()):
        for d in range(1, 5):
            if row[d - 1] >= 0:
                want[tuple(row[:d])] += w
    head, depth, sums = co.multikey_quicksort(keys, weights, least, small)
    got = [(tuple(keys[h, :d].tolist()), int(s)) for h, d, s in zip(head, depth, sums)]
    assert len(got) == len(set(got)) and dict(got) == {p: n for p, n in want.items() if n >= least}
