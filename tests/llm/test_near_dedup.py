import random

import numpy as np
import pytest

from maskloom.llm import near_dedup as nd


def shingles(text, width):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    docs = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    by = {}
    for d, s in sets:
        by.setdefault(s, []).append(d)
    keys = [s for s in by if s]
    for s in keys:
        for d in by[s]:
            a, b = find(by[s][0]), find(d)
            parent[max(a, b)] = min(a, b)
    for i, s in enumerate(keys):
        for t in keys[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = find(by[s][0]), find(by[t][0])
                parent[max(a, b)] = min(a, b)
    size = {}
    for d, s in sets:
        size[d] = max(size.get(d, 0), len(s))
    return sorted((d, size[d], find(d), find(d) == d) for d in docs)


def corpus(seed, copies=40):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(4000)] + ["É", "ÄB", "x y"]
    rows = []
    for base in range(25):
        words = rng.choices(vocab, k=rng.choice([1, 2, 3, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, copies])):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12])):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            rows.append((len(rows) * 3, (" " if rng.random() < 0.5 else "\n ").join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in new)))
    chain = rng.choices(vocab, k=150)  # each step is near the one before, not the ends
    for i in range(30):
        rows.append((5000 + i, " ".join(chain)))
        chain[i * 5] = "new%d" % i
        chain[i * 5 + 1] = "new%d" % i
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (9003, "\n"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (9004, " ".join(rng.choices(vocab, k=30000)))]


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 85), (2, 5, 80)])
def test_matches_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nd.near_duplicates(docs, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_group_around_the_threshold(spark):
    """Copies of one text whose pairs lie on both sides of the threshold, with one document of two texts."""
    rng = random.Random(5)
    base = ["b%d" % i for i in range(300)]
    rows = []
    for i in range(120):
        new = list(base)
        for at in rng.sample(range(300), rng.choice([3, 4, 5, 6, 7])):
            new[at] = "n%d" % rng.randrange(40)
        rows.append((i, " ".join(new)))
    rows.append((3, " ".join(base[:150] + ["other"] * 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nd.near_duplicates(docs).collect())
    assert got == brute(rows, 5, 80)
    assert 3 < len({r[2] for r in got}) < 120


def test_set_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for size in (10, 300, 5000):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[size // 10 :], rng.integers(0, 2**63, size // 8).astype(np.uint64)]))
        a, b = (np.unpackbits(np.frombuffer(nd.parity_lanes(v), np.uint8)) for v in (x, y))
        assert 0 < int((a ^ b).sum()) <= len(np.setxor1d(x, y))


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.comp for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            both = nd.mix64(rng.integers(0, 2**63, 400).astype(np.uint64))
            n = int(400 * (1 - share) / (1 + share))
            x, y = both, np.concatenate([both[n:], nd.mix64(rng.integers(0, 2**63, n).astype(np.uint64))])
            a, b = (np.unpackbits(np.frombuffer(nd.odd_sketch(nd.minhash(v)), np.uint8)) for v in (x, y))
            d = int((a ^ b).sum())
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(1 + nd.SKETCH_BITS / (4 * nd.HASHES) * np.log(1 - 2 * d / nd.SKETCH_BITS) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
