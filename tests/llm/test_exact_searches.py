import math

import numpy as np
import pytest

from maskloom.llm import approximation_search as va, hard_negatives as hn
from maskloom.llm.whole_vectors import dots, row_dots


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_search(rows, k, every, scale):
    by = {}
    for i, v in rows:
        if i is not None and (w := whole(v, scale)) is not None:
            by[i] = min(by.get(i, w), w)
    out = set()
    for q in by:
        if q % every == 0:
            scored = sorted((-dot(by[q], v), i) for i, v in by.items() if i != q and len(v) == len(by[q]))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def brute_mine(rows, every, scale, positives, negatives):
    by = {}
    for i, label, v in rows:
        if i is not None and label is not None and (w := whole(v, scale)) is not None:
            by[i] = min(by.get(i, (label, w)), (label, w))
    out = set()
    for a, (label, v) in by.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in by.items() if i != a and len(w) == len(v))
        for p_score, p in [(-s, i) for s, i, other in scored if other == label][:positives]:
            hard = [(-s, i) for s, i, other in scored if other != label and 80 * p_score <= -100 * s <= 100 * p_score]
            out |= {(a, p, r, i, p_score, s) for r, (s, i) in enumerate(hard[:negatives], 1)}
    return out


def search(spark, rows, k=20, every=20, scale=64):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in va.search(frame, k, every, scale).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def mine(spark, rows, every=20, scale=256, positives=5, negatives=5):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    done = hn.mine(frame, every, scale, positives, negatives)
    got = [tuple(r) for r in done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(dim, n, seed, spread=0.4):
    """Clustered vectors of growing length, with copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    rows = [(i, ((centres[i % 5] + rng.standard_normal(dim) * spread) * (1 + i % 7) / 8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(n // 4)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [1.0] * 3, [float("inf")] * dim, [], [2.0, 1.0, 0.0]]
    return rows + [(20_000 + 20 * i, v) for i, v in enumerate(odd)] + [(None, [1.0] * dim), (40, rows[3][1]), (20_060, [3.0] * 3)]


@pytest.mark.parametrize("dim,blocks", [(64, (8192, 2048, 128, 1 << 20)), (20, (70, 9, 4, 50)), (1, (100, 5, 2, 10))])
def test_search_matches_brute_force(spark, monkeypatch, dim, blocks):
    for name, value in zip(("VECTOR_BLOCK", "QUERY_BLOCK", "STRIP", "PORTION"), blocks):
        monkeypatch.setattr(va, name, value)
    rows = vectors(dim, 400, dim)
    assert search(spark, rows) == brute_search(rows, 20, 20, 64)


@pytest.mark.parametrize("dim,blocks", [(32, (8192, 512)), (12, (60, 7)), (2, (50, 3))])
def test_mining_matches_brute_force(spark, monkeypatch, dim, blocks):
    monkeypatch.setattr(hn, "BUCKET", blocks[0])
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[1])
    rows = [(i, None if i == 33 else (0 if n % 3 == 0 else n % 5), v) for n, (i, v) in enumerate(vectors(dim, 400, dim, 0.9))]
    assert mine(spark, rows) == brute_mine(rows, 20, 256, 5, 5)


def test_pruning_leaves_rows_out_and_none_that_reaches_the_threshold():
    rng = np.random.default_rng(3)
    wide = np.floor(rng.standard_normal((500, 16)) * 60)
    peaked = np.floor(rng.standard_normal((500, 16)) * 8)
    peaked[np.arange(500), rng.integers(0, 16, 500)] = 240
    for block in (wide, peaked):
        units = hn.directions(block)[0]
        bucket = hn.Bucket(np.arange(500), np.zeros(500, np.int64), block, np.argsort(units.T, axis=1, kind="stable").astype(np.uint16))
        scores = block @ block.T
        read = 0
        for i in range(50):
            unit, length = (x[0] for x in hn.directions(block[i : i + 1]))
            least = int(np.sort(scores[i])[-8])
            rows = bucket.candidates(unit, length, least)
            read += len(rows)
            assert set(np.flatnonzero(scores[i] >= least)) <= set(rows.tolist())
        if block is peaked:
            assert read < 0.3 * 50 * 500
        assert len(bucket.candidates(unit, length, 10**9)) == 0


def test_bounds_hold_and_files_are_small():
    rng = np.random.default_rng(4)
    block = np.floor(rng.standard_normal((3000, 24)) * 10)
    packed, least, largest = va.approximate(block)
    cells = va.cells_of(packed, 24)
    low, high = (np.take_along_axis(x, cells, axis=0) for x in (least, largest))
    assert (low <= block).all() and (block <= high).all() and packed.shape[1] == 24 * va.BITS // 8
    lower, upper = va.score_bounds(block[:20], low, high)
    exact = block[:20] @ block.T
    assert (lower <= exact).all() and (exact <= upper).all() and np.median(upper - lower) < 0.5 * exact.std()


def test_products_stay_exact_at_any_size():
    for most in (3, 2**20, 2**30, 2**40):
        a = np.array([[most, -1.0, most - 1], [1.0, 2.0, -most]])
        want = [[max(min(dot([int(x) for x in p], [int(x) for x in q]), 2**63 - 1), -(2**63)) for q in a] for p in a]
        assert dots(a, a).tolist() == want and row_dots(a, a).tolist() == [want[0][0], want[1][1]]


def test_few_none_and_clashing_names(spark):
    assert search(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])]) == {(0, 1, 1, 11 * 64 * 64)}
    assert search(spark, [(0, [1.0, 2.0])]) == set() and search(spark, []) == set()
    assert mine(spark, []) == set() and mine(spark, [(0, 1, [1.0]), (1, 1, [2.0])]) == set()
    rows = [(i, i % 2, i, i, i, [float(i % 5), 1.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, block int, score int, v int, embedding array<float>")
    assert va.search(frame).count() == 3 * 20
    assert hn.mine(frame, 10).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    plain = [(r[0], r[1], r[-1]) for r in rows]
    assert mine(spark, plain, 10) == brute_mine(plain, 10, 256, 5, 5) == {tuple(r) for r in hn.mine(frame, 10).collect()}
