import math

import numpy as np
import pytest

from maskloom.llm import one_bit_search as ob


def brute(rows, k, every):
    by = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        by[i] = min(by.get(i, v), v)
    common = max(sorted({len(v) for v in by.values()}), key=lambda d: sum(len(v) == d for v in by.values()), default=0)
    by = {i: np.array(v) for i, v in by.items() if len(v) == common}
    out = {}
    for q in by:
        if q % every == 0:
            scores = sorted((-float((by[q] * v).sum()), i) for i, v in by.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def run(spark, rows, k=20, every=20):
    got = {}
    for r in ob.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), k, every).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, each in got.items():
        each.sort()
        assert [x[0] for x in each] == list(range(1, len(each) + 1))
    return {q: [x[1:] for x in each] for q, each in got.items()}


@pytest.mark.parametrize("dim,blocks", [(64, (8192, 2048)), (50, (150, 16)), (130, (100, 5))])
def test_matches_brute_force(spark, monkeypatch, dim, blocks):
    monkeypatch.setattr(ob, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(ob, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((5, dim)) * 2
    rows = [(i, (centres[i % 5] + rng.standard_normal(dim) * 0.4).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [0.0] * dim), (2040, [float("nan")] * dim), (2060, [None] * dim), (2080, [1.0] * 3), (None, [1.0] * dim), (40, rows[3][1]), (2100, [float("inf")] * dim), (2120, [])]
    want, got = brute(rows, 20, 20), run(spark, rows)
    assert set(want) == set(got)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.999 * sum(map(len, want.values()))
    for q in want:
        for (i, s), (j, t) in zip(want[q], got[q]):
            assert s == pytest.approx(t, rel=1e-12, abs=1e-12)
            assert i == j


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((3000, 64)) + 1
    queries = rng.standard_normal((40, 64)) * 3
    mean, turn = vectors.mean(axis=0), ob.rotation(64)
    estimate, off = ob.bounds(queries, mean, turn, *ob.encode(vectors, mean, turn))
    error = np.abs(estimate - queries @ vectors.T)
    assert (error <= off).mean() > 0.9999 and np.median(error / off) < 0.3


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])]) == {0: [(1, 11.0)]}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, []) == {}
