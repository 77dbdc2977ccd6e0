import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import quality as q

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = q.classify(docs, train_docs=2000).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.003 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.03 * n[(0, False)]


def test_em_recovers_posteriors_of_known_kinds():
    rng = np.random.default_rng(3)
    n = 20000
    kind = rng.choice([0, 1, 2], n, p=[0.85, 0.1, 0.05])
    rates = np.array([[0.002] * 8, [0.9, 0.8, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01], [0.01, 0.01, 0.01, 0.01, 0.85, 0.9, 0.01, 0.01]])
    votes = np.where(rng.random((n, 8)) < 0.1, 0, np.where(rng.random((n, 8)) < rates[kind], 2, 1))
    codes, counts = np.unique(q._pattern(votes), return_counts=True)
    posterior, tables, shares = q.estimate(dict(zip(codes.tolist(), counts.tolist())))
    bad = np.array([posterior[c] for c in q._pattern(votes).tolist()]) > 0.5
    # Against the best that can be done when all rates and shares are known.
    logs = ((votes == 2)[:, None] * np.log(rates) + (votes == 1)[:, None] * np.log(1 - rates)).sum(axis=2) + np.log([0.85, 0.1, 0.05])
    best = logs.argmax(axis=1) > 0
    assert (bad == (kind > 0)).mean() > (best == (kind > 0)).mean() - 0.02
    assert shares[0] == pytest.approx(0.85, abs=0.03)


def test_votes_do_not_depend_on_the_chunk():
    rng = random.Random(1)
    texts = [b"", b" \n", b"One two.", "É ñ | | # !!".encode()] + [" ".join(rng.choice(["ab", "AB!!", "c#", "|", "de."]) for _ in range(rng.randrange(80))).encode() for _ in range(60)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    whole = q.Chunk(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        one = q.Chunk(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert one.votes().tolist()[0] == whole.votes()[i].tolist()
        assert one.count[0] == len(t.split())
        d, s, w = whole.slots()
        a = np.bincount(s[d == i], weights=w[d == i], minlength=q.SLOTS)
        d, s, w = one.slots()
        assert np.allclose(a, np.bincount(s, weights=w, minlength=q.SLOTS))


def test_edge_rows(spark):
    good = " ".join("Plain words make a sentence here.".split() * 5)
    rows = [(i, "%s Number %d." % (good, i)) for i in range(40)] + [(100, None), (101, ""), (102, "x " * 50000), (None, good), (3, "%s Number 3." % good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("extra"))
    got = {(r.doc_id, r.text): r for r in q.classify(docs).collect()}
    assert len(got) == len(rows) - 1 and not got[(100, None)].keep and not got[(101, "")].keep
    assert all(r.hash == "extra" for r in got.values())
    assert q.classify(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        q.classify(docs.withColumn("Keep", F.lit(1)))
