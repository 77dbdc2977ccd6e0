import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskloom.llm import mixing as mx


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += words(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return sizes, target


def rows_of(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 300, 900])
        source = rng.choice(["a"] * 6 + ["b", "ä", "Z", None, "\U0001F600", ""])
        out.append((i, source, None if rng.random() < 0.05 else " \n".join("w%d" % j for j in range(size))))
    return out + [(3, "a", "same row twice"), (3, "a", "same row twice"), (None, "b", "no id"), (n, "lone", "word " * 4000)]


@pytest.mark.parametrize("block", [64, 256])
def test_targets_are_met_exactly(spark, block):
    rows = rows_of(200)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mx.mix(docs, block_words=block, shards=8).withColumn("taken", mx.taken()).collect()
    assert len(got) == len(rows)
    sizes, target = brute_targets(rows)
    took = Counter()
    shards = Counter()
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        took[r.source] += r.taken
        shards.update({(p.shard, r.source, p.epoch, p.block) for p in r.pieces})
        by_epoch = Counter()
        for p in r.pieces:
            assert 0 <= p.shard < 8 and 0 <= p.from_word and p.from_word + p.words <= r.size
            by_epoch[p.epoch] += p.words
        assert all(v <= r.size for v in by_epoch.values())
    for s in sizes:
        assert took[s] == int(target[s] + 0.5)
    again = mx.mix(docs.repartition(7), block_words=block, shards=8).withColumn("taken", mx.taken()).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)


def test_pieces_as_texts(spark):
    rows = [(i, "ab"[i % 5 == 0], "  " + "é%d \n\t" % i * (i * 7)) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mx.mix(docs, block_words=16, shards=4)
    want = {r.doc_id: r.taken for r in mixed.withColumn("taken", mx.taken()).collect()}
    got = Counter()
    texts = dict((d, t) for d, _, t in rows)
    for r in mx.mixed_texts(mixed).collect():
        assert r.text in texts[r.doc_id] and words(r.text) == r.run.words
        got[r.doc_id] += words(r.text)
    assert got == Counter({k: v for k, v in want.items() if v})


def test_split_tree_keeps_quotas_and_follows_the_law(spark):
    quotas = spark.createDataFrame([("a", 400), ("b", 40), ("c", 0), ("d", 1)], "skey string, quota long")
    seen = []
    for seed in range(12):
        got = mx.split_tree(quotas, 4, seed).collect()
        total, by = Counter(), Counter()
        for r in got:
            total[r.shard] += r.blocks
            by[r.skey] += r.blocks
        assert by == Counter({"a": 400, "b": 40, "c": 0, "d": 1})
        assert max(total.values()) - min(total.values()) <= 1
        seen += [r.blocks for r in got if r.skey == "b"]
    mean = sum(seen) / len(seen)
    var = sum((x - mean) ** 2 for x in seen) / len(seen)
    assert mean == pytest.approx(10) and 2.5 < var < 16  # the law's variance is 6.8


def test_hypergeometric_against_exact_law(spark):
    from math import comb

    n, k, m = 30, 11, 8
    cdf = spark.range(4000).select(F.expr(mx.hypergeometric(str(n), str(k), str(m), "(id + 0.5D) / 4000")).alias("x")).groupBy("x").count().collect()
    for r in cdf:
        assert r["count"] / 4000 == pytest.approx(comb(k, r.x) * comb(n - k, m - r.x) / comb(n, m), abs=1e-3)


def test_permutation_is_one(spark):
    got = spark.range(97).select(mx.permuted(F.col("id"), F.lit(97), F.lit(1)).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(97))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mx.mix(docs).count() == 0


def test_the_tree_decides_which_shard_takes_which_words(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], "w " * 300) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def result():
        mixed = mx.mix(docs, block_words=16, shards=4)
        got = mixed.select("doc_id", mx.taken().alias("taken"), mx.taken_by_shard().alias("by")).collect()
        assert all(r.taken == sum(x.words for x in r.by) and len({x.shard for x in r.by}) == len(r.by) for r in got)
        per_shard = Counter()
        for r in got:
            per_shard.update({x.shard: x.words for x in r.by})
        texts = mx.shuffled(mx.mixed_texts(mixed), 4).withColumn("part", F.spark_partition_id()).collect()
        return {(r.doc_id, *map(tuple, r.by)) for r in got}, per_shard, texts

    before, per_shard, texts = result()
    assert max(per_shard.values()) - min(per_shard.values()) <= 3 * 16 and len(per_shard) == 4
    shards_of = {}
    for part in {r.part for r in texts}:
        each = [(r.shard, r.place) for r in texts if r.part == part]
        assert each == sorted(each)
        shards_of[part] = {s for s, _ in each}
    assert len({r.shard for r in texts}) == 4 and [r.doc_id for r in texts] != sorted(r.doc_id for r in texts)

    def all_in_one(quotas, shards, seed):
        return quotas.selectExpr("skey", "explode(sequence(0, 3)) AS shard", "quota").selectExpr("skey", "shard", "IF(shard = 0, quota, 0L) AS blocks")

    monkeypatch.setattr(mx, "split_tree", all_in_one)
    assert result()[0] != before


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2)], "doc_id long, source string, text string, other long")
    assert "other" in mx.mix(docs).columns
    for name in ("src", "run", "Shard", "place", "pieces", "size"):
        with pytest.raises(ValueError):
            mx.mix(docs.withColumnRenamed("other", name), size=mx.words_of())
