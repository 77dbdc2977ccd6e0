import random

from pyspark.sql import functions as F

import maskloom.operators.scan as sc
import maskloom.runtime as rt


def brute(texts, patterns, words, fold):
    out = set()
    for i, t in texts:
        for p in patterns:
            for at in range(len(t) - len(p) + 1):
                piece = t[at : at + len(p)]
                if (piece.lower() == p.lower()) if fold else piece == p:
                    left = t[at - 1] if at else " "
                    right = t[at + len(p)] if at + len(p) < len(t) else " "
                    if not words or not (left.isalnum() or right.isalnum()):
                        out.add((i, at, at + len(p), p))
    return out


def fixture(seed, alphabet="abé -A1", n=25):
    rnd = random.Random(seed)
    word = lambda lo, hi: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi)))
    patterns = {}
    for p in [word(1, 14) for _ in range(40)]:
        patterns.setdefault(p.lower(), p)
    patterns = list(patterns.values())
    texts = [(i, " ".join(rnd.choice(patterns) if rnd.random() < 0.5 else word(1, 9) for _ in range(20))) for i in range(n)]
    return texts, patterns


def run(spark, texts, patterns, words, fold):
    units = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([(p, p) for p in patterns], "pattern string, p string")
    hits = sc.scan(units, ["id"], table, words=words, fold=fold)
    rows = hits.select("id", "start", "end", "p").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_scan_equals_brute_force(spark):
    for seed, words, fold in ((1, False, False), (2, True, True), (3, True, False)):
        texts, patterns = fixture(seed)
        assert run(spark, texts, patterns, words, fold) == brute(texts, patterns, words, fold)


def test_scan_long_patterns_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(sc, "WINDOW", 8)
    monkeypatch.setattr(sc, "CHUNK", 32)
    texts, patterns = fixture(4)
    for words, fold in ((False, False), (True, True)):
        assert run(spark, texts, patterns, words, fold) == brute(texts, patterns, words, fold)


def test_no_patterns(spark):
    assert run(spark, [(1, "abc")], [], True, True) == set()


def test_salted_join_equals_plain_join(spark, monkeypatch):
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id")
    right = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = left.join(right, "k", "left").agg(F.count("*"), F.sum("v"), F.sum("id")).first()
    monkeypatch.setattr(rt, "fits_broadcast", lambda *a, **k: False)
    got = rt.spread_join(left, right, ["k"], "left")
    assert got.agg(F.count("*"), F.sum("v"), F.sum("id")).first() == want
    assert rt.spread_join(left, right.where("k = 7"), ["k"], "left_anti").count() == left.where("k <> 7").count()


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    rows = rt.global_rank(df, [F.col("x")]).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.x for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1000))


def test_broadcast_bound(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 20, "s string")
    assert rt.fits_broadcast(df, rows=20, size=100_000)
    assert not rt.fits_broadcast(df, rows=19, size=100_000)
    assert not rt.fits_broadcast(df, rows=20, size=10_000)


def test_brief_texts_give_what_long_ones_give(spark, monkeypatch):
    texts, patterns = fixture(5, "aB😀é 1-", 40)
    texts += [(1000 + i, t * 9) for i, t in texts[:5]]
    for words, fold in ((True, True), (False, False)):
        monkeypatch.setattr(sc, "BRIEF", 256)
        brief = run(spark, texts, patterns, words, fold)
        monkeypatch.setattr(sc, "BRIEF", 0)
        assert brief == run(spark, texts, patterns, words, fold) and brief


def test_spans_are_sorted_without_an_ordering_made_for_each_pair(spark):
    from maskloom.operators import detect

    spans = spark.createDataFrame([(1, 0, 5, "A"), (1, 3, 9, "B"), (1, 3, 9, "B"), (1, 9, 12, "C"), (2, None, 4, "D")], "id int, start int, end int, entity_type string")
    kept = detect.resolve(spans, ["id"], prefer="length")
    assert sorted((r.id, r.start or -1, r.end) for r in kept.collect()) == [(1, 3, 9), (1, 9, 12), (2, -1, 4)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
