import hashlib
import random
import re

from pyspark.sql import functions as F

from maskloom.llm import multiset_hash as mh


def text(rng, n):
    return "".join(rng.choice(["\n", " "] if rng.random() < 0.3 else [" "]) + "w%d" % rng.randrange(500) for _ in range(n))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((doc, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return mh.op8_multiset_hash(spark, str(tmp_path)).collect()


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3, text(rng, rng.randrange(200))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "é\U0001F600" * 31), (1, rows[5][1]), (9, "same id"), (None, "no id"), (700, text(rng, 30000))]
    got = run(spark, rows, tmp_path)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute(rows)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {1, 15} in by_text.values() and len(by_text) == len(rows) - 2  # the copy, and null beside empty
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.35
    assert sum(r.near_next for r in long) / len(long) < 0.2


def test_one_document_follows_itself(spark, tmp_path):
    (r,) = run(spark, [(4, "abcd")], tmp_path)
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_order_independent_and_incremental(spark):
    rows = [(1, "a b c d\ne f g\nh"), (2, "h\na b c d\ne f g"), (3, "a b c d\nh"), (4, "e f g"), (5, "a b c\nd e f g\nh"), (6, "h\nh")]
    lanes = mh.lanes_of(spark.createDataFrame(rows, "id long, text string"), ["id"])
    x = {r.id: r.lanes for r in lanes.collect()}
    assert x[1] == x[2] and x[1] != x[5] and x[6] != x[1]
    pair = spark.createDataFrame([(x[1], x[3], x[4])], "a array<long>, b array<long>, c array<long>")
    r = pair.select(mh.combined(F.col("b"), F.col("c")).alias("plus"), mh.combined(F.col("a"), F.col("c"), -1).alias("minus")).first()
    assert r.plus == x[1] and r.minus == x[3]


def brute_lanes(spark, text):
    """The lanes of one text, added up in Python from the engine's 64-bit hashes."""
    out = [0] * 73
    for paragraph in (text or "").split("\n"):
        words = re.split("[\x20\x09-\x0d]+", paragraph)
        wide = spark.createDataFrame([(paragraph,)], "p string").select(*[F.xxhash64(F.lit(i), "p") for i in range(4)]).first()
        for i, h in enumerate(wide):
            out[2 * i] += h & 0xFFFFFFFF
            out[2 * i + 1] += (h >> 32) & 0xFFFFFFFF
        rows = [(words[i], *(words[i + k] if i + k < len(words) else None for k in (1, 2))) for i in range(len(words))]
        for (h,) in spark.createDataFrame(rows, "w string, w2 string, w3 string").select(F.xxhash64("w", "w2", "w3")).collect():
            out[8] += 1
            for j in range(64):
                out[9 + j] += (h >> j) & 1
    return [x % (1 << 32) for x in out]


def test_fingerprints_and_likeness_match_brute_force(spark, tmp_path):
    texts = ["a b c d\ne f", "", "one\n\none", "e f\na b c d", "x " * 40]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, edited string, place int").write.parquet(f"{tmp_path}/documents.parquet")
    lanes = [brute_lanes(spark, t) for t in texts]

    def likeness(a, b):
        signs = [[2 * x - v[8] for x in v[9:]] for v in (a, b)]
        apart, own = sum((x - y) ** 2 for x, y in zip(*signs)), sum(x * x for v in signs for x in v)
        return 1.0 if a == b else max(0.0, 1 - apart / own) if own else 0.0

    for r in mh.op8_multiset_hash(spark, str(tmp_path)).collect():
        after = texts[(r.doc_id + 1) % len(texts)]
        text, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        edited = brute_lanes(spark, text[: len(text) - half] + after[:half])
        assert r.fingerprint == "".join("%08x" % x for x in lanes[r.doc_id])
        assert r.edited_fingerprint == "".join("%08x" % x for x in edited)
        assert abs(r.near_edited - likeness(lanes[r.doc_id], edited)) < 1e-9
        assert abs(r.near_next - likeness(lanes[r.doc_id], lanes[(r.doc_id + 1) % len(texts)])) < 1e-9


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
