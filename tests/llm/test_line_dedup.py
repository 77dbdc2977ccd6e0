import hashlib
import random

import pytest
from pyspark.sql import functions as F

from maskloom.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=ld.MIN_CHARS, min_docs=ld.MIN_DOCS):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(h := holders.get(key(x), ())) < min_docs or max(h) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, slices=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
    done = ld.apply_bitmaps(docs, ld.drop_bitmaps(docs))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in done.collect()), key=repr)


def rows_of(seed, hot=0):
    rng = random.Random(seed)
    pool = ["%s line %d " % ("ÄbC" if i % 2 else "x" * 50, i) + "w" * rng.choice([10, 33, 40, 60]) for i in range(30)]
    rows = []
    for d in range(90):
        lines = [rng.choice(["", " \t", ""]) + (x.upper() if rng.random() < 0.2 else x) for x in rng.choices(pool, k=rng.randrange(6))]
        rows.append((d * 7, "\n".join(lines + ["The common line that very many documents hold."] * (rng.random() < hot))))
    return rows + [(None, pool[0]), (5000, None), (5001, ""), (7, pool[0] + "\n" + pool[0]), (14, rows[2][1]), (14, "other\n" + pool[1]), (6000, pool[1] * 9000)]


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.9)])
def test_matches_brute_force(spark, seed, hot):
    rows = rows_of(seed, hot)
    assert run(spark, rows) == brute(rows)


def test_one_hash_over_many_ranges(spark):
    rows = [(i, "The common line that very many documents hold.\nown %d" % i) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ld.apply_bitmaps(docs, ld.drop_bitmaps(docs)).count() == 0


def test_extra_columns_stay_and_clashes_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert ld.apply_bitmaps(docs, ld.drop_bitmaps(docs)).columns == ["doc_id", "text", "source", "kept", "n_lines", "n_dropped"]
    with pytest.raises(ValueError):
        ld.apply_bitmaps(docs.withColumn("Kept", F.lit(1)), ld.drop_bitmaps(docs))
