import random
from collections import Counter

import corpus_pipeline as cp
from maskloom.llm import near_dedup as nd


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(3000)]
    rows = []
    for i in range(150):
        body = " ".join(rng.choice(vocab) for _ in range(rng.choice([30, 80, 200])))
        rows.append((i, "%s.\nThe same notice stands at the end of these documents.\nEnd %d." % (body, i), "en", "s%d" % (i % 4), 0))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(10)]
    junk = [(2000 + i, " ".join(rng.choice(vocab).upper() + "!!" for _ in range(50)), "en", "s1", 0) for i in range(20)]
    odd = [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == cp.COLUMNS
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert ids["quality"] == {r[0] for r in rows}
    assert ids["line_dedup"] == ids["quality"]
    assert sum("same notice" in r.text for r in seen["line_dedup"]) == 1
    assert ids["near_dedup"] == {r[0] for r in rows if r[0] < 1000}
    assert ids["mixing"] <= ids["near_dedup"]
    words = {r.doc_id: len(r.text.split()) for r in seen["near_dedup"]}
    took = Counter()
    for r in seen["mixing"]:
        took[r.doc_id] += len(r.text.split())
    assert abs(sum(took.values()) - 1.5 * sum(words.values())) <= 4
    assert all(took[d] <= 2 * words[d] for d in took)
    assert {r.doc_id for r in seen["packing"]} == ids["mixing"]
    again = cp.run(spark, str(tmp_path))
    assert sum(r.length for r in again.collect()) == sum(r.length for r in seen["packing"])


def near(spark, rows, path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    docs.repartition(3).write.parquet(f"{path}/in")
    return sorted((tuple(r)[:2] for r in cp.near_deduplication(spark, spark.read.parquet(f"{path}/in"), str(path)).collect()), key=repr)


def text_of(seed, words=60):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(5000) for _ in range(words))


def test_near_dedup_decides_for_each_row(spark, tmp_path):
    u, v, w, long = text_of(1), text_of(2), text_of(3), text_of(4, 60_000)
    rows = [(1, u), (7, u), (7, v), (9, v + " x"), (20, w), (20, w), (20, w), (None, text_of(5)), (None, text_of(5)), (None, u), (30, None), (30, ""), (None, None), (40, long), (41, long + " end")]
    got = near(spark, [(i, t, "en", "s", 0, "clash") for i, t in rows], tmp_path)
    texts = Counter(t for _, t in got)
    assert texts[u] == texts[w] == texts[text_of(5)] == 1 and texts[v] + texts[v + " x"] == 1 and texts[long] + texts[long + " end"] == 1
    assert (1, u) in got and texts[None] + texts[""] == 3 and len(got) == 8


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert near(spark, [], tmp_path) == []
    assert cp.line_deduplication(spark, docs, str(tmp_path)).count() == 0
    assert cp.source_mixing(spark, docs, str(tmp_path)).count() == 0 and cp.curve_packing(spark, docs, str(tmp_path)).count() == 0
