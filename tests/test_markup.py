import json
import random
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions import filters, markup
from maskloom.functions.spans import BLOCK, cut, parts_of, regex_spans, walk
from maskloom.functions.splice import splice
from maskloom.operators import detect
from maskloom.plans.mask import mask
from maskloom.policy import default_policy


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def document(leaves):
    return json.dumps({"rows": [{"name": f"n{i}", "x": {"email": f"e{i}@x.org"}} for i in range(leaves // 2)]})


def seconds(spark, text, column):
    took = []
    for _ in range(2):
        began = time.time()
        one(spark, text, column)
        took.append(time.time() - began)
    return min(took)


def test_time_grows_with_the_document_not_with_its_square(spark):
    html = ["".join(f"<p>text {i} &amp; more</p>" for i in range(n)) for n in (32_000, 64_000)]
    walks = [
        (document(32_000), document(64_000), lambda t: F.size(markup.decoded_leaves(markup.json_leaves(t), True))),
        (*html, lambda t: F.size(markup.decoded_pieces(t, True))),
        (*html, lambda t: F.size(regex_spans(t, "[0-9]+"))),
    ]
    for half, full, column in walks:
        one(spark, document(200), column)
        assert seconds(spark, full, column) <= 2.5 * seconds(spark, half, column) + 0.3


@pytest.mark.parametrize("n", [0, 1, BLOCK, BLOCK + 1, BLOCK**2 + 3, BLOCK**3 + 5])
def test_a_walk_meets_every_item_in_order(spark, n):
    items = F.when(F.lit(n) == 0, F.lit([]).cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(n)))
    sums = walk(items, F.lit(0), "array<int>", lambda a, x: (a + x, F.when(x % 3 != 0, F.array(a + x)).otherwise(F.lit([]).cast("array<int>"))))
    assert spark.range(1).select(sums).first()[0] == [i * (i + 1) // 2 for i in range(1, n + 1) if i % 3]


def test_splice_and_cut_over_many_parts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab é😀") for _ in range(30_000))
    places = sorted(rng.sample(range(30_001), 40))
    edits = [(a, b, "<%d>" % i) for i, (a, b) in enumerate(zip(places[::2], places[1::2]))]
    want, at = "", 0
    for a, b, r in edits:
        want, at = want + text[at:a] + r, b
    df = spark.createDataFrame([(text, edits)], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(splice(F.col("t"), F.col("e"))).first()[0] == want + text[at:]
    for a, b in [(0, 0), (0, 30_000), (4095, 4097), (4096, 4096), (100, 29_999), (29_999, 30_000)]:
        assert df.select(cut(parts_of(F.col("t")), F.lit(a), F.lit(b))).first()[0] == text[a:b]


def test_json_is_what_a_parser_without_limits_takes(spark):
    pad, rng = " " * 1100, random.Random(1)
    deep = '{"a":{"password":"secret"},"d":' + "[" * 1200 + "1" + "]" * 1200 + "}"
    cases = [deep, deep[:-1], deep.replace("1]", "1,]", 1), "[" + "1" * 1500 + "]", '{"' + "k" * 60_000 + '":1}', '{"a":"' + "\\n" * 60_000 + '"}', "\n[NaN] \t", "{}"]
    cases += [x + pad for x in ("[1,2}", '{"a":1,}', "[1 2]", '{"a" "b"}', '["\\x"]', "[01]", "['a']", "[NaN,-Infinity,1e5,-0.5E+3]", '{"a":{},"b":[],"c":[{}]}', "[][]", '["a]', "[tru]", "[-]", "[1.]", "{1:2}", "[[]]]", '["\\ud83d\\ude00 \\u00e9"]', "{:1}", "[,]")]
    signs = ["{", "}", "[", "]", ",", ":", '"a"', "1", "true", " "]
    cases += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    base = json.dumps({"a": [1, {"b": []}, None, "x"], "c": {"d": {}}})
    cases += [base[:i] + rng.choice([*signs, ""]) + base[i + 1 :] + rng.choice(["", pad]) for i in range(len(base))]

    def want(text):
        try:
            return isinstance(json.loads(text), (dict, list))
        except (ValueError, RecursionError):
            return False

    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string").repartition(4)
    rows = df.select("i", filters.is_json(F.col("text")).alias("json"), filters._walks(F.col("text")).alias("walked")).collect()
    for r in rows:
        text = cases[r.i]
        if len(text) < 3000 or "[[[" not in text:
            assert r.json == want(text), text[:60]
        if text.strip()[:1] in ("{", "["):
            assert r.walked == r.json, text[:60]
    assert [r.json for r in sorted(rows)[:3]] == [True, False, False]


def test_values_past_the_parser_limits_do_not_leak(spark, key):
    long = '{"a":{"password":"secretX"},"d":"' + "z" * 21_000_000 + '"}'
    assert one(spark, long, filters.is_json)
    texts = ["[" * 1200 + '{"password":"secret1200abc"}' + "]" * 1200, '{"n":' + "1" * 1500 + ',"a":{"password":"secret1200abc"}}', '\n {"a":{"password":"secret1200abc"},"x":NaN} ']
    texts.append('{"' + "k" * 60_000 + '":{"password":"secret1200abc"}}')
    docs = spark.createDataFrame(list(enumerate(['{"a":{"password":"secret1200abc"}}', *texts])), "doc_id int, text string")
    done = mask(docs, ["doc_id"], default_policy(), key).documents.collect()
    for r in done:
        assert "secret1200abc" not in r.text, r.doc_id


def test_items_of_one_object(spark):
    text = json.dumps({"result": {"content": [{"type": "text", "text": "a"}, {"text": "b", "type": "text"}, {"type": "image", "text": "c"}, {"text": "d"}]}})
    rows = one(spark, text, lambda t: markup.siblings(markup.json_leaves(t), "result.content.type", "text", "result.content.text"))
    assert [r.raw for r in rows] == ["a", "b"]


def test_deep_texts_are_decided_without_a_walk_of_their_brackets(spark):
    """Time with the square of the depth would take minutes here."""
    deep = "[" * 200_000 + "]" * 200_000
    began = time.time()
    assert one(spark, '{"a":' + deep + "}", filters.is_json)
    assert not one(spark, "[" + deep, filters.is_json) and not one(spark, "[" + deep + "}]", filters.is_json)
    assert time.time() - began < 30


def test_closing_brackets_too_many_past_the_parser_limits(spark):
    pad = " " * 1100
    texts = {"{}}": False, "[]]": False, "{}]}": False, "[]}]": False, '{}},"w":{}': False, "[],[]": False, "{},{}": False, '[{"broken":"x"}]': True}
    rows = spark.createDataFrame([(t[0] + pad + t[1:], ok) for t, ok in texts.items()], "text string, ok boolean")
    assert rows.where(filters.is_json(F.col("text")) != F.col("ok")).count() == 0


def test_the_walk_over_a_document_is_not_repeated_in_filters(spark):
    docs = spark.createDataFrame([(1, '{"a":"x"}')], "id long, text string")
    for rows in (detect.leaves(docs, ["id"]), detect.pieces(detect.leaves(docs, ["id"]), ["id"])):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]


def test_leaves_of_spaced_and_nested_json(spark):
    text = ' {"a" : "x\\"y" , "b":[ "1", {"c":2, "d" :"z"}, "w" ],"e":{} ,"f":"[{:,"} '
    got = one(spark, text, markup.json_leaves)
    assert [(r.path, r.key, r.obj, r.raw) for r in got] == [
        ("a", "a", 1, 'x\\"y'), ("b", "b", 1, "1"), ("b.d", "d", 2, "z"), ("b", "", 1, "w"), ("f", "f", 1, "[{:,")
    ]
    assert all(text[r.start : r.start + len(r.raw)] == r.raw for r in got)


def test_listed_leaves_are_those_of_the_walk(spark):
    """Texts of usual length are listed in Python, a batch at a time, not folded token by token."""
    texts = [
        "{}", "[]", '["a",[["b"]],{"k":["c",{"":"d"}]}]', '{"a":{"b":"x","c":{"d":"y"}},"e":"z"} ', '{"é😀":{"n\\"{":"a:b","t":"\\u00e9"}}',
        '{"\\ud83d\\ude00":{"k":"v"},"\\ud800":{"k":"v","l":["w"]}}', '{"\\udc00\\udc00":{"k":"v"}}', '{"a" : "x" , "a":"y",\n"b":[1,"s",null]}',
        '{"long":"' + "x" * 20_000 + '"}', '[{"a":"1"},{"a":"2"}]', "1", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", markup.json_leaves(F.col("t")).alias("got"), markup._walked(F.col("t")).alias("want"))
    for row in rows.collect():
        assert row.got == row.want, row.t
    plan = rows.select("got")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    decoded = one(spark, '{"a":"x\\ny","b":"z"}', lambda t: markup.decoded_json(t, markup.json_leaves(t)))
    assert [(x.path, x.text, len(x.leaf_moved)) for x in decoded] == [("a", "x\ny", 1), ("b", "z", 0)]


def test_parser_reads_over_a_text_without_a_copy(spark):
    texts = {'{"a":[1,{"b":null}]}': True, '{"a":1}]': False, '{"a":1},{"b":2}': False, "[1],[2]": False, '["\\x"]': False, "['a']": False, '["it\'s"]': True, "[NaN,-Infinity]": True, '["NaN"': False, "[1,]": False}
    for text, want in texts.items():
        assert one(spark, text, filters.is_json) is want, text
    plan = spark.range(1).select(filters.is_json(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "get_json_object" not in plan
