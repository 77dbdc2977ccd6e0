import json
import re

import pytest
from pyspark.sql import functions as F

from maskloom.operators import demask
from maskloom.plans.mask import mask
from maskloom.plans.records import mask_calls
from maskloom.policy import REPLACE, EntityRule, Policy, default_policy

SECRET = "ghp_abcdefghijklmnopqrstuvwxyz0123456789"
TEXTS = {
    1: f"mail jane.coleman@example.com, (555) 867-5309 4111-1111-1111-1111 see https://a.b/x?y=1 {SECRET} C059079JARF 123-45-6789",
    2: '{"user":{"name":"Bob O\'Neil","contacts":[{"value":"x@y.com \\"q\\" John Smith"},"plain",3,null],"first_name":"John","last_name":"Smith"},"t":"é"}',
    3: "<p title='x@y.com'>Hello &amp; <b>John&nbsp;Smith</b> and Bob O&#39;Neil</p> tail",
    4: "JOHN SMITH called 555-867-5309; Paris wright playwright",
    5: "",
    6: None,
    7: "nothing at all",
}
REALS = ["jane.coleman@example.com", "867-5309", "4111-1111-1111-1111", SECRET, "123-45-6789", "Bob O", "John Smith", "JOHN SMITH", "Paris"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, text string")


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame([("Paris", "LOCATION", 0.9), ("Hello", "PERSON", 0.5)], "term string, entity_type string, score double")


@pytest.fixture(scope="module")
def done(docs, gazetteer, key):
    return mask(docs, ["id"], default_policy(), key, gazetteer=gazetteer)


def texts_of(df, column="text"):
    return {r.id: r[column] for r in df.collect()}


def test_no_leakage_and_rest_unchanged(done):
    out = texts_of(done.documents)
    for text in out.values():
        for real in REALS:
            assert text is None or real not in text, (real, text)
    assert out[5] == "" and out[6] is None and out[7] == TEXTS[7]
    assert "https://a.b/x?y=1" in out[1] and "C059079JARF" in out[1] and "Hello &amp;" in out[3]
    assert "playwright" in out[4]


def test_json_stays_valid_with_same_keys(done):
    got, want = json.loads(texts_of(done.documents)[2]), json.loads(TEXTS[2])
    assert got.keys() == want.keys() and got["user"].keys() == want["user"].keys()
    assert got["user"]["contacts"][1:] == ["plain", 3, None] and got["t"] == "é"


def test_tags_unchanged(done):
    assert re.findall("<[^>]*>", texts_of(done.documents)[3]) == re.findall("<[^>]*>", TEXTS[3])


def test_round_trip(done):
    back = texts_of(demask.demask(done.documents.select("id", "text"), ["id"], done.vault), "demasked")
    assert back[1] == TEXTS[1] and back[7] == TEXTS[7]
    assert json.loads(back[2]) == json.loads(TEXTS[2])
    assert back[4].lower() == TEXTS[4].lower()  # other letter case comes back as stored


def test_same_on_one_and_many_partitions_and_stable(spark, docs, done, gazetteer, key):
    again = mask(docs.coalesce(1), ["id"], default_policy(), key, gazetteer=gazetteer)
    assert texts_of(again.documents) == texts_of(done.documents)
    more = mask(docs, ["id"], default_policy(), key, done.vault, gazetteer=gazetteer)
    assert texts_of(more.documents) == texts_of(done.documents) and more.added.isEmpty()


def test_calls(spark, done, key):
    policy = default_policy().with_(sensitive_args=("vault:*",))
    known = {r.real_value: r.surrogate for r in done.vault.collect()}
    rows = [
        (1, "s", "t", json.dumps({"q": known["John Smith"].upper()}), [("text", "mail x@y.com"), ("image", "x@y.com")]),
        (2, "s", "u", '{"l":["vault:x"]}', [("text", "whole blob x@y.com")]),
        (3, "s", "v", "{}", [("text", "clean")]),
    ]
    calls = spark.createDataFrame(rows, "id int, server string, tool_name string, args string, content array<struct<type:string,text:string>>")
    out, events = mask_calls(calls, ["id"], policy, key, done.vault)
    got = {r.id: r for r in out.documents.collect()}
    assert json.loads(got[1].args) == {"q": "John Smith"} and got[1].demapped_count == 1
    assert [c.text for c in got[1].content][1:] == ["x@y.com", "[PII surrogated — pass back verbatim]"]
    assert got[1].content[0].text == "mail " + known["x@y.com"]
    assert got[2].sensitive and "blob" not in got[2].content[0].text and got[2].entity_types == ["SECRET"]
    assert [c.text for c in got[3].content] == ["clean"]
    assert {(r.id, r.direction) for r in events.collect()} == {(1, "demap"), (1, "mask"), (2, "mask")}


def test_json_with_outer_white_space_or_non_finite_numbers_is_masked(spark, key):
    from maskloom.functions.filters import is_json

    secret = '{"a":{"password":"hunter33"}}'
    texts = [secret, secret + "\n", "\n " + secret + "\r\n", "\t" + secret, '{"n":NaN,"a":{"password":"hunter33"}}', '[-Infinity, {"password":"hunter33"} ]']
    others = ["{'a': 1}", secret + " tail", "[NaN", "NaN", '{"n":NaNa}', ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + others)], "doc_id long, text string")
    got = {r.doc_id: r.json for r in rows.select("doc_id", is_json(F.col("text")).alias("json")).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * len(texts)
    assert not any(got[i] for i in range(len(texts), len(got)))
    done = mask(rows.where(F.col("doc_id") < len(texts)), ["doc_id"], default_policy(), key)
    assert not [r.text for r in done.documents.collect() if "hunter33" in r.text]


def test_names_under_never_mask_paths_are_not_learned(spark, key):
    from dataclasses import replace

    policy = replace(default_policy(), never_mask_paths=("skip",))
    rows = [(1, '{"skip":{"first_name":"Johnny","last_name":"Smithers"}}'), (2, "Met Johnny Smithers today.")]
    done = mask(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], policy, key)
    assert {r.doc_id: r.text for r in done.documents.collect()} == dict(rows)
    assert done.added.count() == 0


def test_results_of_any_shape(spark, key):
    policy = Policy(entities={"EMAIL_ADDRESS": EntityRule(REPLACE)}, sensitive_args=("*raw*",))
    vault = mask(spark.createDataFrame([(0, "x")], "id int, text string"), ["id"], policy, key).vault
    layout = "array<struct<text:string,data:binary,size:struct<w:int>,type:string>>"
    rich = [(1, "{}", [("a@b.com", None, None, "text"), ("a@b.com", bytearray(b"png"), (3,), "image"), (None, None, None, "text")]), (2, '{"k":"raw"}', [("blob 1", None, None, "text")]), (3, "{}", None), (4, "{}", [])]
    shapes = {layout: rich, "string": [(1, "{}", "to a@b.com"), (2, '{"k":"raw"}', "blob 1"), (3, "{}", None), (4, "{}", "")]}
    shapes["array<string>"] = [(1, "{}", ["ok", "a@b.com", None]), (2, '{"k":"raw"}', ["blob 1"]), (3, "{}", None), (4, "{}", [])]
    notice = "[PII surrogated — pass back verbatim]"
    for kind, rows in shapes.items():
        calls = spark.createDataFrame([(i, "s", "t", a, c) for i, a, c in rows], f"id int, server string, tool_name string, args string, content {kind}")
        done, _ = mask_calls(calls, ["id"], policy, key, vault)
        assert done.documents.schema["content"].dataType.simpleString() == calls.schema["content"].dataType.simpleString()
        got = {r.id: r.content for r in done.documents.collect()}
        assert got[3] is None and not got[4]
        if kind == "string":
            assert got[1] == "to <EMAIL_ADDRESS>\n\n" + notice and "blob" not in got[2]
        elif kind == layout:
            assert [(x.text, x.type) for x in got[1]] == [("<EMAIL_ADDRESS>", "text"), ("a@b.com", "image"), (None, "text"), (notice, "text")]
            assert got[1][1].data == b"png" and got[1][1].size.w == 3 and "blob" not in got[2][0].text
        else:
            assert got[1] == ["ok", "<EMAIL_ADDRESS>", None, notice] and "blob" not in got[2][0]


def test_results_of_calls_are_computed_once(spark, key):
    seen = spark.sparkContext.accumulator(0)

    def said(number):
        seen.add(1)
        return f"write to u{number}@corp.example.org"

    calls = spark.range(20).select(
        F.col("id"), F.lit("s").alias("server"), F.lit("t").alias("tool_name"), F.lit('{"q":"x"}').alias("args"), F.udf(said)("id").alias("content")
    )
    vault = spark.createDataFrame([("PERSON", "Ann Lee", "Bea Roe", 0, False)], "entity_type string, real_value string, surrogate string, seq long, derived boolean")
    done, events = mask_calls(calls, ["id"], default_policy(), key, vault)
    assert done.documents.where("masked_count = 1").count() == 20 == events.count()
    assert seen.value == 20
