import hashlib
import hmac
import re

from pyspark.sql import functions as F

from maskloom.functions import filters, markup, recognizers, surrogates, text as tx
from maskloom.functions.fpe import fpe
from maskloom.functions.spans import regex_spans
from maskloom.operators import fields, scan
from maskloom.policy import FPE, EntityRule, Policy, default_policy, glob_regex, policy_table, read_policy, write_policy


def found(spark, text, column):
    row = spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("f")).first()
    return [(f.entity_type, f.start, f.end, f.value) for f in row.f]


def cipher(spark, values, key, tweak, decrypt=False):
    rules = policy_table(spark, Policy(entities={"X": EntityRule(FPE, tweak=tweak)}), key)
    df = spark.createDataFrame([("X", v) for v in values], "entity_type string, v string").join(F.broadcast(rules), "entity_type")
    return {r.v: r.o for r in fpe(df, "v", "o", decrypt).select("v", "o").collect()}


def test_fpe_published_vectors(spark):
    one = cipher(spark, ["890121234567890000"], "EF4359D8D580AA4F7F036D6F04FC6A94", "D8E7920AFA330A73")
    two = cipher(spark, ["3992520240"], "2DE79D232DF5585D68CE47882AE256D6", "CBD09280979564")
    assert one == {"890121234567890000": "750918814058654607"}
    assert two == {"3992520240": "8901801106"}


def test_fpe_keeps_format_and_reverses(spark, key):
    values = ["123-45-6789", "4111-1111-1111-1111", "(555) 867-5309", "0000000", "1" * 28, "9" * 29, "12-" + "0123456789" * 5, "9" * 56]
    made = cipher(spark, values, key, "CBD09280979564")
    for v, s in made.items():
        assert s != v and [c.isdigit() or c for c in s] == [c.isdigit() or c for c in v]
    assert cipher(spark, list(made.values()), key, "CBD09280979564", decrypt=True) == {s: v for v, s in made.items()}
    assert cipher(spark, ["no digits", "1" * 57], key, "CBD09280979564") == {"no digits": None, "1" * 57: None}


def test_hmac_is_the_standard_one(spark, key):
    rules = policy_table(spark, default_policy(), key)
    df = spark.createDataFrame([("PERSON", "Jörg Müller")], "entity_type string, real_value string").join(F.broadcast(rules), "entity_type")
    got = df.select(surrogates.hmac_hex(surrogates.mac_message(F.col("entity_type"), F.col("real_value"), 3))).first()[0]
    assert got == hmac.new(key.encode(), "PERSON:Jörg Müller:3".encode(), hashlib.sha256).hexdigest()


def test_recognizers_next_to_accents(spark):
    p = default_policy()
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    assert found(spark, f"é{key}", lambda t: recognizers.custom_findings(t, p)) == []
    assert found(spark, f"ñ {key}.", lambda t: recognizers.custom_findings(t, p)) == [("SECRET", 2, 22, key)]
    assert found(spark, "ßa@b.com", recognizers.builtin_findings) == [("EMAIL_ADDRESS", 1, 8, "a@b.com")]
    assert found(spark, "tel 555-867-5309é", recognizers.builtin_findings) == []
    assert found(spark, "666-12-3456 000-12-3456 912-12-3456 123-00-4567", recognizers.builtin_findings) == []
    assert found(spark, "card 4111-1111-1111-1112", recognizers.builtin_findings) == []


def test_domain_never_hides_an_email(spark):
    df = spark.createDataFrame([("jane.coleman@example.com and jane.co.smith@example.com",)], "t string")
    row = df.select(
        F.filter(
            recognizers.builtin_findings(F.col("t")),
            lambda f: filters.unprotected(f["entity_type"], f["start"], f["end"], filters.protected_spans(F.col("t"))),
        ).alias("f")
    ).first()
    assert [f.value for f in row.f] == ["jane.coleman@example.com", "jane.co.smith@example.com"]


def test_json_leaves_have_exact_places(spark):
    t = '{"a":{"b":"x\\"y","l":["p",{"c":"\\u00e9z"},[1,"q"]]},"e":"","n":null,"k:":":,{}"}'
    df = spark.createDataFrame([(t,)], "t string")
    leaves = df.select(markup.json_leaves(F.col("t")).alias("l")).first().l
    assert [(x.path, t[x.start : x.start + len(x.raw)] == x.raw) for x in leaves] == [
        ("a.b", True), ("a.l", True), ("a.l.c", True), ("a.l", True), ("e", True), ("k:", True),
    ]
    valid = spark.createDataFrame(
        [('{"a":1} x',), ("{'a':1}",), ('{"a":1}{"b":2}',), ('{"a":1,"a":2}',), ("[]",), ('"s"',), ('{"q":"it\'s"}',)], "t string"
    )
    assert [r[0] for r in valid.select(filters.is_json(F.col("t"))).collect()] == [False, False, False, True, True, False, True]


def test_html_predicate_and_preview(spark):
    df = spark.createDataFrame([("<b>x</b>",), ("<mailto:a@b.c>",), ("<https://x>",), ("a < b",), ("<br/>",)], "t string")
    assert [r[0] for r in df.select(tx.looks_like_html(F.col("t"))).collect()] == [True, False, False, False, True]
    df = spark.createDataFrame([("abcd",), ("abcdef",)], "t string")
    assert [r[0] for r in df.select(tx.preview(F.col("t"))).collect()] == ["****", "ab**ef"]


def test_names(spark):
    p = default_policy().with_(allow_list=("Acme",))
    rows = ["Nando Sangenetto", "J. Smith", "Anna", "created by", "Unit 7 Bay", "Acme Person", "Ñandú Óscar", "a" * 81]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(~tx.name_rejected(F.col("t"), p) & tx.name_structure(F.col("t"))).collect()]
    assert got == [True, True, False, False, False, False, True, False]


def test_globs(spark):
    cases = [("*.email", "a.b.email", True), ("*.email", "email", False), ("*.Email", "a.email", False), ("k[!0]?", "k1x", True),
             ("k[!0]?", "k0x", False), ("a.b", "aXb", False), ("x*", "x\ny", True)]
    for pattern, value, want in cases:
        df = spark.createDataFrame([(value,)], "t string")
        assert df.select(F.col("t").rlike(glob_regex(pattern))).first()[0] is want, pattern


def test_policy_round_trip(tmp_path):
    p = default_policy().with_(never_mask_paths=("a.*",), sensitive_args=("vault/*",), allow_list=("Ünï",), notice=False)
    write_policy(p, tmp_path / "p.yaml")
    assert read_policy(tmp_path / "p.yaml") == p


def test_spans_without_a_split(spark):
    """``split`` compiles its pattern for each row; the gaps come from a pattern that is kept."""
    texts = ["", "a1", "é😀a12 b3\nc45", "1", "xx", "12\n\n3", "a😀" * 300 + "7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, at in ((r"(?<![0-9])[0-9]+", r"(?<![0-9])[0-9]+"), (r"(?i)A(?=[0-9])|B", r"(?i)a(?=[0-9])|b"), (r"([0-9])\1?", r"([0-9])\1?"), (r"^a|3$", r"^a|3\Z")):
        for row in df.select("t", regex_spans(F.col("t"), pattern).alias("s")).collect():
            assert [tuple(x) for x in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(at, row.t)], (pattern, row.t)
    plan = df.select(regex_spans(F.col("t"), "[0-9]+"))._jdf.queryExecution().optimizedPlan().toString()
    assert "WHEN exists" in plan or "CASE WHEN exists" in plan, plan


def test_first_characters_are_listed(spark):
    got = scan._first_characters(spark.createDataFrame([("kim",), ("ſet",), ("Ωx",), ("1",)], "pattern string"), True)
    assert not got.startswith("(?iu")
    assert all(re.search(rf"\\x\{{{ord(c):X}\}}", got) for c in "kK\u212aſΩω\u21261"), got


def test_texts_without_a_field_rule_are_not_looked_at(spark):
    rows = spark.createDataFrame([("", "", 0, 0, "a@b.com"), ("x.password", "password", 0, 0, "a@b.com")], "path string, key string, leaf_no int, obj int, text string")
    judged = fields.with_field_entity(rows, default_policy())
    assert [r.entity_type for r in judged.orderBy("path").collect()] == [None, "EMAIL_ADDRESS"]
    assert "<=> SECRET" in judged._jdf.queryExecution().analyzed().toString()


def test_numbers_that_only_look_alike_pass_the_cheap_tests(spark):
    tests = {entity: test for entity, _, test, _, _ in recognizers.BUILTIN}
    assert not re.search(tests["PHONE_NUMBER"], "123-45-6789") and not re.search(tests["CREDIT_CARD"], "123-45-6789 2024")
    for text in ("(200) 555-0001", "2005550001", "+1 200.555.0001"):
        assert [x[0] for x in found(spark, text, recognizers.builtin_findings)] == ["PHONE_NUMBER"], text
    for text in ("4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "3782-822463-10005", "3782 822463 10005"):
        assert "CREDIT_CARD" in [x[0] for x in found(spark, text, recognizers.builtin_findings)], text


def test_spans_of_matches_that_are_there_more_than_once(spark):
    pattern = r"(?<![a-z0-9])[0-9]{3}(?![0-9])"
    texts = ["x123 123", "123", "😀 123é 456", "1234 234 x 999", "111 222 333 444 555", "aa 121 212 1212", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", regex_spans(F.col("t"), pattern).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.end, s.value) for s in got[i]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "")]


def test_one_match_is_found_without_the_text_before_it(spark, monkeypatch):
    from maskloom.functions import spans

    def gaps(text, pattern, found):
        return F.transform(found, lambda _: F.raise_error(F.lit("the second pass")).cast("string"))

    monkeypatch.setattr(spans, "_gaps", gaps)
    rows = spark.createDataFrame([("to a@b.com é",)], "t string")
    assert [tuple(s) for s in rows.select(regex_spans(F.col("t"), "[a-z]+@[a-z.]+").alias("f")).first().f] == [(3, 10, "a@b.com")]


def test_flat_objects_need_no_parser_and_nothing_else_passes_for_one(spark):
    flat = ['{"a":"b"}', '{"a":"b","n":-12,"t":true,"x":null}', '{"é 😀":0}']
    others = ['{"a":01}', '{"a":"b"}}', '{"a":"b",}', '{a:1}', '{"a":"b"}],[{"c":1}', '{"a":\'b\'}', '{"a":+1}', '{"a" 1}']
    kept = ['{"a":"\x01"}', "{}", '{"a":{"b":[1]}}', '{"a":"\\n"}', '{"a": 1}', "[]", ' {"a":1} ']
    rows = spark.createDataFrame([(t,) for t in flat + others + kept], "t string")
    got = {r.t: (r.json, r.flat) for r in rows.select("t", filters.is_json(F.col("t")).alias("json"), F.col("t").rlike(filters._FLAT).alias("flat")).collect()}
    assert [got[t] for t in flat] == [(True, True)] * len(flat)
    assert [got[t] for t in others] == [(False, False)] * len(others)
    assert [got[t] for t in kept] == [(True, False)] * len(kept)
