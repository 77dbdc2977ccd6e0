"""One query per operator over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions import filters, markup, recognizers as rec, surrogates as sur, text as tx
from maskloom.functions.fpe import fpe
from maskloom.functions.spans import SPACE
from maskloom.functions.splice import splice
from maskloom.operators import assign as asg, audit, demask, detect, fields, vault as v
from maskloom.plans import inputs as inp
from maskloom.plans.inputs import load
from maskloom.plans.mask import discover, mask
from maskloom.plans.records import mask_calls, mask_columns, mask_envelopes, sensitive
from maskloom.policy import (
    REPLACE, SECRET_PATTERNS, EntityRule, FieldRule, Policy, default_policy, hmac_pads, policy_table,
)
from maskloom.runtime import computed, materialize, shared_dir
from maskloom.sources.policy_store import PolicyStore
from maskloom.sources.vault_store import VaultStore, seal, unseal
from maskloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Key of these checks only; real runs pass their own.
CHECK_KEY = "8f0d6a1c52e94b7730c1d2e3f4a5b697"
SEAL_KEY = CHECK_KEY * 2


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def replacing(*entities: str, **more) -> Policy:
    return Policy(entities={e: EntityRule(REPLACE) for e in entities}, **more)


EMAIL_ONLY = replacing("EMAIL_ADDRESS")
RE2_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b"


def docs_of(spark, sf, sql, key) -> DataFrame:
    return load(spark, sf, sql).select(key, "text")


def spans_sql(source: str, key: str, text: str, pattern: str, tag: str, keep: str = "true") -> str:
    """Matches with offsets. ``pattern`` has one group, the value, at its end; the text is
    padded by one blank so that a left neighbour can be consumed instead of looked at."""
    p = pattern.replace("'", "''")
    at = (
        "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)"
        " + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + length(m[i]) - length(c[i]) - 1"
    )
    return f"""SELECT * FROM (
 SELECT {key}, {tag}, cast({at} AS int) AS start_pos, cast({at} + length(c[i]) AS int) AS end_pos, c[i] AS value
 FROM (SELECT {key}, unnest(range(1, len(m) + 1)) AS i, m, c, g FROM (
   SELECT {key}, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', 1) AS c, string_split_regex(t, '{p}') AS g
   FROM (SELECT {key}, ' ' || {text} AS t FROM ({source}) s0) s1) s2) s3) s4 WHERE {keep}"""


def _spans(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.explode(column).alias("f")).select(
        key, "f.entity_type", F.col("f.start").alias("start_pos"), F.col("f.end").alias("end_pos"), "f.value"
    )


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ── Sources ──────────────────────────────────────────────────────────────


@query("S1_vault_read", f"SELECT entity_type, surrogate, lower(surrogate) AS surrogate_lower, real_value FROM ({inp.VAULT}) v")
def _(spark, sf):
    return v.reverse(load(spark, sf, inp.VAULT)).select("entity_type", "surrogate", "surrogate_lower", "real_value")


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/maskloom-{uuid.uuid4().hex}"


_IN, _OUT = (p.hex() for p in hmac_pads(SEAL_KEY))


def hmac_sql(message: str, inner: str, outer: str) -> str:
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(
    "S2_sealed_vault",
    f"""SELECT entity_type, octet_length(encode(real_value)) + 28 AS sealed_bytes, {hmac_sql('lower(real_value)', _IN, _OUT)} AS real_index,
        real_value, surrogate FROM ({inp.VAULT}) v""",
)
def _(spark, sf):
    store = VaultStore(spark, _scratch(spark), SEAL_KEY)
    store.write(0, load(spark, sf, inp.VAULT))
    stored = seal(load(spark, sf, inp.VAULT), SEAL_KEY)
    sizes = stored.select("entity_type", F.octet_length("real_sealed").alias("sealed_bytes"), "real_index", "seq")
    return sizes.join(store.read().drop("entity_type"), "seq").select(
        "entity_type", "sealed_bytes", "real_index", "real_value", "surrogate"
    )


_RECORD_REPLACE = replacing(
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "SECRET", field_rules=default_policy().field_rules
)


@query(
    "S3_mask_any_shape",
    f"""SELECT c_custkey, '<PERSON>' AS name, '["mail <EMAIL_ADDRESS>","plain"]' AS texts, c_custkey + 1 AS n,
        'tel <PHONE_NUMBER>' AS note, 4 AS masked FROM ({inp.PEOPLE}) p""",
)
def _(spark, sf):
    people = load(spark, sf, inp.PEOPLE).select(
        "c_custkey",
        F.struct(
            F.struct(F.col("full_name").alias("name"), (F.col("c_custkey") + 1).alias("n")).alias("who"),
            F.array(F.concat(F.lit("mail "), "email"), F.lit("plain")).alias("texts"),
            F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("tel "), "phone").alias("text"))).alias("content"),
            F.create_map(F.lit("ssn"), F.col("ssn")).alias("extra"),
        ).alias("rec"),
    )
    done = mask_columns(people, ["c_custkey"], ["rec"], _RECORD_REPLACE, CHECK_KEY).documents
    return done.select(
        "c_custkey",
        F.col("rec.who.name").alias("name"),
        F.to_json("rec.texts").alias("texts"),
        F.col("rec.who.n").alias("n"),
        F.col("rec.content")[0]["text"].alias("note"),
        F.col("masked_count").alias("masked"),
    )


@query(
    "S4_audit_export",
    f"""SELECT ingest_seq, '{{"timestamp":"' || timestamp || '","server":"' || server || '","tool_name":"' || tool_name || '","direction":"' || direction
        || '","entity_types":[' || CASE WHEN types = '' THEN '' ELSE '"' || replace(types, ',', '","') || '"' END || '],"masked_count":'
        || cast(masked_count as string) || ',"demapped_count":' || cast(demapped_count as string) || '}}' AS record FROM ({inp.AUDIT}) a""",
)
def _(spark, sf):
    return audit.to_json(audit_events(spark, sf))


def audit_events(spark, sf) -> DataFrame:
    types = F.filter(F.split("types", ","), lambda t: t != "")
    return load(spark, sf, inp.AUDIT).withColumn("entity_types", types).drop("types")


_BODY = """'{"jsonrpc":"2.0","id":' || cast(c_custkey as string) || ',"result":{"content":[{"type":"text","text":"say \\"hi\\" to ' || %s
 || '"},{"type":"image","text":"' || email || '"}],"email":"' || email || '"}}'"""
_BATCH = """'[{"result":{"content":[{"text":"' || %s || '","type":"text"}]}},{"error":"' || email || '"}]'"""


def _bodies(value: str, engine: str) -> str:
    single = _BODY % value if engine == "duckdb" else (_BODY % value).replace('\\"', '\\\\"')
    return f"CASE c_custkey % 3 WHEN 0 THEN {single} WHEN 1 THEN {_BATCH % value} ELSE 'not json ' || email END"


@query(
    "S5_jsonrpc_envelopes",
    f"""SELECT c_custkey, {_bodies("'<EMAIL_ADDRESS>'", "duckdb")} AS body FROM ({inp.PEOPLE}) p""",
)
def _(spark, sf):
    bodies = load(spark, sf, f"SELECT c_custkey, {_bodies('email', 'spark')} AS body FROM ({inp.PEOPLE}) p")
    return mask_envelopes(bodies, ["c_custkey"], EMAIL_ONLY, CHECK_KEY).documents.select("c_custkey", "body")


# ── Detection ────────────────────────────────────────────────────────────


def _custom_sql() -> str:
    parts = []
    for p in SECRET_PATTERNS:
        body = p[2:-2] if p.endswith(r"\b") else p[2:]
        parts.append(spans_sql(inp.SECRETS, "event_id", "text", rf"\b({body})\b", "'SECRET' AS entity_type"))
    return union_sql(parts)


@query("D1_custom_patterns", _custom_sql())
def _(spark, sf):
    docs = docs_of(spark, sf, inp.SECRETS, "event_id")
    return _spans(docs.select("event_id", rec.custom_findings(F.col("text"), default_policy()).alias("f")), "event_id", "f")


_W = r"\p{L}\p{N}_"
RE2_BUILTIN = {
    "EMAIL_ADDRESS": (rf"({RE2_EMAIL})", "true"),
    "PHONE_NUMBER": (rf"[^{_W}]({rec.PHONE})\b", "true"),
    "US_SSN": (
        rf"\b({rec.SSN})\b",
        "substr(value,1,3) NOT IN ('000','666') AND substr(value,1,3) < '900' AND substr(value,5,2) <> '00' AND substr(value,8,4) <> '0000'",
    ),
    "CREDIT_CARD": (
        rf"\b({rec.CARD})\b",
        """list_sum(list_transform(range(1, length(regexp_replace(value,'[^0-9]','','g')) + 1), lambda k: CASE WHEN k % 2 = 1
           THEN cast(substr(reverse(regexp_replace(value,'[^0-9]','','g')), k, 1) AS int)
           ELSE (cast(substr(reverse(regexp_replace(value,'[^0-9]','','g')), k, 1) AS int) * 2) // 10
              + (cast(substr(reverse(regexp_replace(value,'[^0-9]','','g')), k, 1) AS int) * 2) % 10 END)) % 10 = 0""",
    ),
}
_DOCUMENTS = "SELECT doc_id, text FROM documents"


def _builtin_sql(source=_DOCUMENTS, key="doc_id") -> str:
    return union_sql(
        spans_sql(source, key, "text", p, f"'{e}' AS entity_type", keep) for e, (p, keep) in RE2_BUILTIN.items()
    )


@query("D2_builtin_entities", _builtin_sql())
def _(spark, sf):
    docs = docs_of(spark, sf, _DOCUMENTS, "doc_id")
    return _spans(docs.select("doc_id", rec.builtin_findings(F.col("text")).alias("f")), "doc_id", "f")


_PARTIALS = f"""SELECT c_custkey, 'ends ***-**-' || substr(ssn, 8, 4) || ' or XXX-XX-' || substr(ssn, 8, 4) || ', card XXXX-XXXX-XXXX-'
 || substr(ssn, 8, 4) || ' tel (***) ***-' || substr(phone, 11, 4) AS text FROM ({inp.PEOPLE}) p"""


@query(
    "D3_partial_masks",
    union_sql(
        spans_sql(_PARTIALS, "c_custkey", "text", "(" + p.replace("%s", SPACE) + ")", f"'{e}' AS entity_type")
        for e, p in rec.PARTIAL_PATTERNS
    ),
)
def _(spark, sf):
    docs = docs_of(spark, sf, _PARTIALS, "c_custkey")
    return _spans(docs.select("c_custkey", rec.partial_findings(F.col("text")).alias("f")), "c_custkey", "f")


def _occurrences_sql(texts: str, key: str, patterns: str, column: str, fold: bool, words: bool) -> str:
    """Brute force: every pattern against every text; inputs hold each value once per text."""
    low = (lambda x: f"lower({x})") if fold else (lambda x: x)
    edge = ""
    if words:
        edge = (
            f" AND NOT regexp_matches(substr(t.text, spot - 1, CASE WHEN spot > 1 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}]')"
            f" AND NOT regexp_matches(substr(t.text, spot + length(p.{column}), 1), '[\\p{{L}}\\p{{N}}]')"
        )
    return f"""SELECT t.{key}, p.entity_type, cast(spot - 1 AS int) AS start_pos, cast(spot - 1 + length(p.{column}) AS int) AS end_pos,
  substr(t.text, spot, length(p.{column})) AS value
 FROM ({texts}) t, ({patterns}) p, LATERAL (SELECT strpos({low('t.text')}, {low('p.' + column)}) AS spot) x
 WHERE spot > 0{edge}"""


@query("D4_known_values", _occurrences_sql(inp.NOTES, "o_orderkey", inp.VAULT, "real_value", True, True))
def _(spark, sf):
    docs = docs_of(spark, sf, inp.NOTES, "o_orderkey")
    units = detect.pieces(detect.leaves(docs, ["o_orderkey"]), ["o_orderkey"])
    hits = detect.known(units, ["o_orderkey"], default_policy(), load(spark, sf, inp.VAULT))
    return _placed_columns(hits, "o_orderkey")


def _placed_columns(hits, key):
    return hits.select(
        key, "entity_type", F.col("doc_start").alias("start_pos"), F.col("doc_end").alias("end_pos"), "value"
    )


_PLACE = "'Land' || translate(cast(n_nationkey as string), '0123456789', 'abcdefghij') || ' Bay'"
_GAZETTEER = f"""SELECT {_PLACE} AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'LOCATION' ELSE 'ORGANIZATION' END AS entity_type,
 cast(0.6 + (n_nationkey % 4) * 0.1 AS double) AS score FROM nation"""
_PLACES = f"""SELECT c_custkey, 'From ' || {_PLACE} || ', to ' || lower({_PLACE}) || ' and x' || {_PLACE} || ' via ' || full_name AS text
 FROM ({inp.PEOPLE}) p JOIN nation ON c_nationkey = n_nationkey"""


@query(
    "D5_gazetteer",
    _occurrences_sql(_PLACES, "c_custkey", f"SELECT * FROM ({_GAZETTEER}) g WHERE score >= 0.7", "term", False, True),
)
def _(spark, sf):
    docs = docs_of(spark, sf, _PLACES, "c_custkey")
    units = detect.pieces(detect.leaves(docs, ["c_custkey"]), ["c_custkey"])
    hits = detect.dictionary(units, ["c_custkey"], default_policy(), load(spark, sf, _GAZETTEER))
    return _placed_columns(hits, "c_custkey")


# ── Field rules ──────────────────────────────────────────────────────────

_PATHS = f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'user.email' WHEN 1 THEN 'email' WHEN 2 THEN 'a.b.first_name' WHEN 3 THEN 'x.ssn'
 WHEN 4 THEN 'meta.user.name' WHEN 5 THEN 'acct.api_key' WHEN 6 THEN 'acct.internal.name' ELSE 'acct.Name' END AS path FROM ({inp.PEOPLE}) p"""


@query(
    "F1_field_rule_match",
    f"""SELECT c_custkey, path, CASE WHEN path LIKE '%.first_name' OR path LIKE '%.name' THEN 'PERSON' WHEN path LIKE '%.email' THEN 'EMAIL_ADDRESS'
        WHEN path LIKE '%.ssn' THEN 'US_SSN' WHEN path LIKE '%.api_key' THEN 'SECRET' END AS entity_type FROM ({_PATHS}) p""",
)
def _(spark, sf):
    return load(spark, sf, _PATHS).withColumn("entity_type", detect.field_entity(F.col("path"), default_policy()))


@query(
    "F2_path_exclusion",
    f"SELECT c_custkey, path FROM ({_PATHS}) p WHERE NOT (path LIKE 'meta.%' OR path LIKE '%.internal' OR path LIKE '%.internal.%')",
)
def _(spark, sf):
    policy = default_policy().with_(never_mask_paths=("meta.*", "*.internal"))
    return load(spark, sf, _PATHS).where(~detect.excluded_path(F.col("path"), policy))


@query(
    "F3_field_rule_masking",
    union_sql(
        f"SELECT c_custkey, '{path}' AS path, '{entity}' AS entity_type, {value} AS value FROM ({inp.RECORDS}) r"
        for path, entity, value in (
            ("customer.name", "PERSON", "full_name"),
            ("customer.email", "EMAIL_ADDRESS", "email"),
            ("customer.phone", "PHONE_NUMBER", "phone"),
            ("account.password", "SECRET", "'pw' || ssn"),
            ("account.secret_key", "EMAIL_ADDRESS", "email"),
        )
    ),
)
def _(spark, sf):
    docs = docs_of(spark, sf, inp.RECORDS, "c_custkey")
    rows = fields.field_findings(detect.leaves(docs, ["c_custkey"]), ["c_custkey"], default_policy(), v.empty_vault(spark))
    return rows.select("c_custkey", "path", "entity_type", "value")


_SECRETISH = f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || email || ' ' WHEN 1 THEN 'p@ss.w0rd!' WHEN 2 THEN email || '.c' ELSE 'pw' || ssn END AS value
 FROM ({inp.PEOPLE}) p"""


@query(
    "F4_reclassification",
    f"""SELECT c_custkey, value, CASE WHEN regexp_full_match(trim(value), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,24}}')
        THEN 'EMAIL_ADDRESS' ELSE 'SECRET' END AS entity_type FROM ({_SECRETISH}) s""",
)
def _(spark, sf):
    rows = load(spark, sf, _SECRETISH)
    leaf = rows.withColumns({"path": F.lit("a.password"), "key": F.lit("password"), "text": F.col("value")})
    return fields.with_field_entity(leaf, default_policy()).select("c_custkey", "value", "entity_type")


# Texts that are JSON, look like it, or pass the limits of a parser.
_SHAPES = """
SELECT c_custkey, CASE c_custkey % 12
         WHEN 0 THEN '{"a":"' || c_name || '"}'
         WHEN 1 THEN chr(10) || '[1, "' || c_name || '"] ' || chr(9)
         WHEN 2 THEN '[NaN,-Infinity,' || cast(c_custkey as string) || ']'
         WHEN 3 THEN '{"p":{"password":"' || c_name || '"},"d":' || repeat('[', 1200) || repeat(']', 1200) || '}'
         WHEN 4 THEN '{"a" 1}' || repeat(' ', 1200)
         WHEN 5 THEN '[' || repeat('7', 1500) || ']'
         WHEN 6 THEN '[1 2]' || repeat(' ', 1100)
         WHEN 7 THEN '{"' || repeat('k', CASE WHEN c_custkey % 120 = 7 THEN 60000 ELSE 60 END) || '":"' || c_name || '"}'
         WHEN 8 THEN '"' || c_name || '"'
         WHEN 9 THEN repeat('[', 1300) || repeat(']', 1299)
         WHEN 10 THEN '{"a":[1,{"b":null}],"c":"x"} ' || repeat('{}', c_custkey % 2)
         ELSE '{' || c_name || '}' END AS text
FROM customer"""
_FINITE = "regexp_replace(text, 'NaN|-Infinity', '0', 'g')"


@query("D9_json_texts", f"SELECT c_custkey, json_valid({_FINITE}) AND left(trim(text, chr(32) || chr(9) || chr(10)), 1) IN ('{{', '[') AS json FROM ({_SHAPES}) s")
def _(spark, sf):
    return load(spark, sf, _SHAPES).select("c_custkey", filters.is_json(F.col("text")).alias("json"))


@query("F5_name_combine", f"SELECT c_custkey, full_name AS real_value FROM ({inp.RECORDS}) r")
def _(spark, sf):
    docs = docs_of(spark, sf, inp.RECORDS, "c_custkey")
    return fields.full_names(detect.leaves(docs, ["c_custkey"]), ["c_custkey"], default_policy())


@query(
    "F6_value_tree_mask",
    f"""SELECT c_custkey, replace(replace(replace(replace(text, '"name":"' || full_name || '"', '"name":"<PERSON>"'), email, '<EMAIL_ADDRESS>'), phone, '<PHONE_NUMBER>'),
        'pw' || ssn, '<SECRET>') AS text FROM ({inp.RECORDS}) r""",
)
def _(spark, sf):
    docs = docs_of(spark, sf, inp.RECORDS, "c_custkey")
    return mask(docs, ["c_custkey"], _RECORD_REPLACE, CHECK_KEY).documents.select("c_custkey", "text")


# ── Filters on findings ──────────────────────────────────────────────────

_RE2_URL_BODY = rf"""[^{SPACE}<>"')\]]"""
RE2_PROTECTED = {
    "url": rf"(https?://{_RE2_URL_BODY}+)",
    "domain": rf"[^@{_W}]([{_W}.-]+\.(?:{filters.TLDS})\b(?:/{_RE2_URL_BODY}*)?)",
    "uuid": r"\b([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\b",
    "slack_id": r"\b([CUTWGDE][A-Z0-9]{8,})\b",
    "prefix_id": r"\b([a-z]{2,8}_[A-Za-z0-9]{8,})\b",
}


def _protected_sql() -> str:
    spans = union_sql(
        spans_sql(inp.IDS, "event_id", "text", p, f"'{kind}' AS kind") for kind, p in RE2_PROTECTED.items()
    )
    keys = union_sql(
        [spans_sql(f"SELECT c_custkey AS event_id, text FROM ({inp.RECORDS}) r", "event_id", "text", r'("[^"\\]*(?:\\.[^"\\]*)*")\s*:', "'json_key' AS kind")]
    )
    return f"SELECT event_id, kind, start_pos, end_pos FROM ({spans} UNION ALL {_key_fix(keys)}) x"


def _key_fix(sql: str) -> str:
    # here the group is at the start of the match, not at its end: move it back by the colon
    return f"SELECT event_id, kind, start_pos - 1 AS start_pos, end_pos - 1 AS end_pos, value FROM ({sql}) k"


@query("X1_protected_spans", _protected_sql())
def _(spark, sf):
    ids = docs_of(spark, sf, inp.IDS, "event_id")
    records = docs_of(spark, sf, inp.RECORDS, "c_custkey").withColumnRenamed("c_custkey", "event_id")
    no_keys = tuple(k for k in filters._KINDS if k != "json_key")
    spans = computed(ids, p=filters.protected_spans(F.col("text"), no_keys)).unionByName(
        computed(records, p=filters.protected_spans(F.col("text"), ("json_key",)))
    )
    return spans.select("event_id", F.explode("p").alias("p")).select(
        "event_id", "p.kind", F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos")
    )


_GUARDED = f"""SELECT event_id, 'see https://a.example.com/?m=in' || cast(event_id as string) || '@corp.example.org and out' || cast(event_id as string)
 || '@corp.example.org, tel +1 (' || cast(200 + event_id % 700 as string) || ') 555-0199' AS text FROM events"""


@query(
    "X2_overlap_filter",
    f"""SELECT event_id, 'EMAIL_ADDRESS' AS entity_type, 'out' || cast(event_id as string) || '@corp.example.org' AS value FROM events
        UNION ALL SELECT event_id, 'PHONE_NUMBER', '+1 (' || cast(200 + event_id % 700 as string) || ') 555-0199' FROM events""",
)
def _(spark, sf):
    docs = docs_of(spark, sf, _GUARDED, "event_id")
    units = detect.pieces(detect.leaves(docs, ["event_id"]), ["event_id"])
    return detect.recognized(units, ["event_id"], default_policy()).select("event_id", "entity_type", "value")


_SCORED = f"""SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'ORGANIZATION'
 WHEN 3 THEN 'PHONE_NUMBER' ELSE 'SECRET' END AS entity_type, cast(l_suppkey % 11 as double) / 10 AS score,
 CASE l_suppkey % 9 WHEN 0 THEN 'created_by' WHEN 1 THEN '1,234.5' WHEN 2 THEN 'J.' WHEN 3 THEN 'Ann\nLee' WHEN 4 THEN 'x://y' WHEN 5 THEN 'a@b'
  WHEN 6 THEN 'Unit 7' WHEN 7 THEN 'see assets.x' ELSE 'Maria Lopez' END AS value,
 CASE l_partkey % 4 WHEN 0 THEN cast(1500000000 + l_orderkey * 1000 as string) WHEN 1 THEN cast(1500000000000 + l_orderkey as string)
  WHEN 2 THEN '26' || lpad(cast(l_orderkey as string), 8, '0') ELSE ' ' || cast(2400000000 + l_orderkey as string) || ' ' END AS phone FROM lineitem"""
_SCORED_DUCK = _SCORED.replace("'Ann\nLee'", "'Ann' || chr(10) || 'Lee'")


@query(
    "X3_score_floor",
    f"""SELECT l_orderkey, l_linenumber, entity_type, score FROM ({_SCORED_DUCK}) s
        WHERE score >= CASE entity_type WHEN 'PERSON' THEN 0.85 WHEN 'LOCATION' THEN 0.7 WHEN 'ORGANIZATION' THEN 0.7 ELSE 0.4 END""",
)
def _(spark, sf):
    rows = load(spark, sf, _SCORED)
    return rows.where(filters.above_floor(F.col("entity_type"), F.col("score"))).select("l_orderkey", "l_linenumber", "entity_type", "score")


@query(
    "X4_named_shape",
    f"""SELECT l_orderkey, l_linenumber, entity_type, value FROM ({_SCORED_DUCK}) s WHERE entity_type NOT IN ('PERSON','LOCATION','ORGANIZATION')
        OR NOT (contains(value, '_') OR regexp_full_match(replace(replace(trim(value), '.', ''), ',', ''), '[0-9]+'))""",
)
def _(spark, sf):
    rows = load(spark, sf, _SCORED)
    return rows.where(filters.named_shape_ok(F.col("entity_type"), F.col("value"))).select("l_orderkey", "l_linenumber", "entity_type", "value")


@query(
    "X5_person_filter",
    f"""SELECT l_orderkey, l_linenumber, value FROM ({_SCORED_DUCK}) s WHERE entity_type = 'PERSON' AND length(rtrim(trim(value), '.')) >= 3
        AND NOT contains(value, chr(10)) AND NOT contains(value, '://') AND NOT contains(value, '@') AND NOT contains(value, 'assets.')
        AND NOT regexp_matches(value, '[0-9]')""",
)
def _(spark, sf):
    rows = load(spark, sf, _SCORED).where("entity_type = 'PERSON'")
    fragments = default_policy().host_fragments
    return rows.where(filters.person_ok(F.col("entity_type"), F.col("value"), fragments)).select("l_orderkey", "l_linenumber", "value")


@query(
    "X6_epoch_filter",
    f"""SELECT l_orderkey, l_linenumber, phone FROM ({_SCORED_DUCK}) s WHERE NOT coalesce(
        (length(trim(phone)) = 10 AND cast(trim(phone) as bigint) BETWEEN 1500000000 AND 2500000000)
        OR (length(trim(phone)) = 13 AND cast(trim(phone) as bigint) BETWEEN 1500000000000 AND 2500000000000), false)""",
)
def _(spark, sf):
    rows = load(spark, sf, _SCORED)
    return rows.where(filters.not_timestamp(F.lit("PHONE_NUMBER"), F.col("phone"))).select("l_orderkey", "l_linenumber", "phone")


_ALLOW = ("Boris", "Haas", "ab", "Acme Labs", "example")
_CANDIDATES = f"""SELECT entity_type, real_value AS value FROM ({inp.VAULT}) v UNION ALL SELECT 'PERSON', surrogate FROM ({inp.VAULT}) v
 UNION ALL SELECT 'ORGANIZATION', 'Acme Labs ' || cast(c_custkey as string) FROM customer UNION ALL SELECT 'ORGANIZATION', 'acme labs' FROM customer"""


@query(
    "X7_allow_list_findings",
    f"""SELECT entity_type, value FROM ({_CANDIDATES}) c WHERE value NOT IN ('Boris','boris','Haas','haas','ab','Acme Labs','acme labs','example')
        AND NOT list_has_any(string_split_regex(lower(trim(value)), '\\s+'), ['boris','haas','acme labs','example'])
        AND value NOT IN (SELECT surrogate FROM ({inp.VAULT}) v UNION ALL SELECT lower(surrogate) FROM ({inp.VAULT}) v)""",
)
def _(spark, sf):
    rows = load(spark, sf, _CANDIDATES).where(~filters.allowed_word(F.col("value"), default_policy().with_(allow_list=_ALLOW)))
    return detect.without_known_surrogates(rows, load(spark, sf, inp.VAULT)).select("entity_type", "value")


@query(
    "X8_allow_list_vault",
    f"""SELECT entity_type, real_value FROM ({inp.VAULT}) v WHERE lower(real_value) NOT IN ('boris','haas','ab','acme labs','example')
        AND len(list_filter(string_split_regex(lower(real_value), '[\\s_\\-./@]+'), lambda t: length(t) >= 3 AND t IN ('boris','haas','ab','acme labs','example'))) = 0""",
)
def _(spark, sf):
    policy = default_policy().with_(allow_list=_ALLOW)
    rows = load(spark, sf, inp.VAULT)
    return rows.where(~filters.allowed_vault_value(F.col("real_value"), policy)).select("entity_type", "real_value")


_OVERLAPS = """SELECT l_orderkey, cast(l_partkey % 40 as int) AS s, cast(l_partkey % 40 + 1 + l_suppkey % 9 as int) AS e,
 cast(l_linenumber % 3 as double) / 4 + 0.25 AS score, 'T' || lpad(cast(l_linenumber as string), 3, '0') AS entity_type FROM lineitem"""


@query(
    "X9_conflict_resolution",
    f"""SELECT l_orderkey, r.s AS start_pos, r.e AS end_pos, r.score AS score, r.t AS entity_type FROM (
        SELECT l_orderkey, unnest(list_reduce(a, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x.e AND k.e > x.s)) > 0 THEN acc
           ELSE list_append(acc, x) END, []::STRUCT(s INT, e INT, score DOUBLE, t VARCHAR)[])) AS r
        FROM (SELECT l_orderkey, list({{'s': s, 'e': e, 'score': score, 't': entity_type}} ORDER BY score DESC, e - s DESC, s, e, entity_type) AS a
              FROM ({_OVERLAPS}) o GROUP BY l_orderkey) g) h""",
)
def _(spark, sf):
    rows = load(spark, sf, _OVERLAPS).withColumnsRenamed({"s": "start", "e": "end"})
    return detect.resolve(rows, ["l_orderkey"]).select(
        "l_orderkey", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "score", "entity_type"
    )


# ── Transforms ───────────────────────────────────────────────────────────

_NUMBERS = f"""SELECT 'PHONE_NUMBER' AS entity_type, phone AS real_value FROM ({inp.PEOPLE}) p UNION SELECT 'US_SSN', ssn FROM ({inp.PEOPLE}) p
 UNION SELECT 'CREDIT_CARD', lpad(cast(c_custkey * 7907 as string), 16, '4') FROM customer
 UNION SELECT 'CREDIT_CARD', lpad(cast(c_custkey * 7907 as string), cast(29 + c_custkey % 28 as int), '9314') FROM customer"""


def _keyed(spark, df) -> DataFrame:
    rules = policy_table(spark, default_policy(), CHECK_KEY, ["URL", "OTHER"])
    return df.join(F.broadcast(rules), "entity_type")


@query(
    "T1_format_preserving",
    f"""SELECT entity_type, real_value, regexp_replace(real_value, '[0-9]', '9', 'g') AS shape, true AS changed, true AS reversible FROM ({_NUMBERS}) n""",
)
def _(spark, sf):
    made = materialize(fpe(_keyed(spark, load(spark, sf, _NUMBERS)), "real_value", "made"))
    back = fpe(made, "made", "back", decrypt=True)
    return back.select(
        "entity_type",
        "real_value",
        F.regexp_replace("made", "[0-9]", "9").alias("shape"),
        (F.col("made") != F.col("real_value")).alias("changed"),
        (F.col("back") == F.col("real_value")).alias("reversible"),
    )


@query("T2_fpe_decrypt", f"SELECT entity_type, real_value FROM ({_NUMBERS}) n")
def _(spark, sf):
    made = materialize(fpe(_keyed(spark, load(spark, sf, _NUMBERS)), "real_value", "made").drop("real_value"))
    return fpe(made, "made", "real_value", decrypt=True).select("entity_type", "real_value")


_IPAD, _OPAD = (p.hex() for p in hmac_pads(CHECK_KEY))


def _list_sql(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _pick_sql(words, index: str) -> str:
    return f"({_list_sql(words)})[cast(({index}) % {len(words)} as bigint) + 1]"


def fake_sql(source: str) -> str:
    """The surrogate of ``source(entity_type, real_value)`` at the first attempt."""
    first = (
        _pick_sql(sur.ONSETS, "seed")
        + "||"
        + _pick_sql(sur.NUCLEI, f"seed // {len(sur.ONSETS)}")
        + "||"
        + _pick_sql(sur.ENDINGS, f"seed // {len(sur.ONSETS) * len(sur.NUCLEI)}")
    )
    last = (
        _pick_sql(sur.STEMS, "high")
        + "||"
        + _pick_sql(sur.LINKS, f"high // {len(sur.STEMS)}")
        + "||"
        + _pick_sql(sur.TAILS, f"high // {len(sur.STEMS) * len(sur.LINKS)}")
    )
    mac = hmac_sql("entity_type || ':' || real_value", _IPAD, _OPAD)
    return f"""SELECT entity_type, real_value, CASE entity_type
   WHEN 'EMAIL_ADDRESS' THEN lower(f) || '.' || lower(l) || substr(mac, 9, 4) || '@' || {_pick_sql(sur.DOMAINS, 'high')}
   WHEN 'LOCATION' THEN l WHEN 'ADDRESS' THEN cast(seed % 9000 + 100 as string) || ' ' || l || ' ' || {_pick_sql(sur.STREETS, 'seed')}
   WHEN 'ORGANIZATION' THEN l || ' ' || {_pick_sql(sur.FIRMS, 'seed')}
   WHEN 'URL' THEN 'https://' || lower(l) || substr(mac, 9, 4) || '.example.com/'
   WHEN 'SECRET' THEN 'Zq' || substr(mac, 9, 20) || '#7' ELSE f || ' ' || l END AS surrogate
 FROM (SELECT *, {first} AS f, {last} AS l FROM (
   SELECT *, seed // {sur.FIRSTS} AS high FROM (
     SELECT *, ('0x' || substr(mac, 1, 8))::BIGINT AS seed FROM (SELECT *, {mac} AS mac FROM ({source}) s0) s1) s2) s3) s4"""


_FAKES = f"""SELECT CASE c_custkey % 8 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'EMAIL_ADDRESS' WHEN 2 THEN 'LOCATION' WHEN 3 THEN 'ADDRESS' WHEN 4 THEN 'ORGANIZATION'
 WHEN 5 THEN 'URL' WHEN 6 THEN 'SECRET' ELSE 'OTHER' END AS entity_type, full_name AS real_value FROM ({inp.PEOPLE}) p"""


@query("T3_deterministic_fake", fake_sql(_FAKES))
def _(spark, sf):
    return sur.with_fake(_keyed(spark, load(spark, sf, _FAKES)), "surrogate").select("entity_type", "real_value", "surrogate")


_DISPATCH = Policy(
    entities={
        "PERSON": EntityRule("deterministic_faker"),
        "US_SSN": EntityRule("fpe", tweak="D8E7920AFA330A73"),
        "LOCATION": EntityRule(REPLACE, new_value="<PLACE>"),
        "ORGANIZATION": EntityRule("shuffle"),
        "DEFAULT": EntityRule(REPLACE, new_value="<REDACTED>"),
    }
)


@query(
    "T5_operator_dispatch",
    f"""SELECT l_orderkey, l_linenumber, entity_type, CASE entity_type WHEN 'PERSON' THEN 'deterministic_faker' ELSE 'replace' END AS operator,
        CASE entity_type WHEN 'LOCATION' THEN '<PLACE>' WHEN 'ORGANIZATION' THEN '<ORGANIZATION>' WHEN 'PERSON' THEN '<PERSON>' ELSE '<REDACTED>' END AS replacement
        FROM ({_SCORED_DUCK}) s""",
)
def _(spark, sf):
    rows = load(spark, sf, _SCORED)
    seen = [r[0] for r in rows.select("entity_type").distinct().collect()]
    rules = policy_table(spark, _DISPATCH, CHECK_KEY, seen)
    return rows.join(F.broadcast(rules), "entity_type").select(
        "l_orderkey", "l_linenumber", "entity_type", "operator", F.col("new_value").alias("replacement")
    )


_BLOBS = f"SELECT o_orderkey, text, o_orderkey % 2 = 0 AS blob FROM ({inp.NOTES}) n"


@query(
    "T6_secret_blob",
    f"""SELECT o_orderkey, CASE WHEN blob THEN surrogate ELSE text END AS text FROM ({_BLOBS}) b
        LEFT JOIN ({fake_sql(f"SELECT DISTINCT 'SECRET' AS entity_type, text AS real_value FROM ({_BLOBS}) b WHERE blob")}) f ON text = real_value AND blob""",
)
def _(spark, sf):
    policy = Policy(entities={"SECRET": EntityRule("deterministic_faker")})
    # only what the field itself does: the scan would also mask other rows that hold a blob's text
    return mask(load(spark, sf, _BLOBS), ["o_orderkey"], policy, CHECK_KEY, rescan=False).documents.select("o_orderkey", "text")


_PAGES = "SELECT page_id, html AS text FROM pages"


@query(
    "T7_html_mask",
    f"""SELECT page_id, regexp_replace(html, '{RE2_EMAIL}', '&lt;EMAIL_ADDRESS&gt;', 'g') AS text FROM pages""",
)
def _(spark, sf):
    return mask(load(spark, sf, _PAGES), ["page_id"], EMAIL_ONLY, CHECK_KEY).documents.select("page_id", "text")


@query("T8_span_splice", f"SELECT doc_id, regexp_replace(text, '{RE2_EMAIL}', '<EMAIL_ADDRESS>', 'g') AS text FROM documents")
def _(spark, sf):
    found = rec.builtin_findings(F.col("text"), {"EMAIL_ADDRESS"})
    edits = F.transform(
        found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.lit("<EMAIL_ADDRESS>").alias("replacement"))
    )
    return load(spark, sf, _DOCUMENTS).select("doc_id", splice(F.col("text"), edits).alias("text"))


# ── Vault ────────────────────────────────────────────────────────────────

# Probes: each vault value as written, in capitals, with a wrong type, and unknown.
_PROBES = f"""SELECT seq AS probe, CASE seq % 4 WHEN 3 THEN 'SECRET' ELSE entity_type END AS entity_type,
 CASE seq % 5 WHEN 0 THEN upper(real_value) WHEN 1 THEN real_value || '?' ELSE real_value END AS real_value,
 CASE seq % 5 WHEN 0 THEN upper(surrogate) WHEN 1 THEN surrogate || '?' ELSE surrogate END AS surrogate FROM ({inp.VAULT}) v"""


def _lookup_sql(column: str, value: str, how: str, typed: bool) -> str:
    both = "p.entity_type = v.entity_type AND " if typed else ""
    on = f"lower(p.{column}) = lower(v.{column})" if how == "ci" else f"p.{column} = v.{column}"
    return f"""SELECT p.probe, p.entity_type, p.{column}, v.{value} FROM ({_PROBES}) p LEFT JOIN ({inp.VAULT}) v ON {both}{on}"""


@query("V1_forward_lookup", _lookup_sql("real_value", "surrogate", "ci", True))
def _(spark, sf):
    return v.find_surrogate(load(spark, sf, _PROBES).drop("surrogate"), load(spark, sf, inp.VAULT))


@query("V2_forward_any_type", _lookup_sql("real_value", "surrogate", "ci", False))
def _(spark, sf):
    return v.find_surrogate_anywhere(load(spark, sf, _PROBES).drop("surrogate"), load(spark, sf, inp.VAULT)).drop("found_type")


@query("V3_reverse_typed", _lookup_sql("surrogate", "real_value", "exact", True))
def _(spark, sf):
    return v.find_real(load(spark, sf, _PROBES).drop("real_value"), load(spark, sf, inp.VAULT))


def _sealed_store(spark, sf) -> VaultStore:
    store = VaultStore(spark, _scratch(spark), SEAL_KEY)
    store.write(0, load(spark, sf, inp.VAULT))
    return store


@query("S2_sealed_forward", _lookup_sql("real_value", "surrogate", "ci", True))
def _(spark, sf):
    return _sealed_store(spark, sf).find_surrogate(load(spark, sf, _PROBES).drop("surrogate"))


@query("S2_sealed_reverse", _lookup_sql("surrogate", "real_value", "exact", True))
def _(spark, sf):
    return _sealed_store(spark, sf).find_real(load(spark, sf, _PROBES).drop("real_value"))


@query(
    "V4_reverse_any_type",
    f"""SELECT p.probe, p.entity_type, p.surrogate, coalesce(v.real_value, p.surrogate) AS restored
        FROM ({_PROBES}) p LEFT JOIN ({inp.VAULT}) v ON lower(p.surrogate) = lower(v.surrogate)""",
)
def _(spark, sf):
    return v.restore(load(spark, sf, _PROBES).drop("real_value"), load(spark, sf, inp.VAULT))


# Rewrites of a third of the vault, later in time; some twice.
_UPDATES = f"""SELECT entity_type, real_value, surrogate || '-' || cast(n as string) AS surrogate, seq + 1000000 * n AS seq, false AS derived
 FROM ({inp.VAULT}) v CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) k WHERE seq % 3 = 0 AND (n = 1 OR seq % 2 = 0)"""


@query(
    "V5_upsert",
    f"""SELECT entity_type, real_value, arg_max(surrogate, seq) AS surrogate, max(seq) AS seq
        FROM ({inp.VAULT} UNION ALL {_UPDATES}) u GROUP BY entity_type, real_value""",
)
def _(spark, sf):
    return v.upsert(load(spark, sf, inp.VAULT), load(spark, sf, _UPDATES)).drop("derived")


# Names of few words, so that first names repeat and surrogate words clash.
_PAIRS = f"""SELECT 'PERSON' AS entity_type, first_name || ' ' || last_name AS real_value,
 split_part('Rea,Sol,Tam,Uwe,Vic,Wim,Xia,Yan', ',', cast(c_custkey % 8 + 1 as int)) || ' Z' || substr(last_name, 1, 4) AS surrogate,
 c_custkey AS seq, false AS derived FROM ({inp.PEOPLE}) p"""
_PAIR_WORDS = f"""SELECT split_part(real_value, ' ', n) AS r, split_part(surrogate, ' ', n) AS s, seq * 10 + n AS o
 FROM ({_PAIRS}) p CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) k"""


@query(
    "V6_subtokens",
    f"""SELECT arg_min(r, o) AS real_value, s AS surrogate FROM (
        SELECT r, arg_min(s, o) AS s, min(o) AS o FROM ({_PAIR_WORDS}) w GROUP BY r) x GROUP BY s""",
)
def _(spark, sf):
    return v.subtokens(load(spark, sf, _PAIRS), v.empty_vault(spark)).select("real_value", "surrogate")


_CLAIMS = f"""SELECT entity_type, real_value, CASE c_custkey % 3 WHEN 0 THEN 'Taken ' || cast(c_custkey % 30 as string) WHEN 1 THEN 'Own ' || cast(c_custkey as string)
 ELSE vs END AS candidate FROM (SELECT 'LOCATION' AS entity_type, full_name || '!' AS real_value, c_custkey,
 'q{{}}' || cast(c_custkey as string) AS q, 'Q' || {inp._word('c_custkey')} || ' Z' || {inp._word('c_custkey * 3 + 1')} AS vs FROM ({inp.PEOPLE}) p) x"""


@query(
    "V7_collision_test",
    f"""SELECT entity_type, real_value, candidate, NOT starts_with(candidate, 'Own') AND (starts_with(candidate, 'Q') OR
        count(*) OVER (PARTITION BY lower(candidate)) > 1) AS collides FROM ({_CLAIMS}) c""",
)
def _(spark, sf):
    return v.collisions(load(spark, sf, _CLAIMS), load(spark, sf, inp.VAULT))


@query(
    "V8_unique_assignment",
    f"""SELECT count(*) AS assigned, count(*) AS distinct_surrogates, 0 AS reused_reals FROM (
        SELECT 'PERSON', full_name FROM ({inp.PEOPLE}) p UNION SELECT 'LOCATION', email FROM ({inp.PEOPLE}) p UNION SELECT 'US_SSN', ssn FROM ({inp.PEOPLE}) p) x""",
)
def _(spark, sf):
    values = load(
        spark,
        sf,
        f"""SELECT 'PERSON' AS entity_type, full_name AS real_value, c_custkey AS ord FROM ({inp.PEOPLE}) p
            UNION ALL SELECT 'LOCATION', email, c_custkey FROM ({inp.PEOPLE}) p UNION ALL SELECT 'US_SSN', ssn, c_custkey FROM ({inp.PEOPLE}) p""",
    )
    rules = policy_table(spark, default_policy(), CHECK_KEY)
    made = asg.assign(values, v.empty_vault(spark), rules).where("not derived")
    reals = values.select(F.lower("real_value").alias("k")).distinct()
    used = made.select(F.lower("surrogate").alias("k")).join(reals, "k", "left_semi").agg(F.count(F.lit(1)).alias("reused_reals"))
    counts = made.agg(F.count(F.lit(1)).alias("assigned"), F.count_distinct(F.lower("surrogate")).alias("distinct_surrogates"))
    return counts.withColumn("one", F.lit(1)).join(used.withColumn("one", F.lit(1)), "one").drop("one")


_DENSE = "SELECT 'PHONE_NUMBER' AS entity_type, lpad(cast(o_orderkey as string), 6, '0') AS real_value, o_orderkey AS ord FROM orders"


@query(
    "V8_dense_numbers",
    f"SELECT entity_type, real_value, length(real_value) AS digits, 1 AS holders, false AS reused_real FROM ({_DENSE}) n",
)
def _(spark, sf):
    values = load(spark, sf, _DENSE)
    made = materialize(asg.assign(values, v.empty_vault(spark), policy_table(spark, default_policy(), CHECK_KEY)))
    holders = made.groupBy("surrogate").agg(F.count(F.lit(1)).cast("int").alias("holders"))
    reals = values.select(F.col("real_value").alias("surrogate"), F.lit(True).alias("reused")).distinct()
    out = made.join(holders, "surrogate").join(reals, "surrogate", "left")
    digits = F.when(F.col("surrogate").rlike("^[0-9]+$"), F.length("surrogate").cast("long"))
    return out.select("entity_type", "real_value", digits.alias("digits"), "holders", F.coalesce("reused", F.lit(False)).alias("reused_real"))


_PARTIAL_SSN = f"SELECT DISTINCT 'US_SSN' AS entity_type, '***-**-' || substr(ssn, 8, 4) AS partial FROM ({inp.PEOPLE}) p UNION SELECT 'US_SSN', 'XXX-' || substr(ssn, 5, 7) FROM ({inp.PEOPLE}) p"
_VAULT_SSN = f"SELECT * FROM ({inp.VAULT}) v WHERE entity_type = 'US_SSN'"


@query(
    "V9_partial_reconciliation",
    f"""SELECT 'US_SSN' AS entity_type, partial, max(surrogate) AS surrogate FROM (
        SELECT '***-**-' || right(real_value, 4) AS partial, surrogate FROM ({_VAULT_SSN}) a
        UNION ALL SELECT 'XXX-' || right(real_value, 7), surrogate FROM ({_VAULT_SSN}) b) x GROUP BY partial HAVING count(*) = 1""",
)
def _(spark, sf):
    return v.reconcile(load(spark, sf, _PARTIAL_SSN), load(spark, sf, inp.VAULT))


@query(
    "V11_vault_summary",
    f"SELECT entity_type, count(*) AS entries FROM ({inp.VAULT}) v GROUP BY entity_type UNION ALL SELECT NULL, count(*) FROM ({inp.VAULT}) v",
)
def _(spark, sf):
    return v.summary(load(spark, sf, inp.VAULT))


@query(
    "V12_vault_listing",
    f"""SELECT entity_type, CASE WHEN length(real_value) > 4 THEN left(real_value, 2) || repeat('*', length(real_value) - 4) || right(real_value, 2) ELSE '****' END AS real_shown,
        surrogate FROM ({inp.VAULT}) v""",
)
def _(spark, sf):
    return v.listing(load(spark, sf, inp.VAULT))


# ── Reversal ─────────────────────────────────────────────────────────────

_MENTIONS = f"""SELECT o_orderkey, s_name, s_mail, full_name, email, o_orderkey % 4 AS form, CASE o_orderkey % 4
   WHEN 0 THEN 'To ' || s_name || ' <' || s_mail || '>' WHEN 1 THEN 'x' || s_name || 'y, ' || upper(s_name)
   WHEN 2 THEN lower(s_name) || '; ' || s_mail || 'z' ELSE 'nobody' END AS text
 FROM (SELECT o_orderkey, full_name, email, 'Q' || {inp._word('c_custkey')} || ' Z' || {inp._word('c_custkey * 3 + 1')} AS s_name,
         'u' || substr(md5(email), 1, 10) || '@example.net' AS s_mail FROM orders JOIN ({inp.PEOPLE}) p ON o_custkey = c_custkey) m"""
@query(
    "M1_demask_text",
    f"""SELECT o_orderkey, CASE form WHEN 0 THEN 'To ' || full_name || ' <' || email || '>' WHEN 1 THEN 'x' || full_name || 'y, ' || upper(s_name)
          WHEN 2 THEN lower(s_name) || '; ' || email || 'z' ELSE 'nobody' END AS demasked,
        CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS replaced FROM ({_MENTIONS}) m""",
)
def _(spark, sf):
    done = demask.demask(docs_of(spark, sf, _MENTIONS, "o_orderkey"), ["o_orderkey"], load(spark, sf, inp.VAULT))
    return done.select("o_orderkey", "demasked", F.size("replacements").alias("replaced"))


@query(
    "M3_demap_string",
    f"""SELECT o_orderkey, CASE form WHEN 0 THEN 'To ' || full_name || ' <' || email || '>' WHEN 1 THEN 'x' || s_name || 'y, ' || full_name
          WHEN 2 THEN full_name || '; ' || s_mail || 'z' ELSE 'nobody' END AS text FROM ({_MENTIONS}) m""",
)
def _(spark, sf):
    docs = docs_of(spark, sf, _MENTIONS, "o_orderkey")
    return demask.demap(docs, ["o_orderkey"], default_policy(), load(spark, sf, inp.VAULT), kind="value").select("o_orderkey", "text")


_ARGS = """'{"q":"find ' || lower(%s) || '","items":["x ' || %s || '",3,{"n":"' || upper(%s) || '","z":"' || %s || 'z"}],"skip":{"n":"' || %s || '"},"form":' || cast(form as string) || '}'"""


def _args(*values) -> str:
    return f"SELECT o_orderkey, form, {_ARGS % values} AS text FROM ({_MENTIONS}) m"


_ARGS_IN = _args("s_name", "s_mail", "s_name", "s_name", "s_name")
_ARGS_OUT = (
    f"""SELECT o_orderkey, form, '{{"q":"find ' || full_name || '","items":["x ' || email || '",3,{{"n":"' || full_name || '","z":"' || s_name
    || 'z"}}],"skip":{{"n":"' || s_name || '"}},"form":' || cast(form as string) || '}}' AS text FROM ({_MENTIONS}) m"""
)
_SKIP = default_policy().with_(never_mask_paths=("skip",))


@query("M4_demap_arguments", f"SELECT o_orderkey, text FROM ({_ARGS_OUT}) a")
def _(spark, sf):
    docs = docs_of(spark, sf, _ARGS_IN, "o_orderkey")
    return demask.demap(docs, ["o_orderkey"], _SKIP, load(spark, sf, inp.VAULT)).select("o_orderkey", "text")


@query("M5_demap_change_count", f"SELECT o_orderkey, 3 AS changed FROM ({_ARGS_OUT}) a")
def _(spark, sf):
    return demask.count_changes(docs_of(spark, sf, _ARGS_IN, "o_orderkey"), docs_of(spark, sf, _ARGS_OUT, "o_orderkey"), ["o_orderkey"])


@query(
    "M6_surrogate_lookup",
    f"""SELECT p.surrogate, v.entity_type, v.real_value, v.real_value IS NOT NULL AS found
        FROM ({_PROBES}) p LEFT JOIN ({inp.VAULT}) v ON lower(p.surrogate) = lower(v.surrogate)""",
)
def _(spark, sf):
    return demask.lookup(load(spark, sf, _PROBES).select("surrogate"), load(spark, sf, inp.VAULT))


# ── Routing and whole plans ──────────────────────────────────────────────


@query("G1_sensitive_arguments", f"SELECT o_orderkey, form = 1 OR form = 2 AS sensitive FROM ({_ARGS_IN}) a")
def _(spark, sf):
    docs = load(spark, sf, f"SELECT o_orderkey, replace(replace(text, 'find ', 'vault/' || cast(form as string) || '/'), 'x u', 'k' || cast(form as string) || ':u') AS text FROM ({_ARGS_IN}) a")
    policy = default_policy().with_(sensitive_args=("vault/1/*", "k[!013]:*.net"))
    return docs.select("o_orderkey", sensitive(F.col("text"), policy).alias("sensitive"))


_FORMS = """CASE form WHEN 0 THEN 'Order for ' || s_name || ' shipped, write to ' || s_mail || '.'
  WHEN 1 THEN 'NOTE: ' || s_name || substr(text, length('NOTE: ' || full_name) + 1)
  WHEN 2 THEN text WHEN 3 THEN replace(text, email, s_mail) ELSE s_ssn || ' is the number of ' || s_name END"""
_NOTE_ROWS = f"""SELECT n.*, 'u' || substr(md5(email), 1, 10) || '@example.net' AS s_mail,
  'Q' || w || ' Z' || w3 AS s_name, substr(ssn, 9, 3) || '-' || substr(ssn, 5, 2) || '-' || substr(ssn, 1, 3) || cast(c_custkey % 10 as string) AS s_ssn
 FROM (SELECT n.*, o_custkey AS c_custkey, {inp._word('o_custkey')} AS w, {inp._word('o_custkey * 3 + 1')} AS w3
       FROM ({inp.NOTES}) n JOIN (SELECT o_orderkey, o_custkey FROM orders) o USING (o_orderkey)) n"""


_PAGE_JSON = f"""SELECT c_custkey, text, CASE WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'text' END AS kind FROM (
 SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN text ELSE 'plain ' || email || ' and pw' || ssn END AS text FROM ({inp.RECORDS}) r) x"""


@query(
    "P1_mask_text",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(replace(replace(replace(text, '"name":"' || full_name || '"', '"name":"<PERSON>"'),
          email, '<EMAIL_ADDRESS>'), phone, '<PHONE_NUMBER>'), 'pw' || ssn, '<SECRET>') ELSE 'plain <EMAIL_ADDRESS> and pw' || ssn END AS text,
        CASE WHEN c_custkey % 2 = 0 THEN 'PERSON,EMAIL_ADDRESS,PHONE_NUMBER,SECRET' ELSE 'EMAIL_ADDRESS' END AS types,
        CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 1 END AS masked FROM ({inp.RECORDS}) r""",
)
def _(spark, sf):
    done = mask(load(spark, sf, _PAGE_JSON).drop("kind"), ["c_custkey"], _RECORD_REPLACE, CHECK_KEY).documents
    return done.select("c_custkey", "text", F.array_join("entity_types", ",").alias("types"), F.col("masked_count").alias("masked"))


@query("P2_mask_plain_text", f"SELECT o_orderkey, {_FORMS} AS text FROM ({_NOTE_ROWS}) n")
def _(spark, sf):
    docs = docs_of(spark, sf, inp.NOTES, "o_orderkey")
    return mask(docs, ["o_orderkey"], default_policy(), CHECK_KEY, load(spark, sf, inp.VAULT)).documents.select("o_orderkey", "text")


@query(
    "P3_call_round_trip",
    f"""SELECT o_orderkey, '{{"who":"' || full_name || '","n":' || cast(form as string) || '}}' AS args, {_FORMS} AS answer,
        CASE WHEN form = 2 THEN 1 ELSE 2 END AS items, CASE form WHEN 0 THEN 2 WHEN 2 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS masked, 1 AS demapped,
        CASE WHEN form = 2 THEN 1 ELSE 2 END AS events FROM ({_NOTE_ROWS}) n""",
)
def _(spark, sf):
    calls = load(
        spark,
        sf,
        f"""SELECT o_orderkey, 's1' AS server, 'notes' AS tool_name, '{{"who":"' || lower(s_name) || '","n":' || cast(form as string) || '}}' AS args,
            array(named_struct('type', 'text', 'text', text)) AS content FROM ({_NOTE_ROWS}) n""",
    )
    done, events = mask_calls(calls, ["o_orderkey"], default_policy(), CHECK_KEY, load(spark, sf, inp.VAULT))
    per_call = events.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("events"))
    return done.documents.join(per_call, "o_orderkey", "left").select(
        "o_orderkey",
        "args",
        F.col("content")[0]["text"].alias("answer"),
        F.size("content").alias("items"),
        F.col("masked_count").alias("masked"),
        F.col("demapped_count").alias("demapped"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def _shaped(spark, sf, shape: str) -> DataFrame:
    """The calls of P3 with another shape of result."""
    return load(
        spark,
        sf,
        f"""SELECT o_orderkey, 's1' AS server, 'notes' AS tool_name, '{{"n":' || cast(form as string) || '}}' AS args, {shape} AS content FROM ({_NOTE_ROWS}) n""",
    )


_MASKED = "form <> 2"
_NOTICE_SQL = "'[PII surrogated — pass back verbatim]'"


@query(
    "P3_string_results",
    f"SELECT o_orderkey, {_FORMS} || CASE WHEN {_MASKED} THEN chr(10) || chr(10) || {_NOTICE_SQL} ELSE '' END AS content FROM ({_NOTE_ROWS}) n",
)
def _(spark, sf):
    done, _ = mask_calls(_shaped(spark, sf, "text"), ["o_orderkey"], default_policy(), CHECK_KEY, load(spark, sf, inp.VAULT))
    return done.documents.select("o_orderkey", "content")


@query(
    "P3_list_results",
    f"SELECT o_orderkey, 'plain|' || {_FORMS} || '|' || CASE WHEN {_MASKED} THEN {_NOTICE_SQL} ELSE '' END AS content FROM ({_NOTE_ROWS}) n",
)
def _(spark, sf):
    done, _ = mask_calls(_shaped(spark, sf, "array('plain', text)"), ["o_orderkey"], default_policy(), CHECK_KEY, load(spark, sf, inp.VAULT))
    third = F.coalesce(F.get("content", F.lit(2)), F.lit(""))
    return done.documents.select("o_orderkey", F.concat_ws("|", F.col("content")[0], F.col("content")[1], third).alias("content"))


@query(
    "P3_mixed_items",
    f"""SELECT o_orderkey, cast(o_orderkey % 7 as bigint) AS width, md5(cast(o_orderkey as string)) AS data, email AS caption, {_FORMS} AS answer,
        CASE WHEN {_MASKED} THEN 4 ELSE 3 END AS items FROM ({_NOTE_ROWS}) n""",
)
def _(spark, sf):
    item = "named_struct('type', %s, 'text', %s, 'data', %s, 'size', %s)"
    image = item % ("'image'", "email", "md5(cast(o_orderkey as string))", "named_struct('width', o_orderkey % 7, 'height', 1)")
    none = "cast(null as struct<width:bigint,height:int>)"
    shape = f"array({image}, {item % (repr('text'), 'text', 'cast(null as string)', none)}, {item % (repr('text'), 'cast(null as string)', 'cast(null as string)', none)})"
    done, _ = mask_calls(_shaped(spark, sf, shape), ["o_orderkey"], default_policy(), CHECK_KEY, load(spark, sf, inp.VAULT))
    c = F.col("content")
    return done.documents.select("o_orderkey", c[0]["size"]["width"].alias("width"), c[0]["data"].alias("data"), c[0]["text"].alias("caption"), c[1]["text"].alias("answer"), F.size(c).alias("items"))


@query(
    "P4_resource_masking",
    f"SELECT page_id, regexp_replace(html, '{RE2_EMAIL}', '&lt;EMAIL_ADDRESS&gt;', 'g') AS text, cast(len(regexp_extract_all(html, '{RE2_EMAIL}')) as int) AS masked FROM pages",
)
def _(spark, sf):
    done = mask(load(spark, sf, _PAGES), ["page_id"], EMAIL_ONLY, CHECK_KEY).documents
    return done.select("page_id", "text", F.col("masked_count").alias("masked"))


@query(
    "P5_masking_summary",
    f"""SELECT doc_id, string_agg(entity_type, ',' ORDER BY first, entity_type) AS types, cast(sum(n) as int) AS masked FROM (
        SELECT doc_id, entity_type, min(start_pos) AS first, count(*) AS n FROM ({_builtin_sql()}) f GROUP BY doc_id, entity_type) g GROUP BY doc_id""",
)
def _(spark, sf):
    policy = replacing("EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD")
    found = discover(load(spark, sf, _DOCUMENTS), ["doc_id"], policy)
    kept = detect.resolve(found, ["doc_id"], prefer="length")
    rows = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("doc_start", "entity_type"))).alias("f"))
    return rows.select(
        "doc_id",
        F.array_join(F.array_distinct(F.transform("f", lambda x: x["entity_type"])), ",").alias("types"),
        F.size("f").alias("masked"),
    )


# ── Audit ────────────────────────────────────────────────────────────────


@query(
    "A1_record_events",
    f"""SELECT ingest_seq, server, tool_name, 'demap' AS direction, 0 AS masked_count, demapped_count FROM ({inp.AUDIT}) a WHERE demapped_count > 0
        UNION ALL SELECT ingest_seq, server, tool_name, 'mask', masked_count, 0 FROM ({inp.AUDIT}) a WHERE masked_count > 0""",
)
def _(spark, sf):
    return audit.events_of(audit_events(spark, sf), ["ingest_seq"]).drop("entity_types")


@query(
    "A2_totals",
    f"SELECT count(*) AS total_events, cast(sum(masked_count) as bigint) AS total_masked, cast(sum(demapped_count) as bigint) AS total_demapped FROM ({inp.AUDIT}) a",
)
def _(spark, sf):
    return audit.totals(audit_events(spark, sf))


@query("A3_entity_counts", f"SELECT entity_type, count(*) AS n FROM (SELECT unnest(string_split(types, ',')) AS entity_type FROM ({inp.AUDIT}) a) x WHERE entity_type <> '' GROUP BY entity_type")
def _(spark, sf):
    return audit.entity_counts(audit_events(spark, sf))


@query(
    "A4_tool_and_server_counts",
    f"""SELECT 'tool' AS kind, tool_name AS name, count(*) AS n FROM ({inp.AUDIT}) a WHERE tool_name <> '' GROUP BY tool_name
        UNION ALL SELECT 'server', server, count(*) FROM ({inp.AUDIT}) a WHERE server <> '' GROUP BY server""",
)
def _(spark, sf):
    events = audit_events(spark, sf)
    parts = [
        audit.column_counts(events, c).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
        for kind, c in (("tool", "tool_name"), ("server", "server"))
    ]
    return parts[0].unionByName(parts[1])


@query("A5_recent_events", f"SELECT ingest_seq, tool_name, direction FROM ({inp.AUDIT}) a ORDER BY ingest_seq DESC LIMIT 50")
def _(spark, sf):
    return audit.recent(audit_events(spark, sf)).select("ingest_seq", "tool_name", "direction")


@query(
    "A6_retention",
    f"""SELECT count(*) AS total_events, cast(sum(masked_count) as bigint) AS total_masked, cast(sum(demapped_count) as bigint) AS total_demapped
        FROM (SELECT * FROM ({inp.AUDIT}) a ORDER BY ingest_seq DESC LIMIT 1000) b""",
)
def _(spark, sf):
    return audit.totals(audit.retained(audit_events(spark, sf)))


_BODIES_OF_EVENTS = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"server":"s1","tool_name":"' || event_type || '","masked_count":' || cast(user_id as string) || ',"entity_types":["PERSON"]}'
 WHEN 1 THEN '{"timestamp":"t","direction":"demap","demapped_count":2}' ELSE '{}' END AS body FROM events"""


@query(
    "A7_ingest_defaults",
    """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 't' ELSE '' END AS timestamp, CASE WHEN event_id % 3 = 0 THEN 's1' ELSE '' END AS server,
       CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS tool_name, CASE WHEN event_id % 3 = 1 THEN 'demap' ELSE '' END AS direction,
       CASE WHEN event_id % 3 = 0 THEN 'PERSON' ELSE '' END AS types, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 0 END AS masked_count,
       CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS demapped_count FROM events""",
)
def _(spark, sf):
    rows = audit.ingest(load(spark, sf, _BODIES_OF_EVENTS))
    return rows.withColumn("types", F.array_join("entity_types", ",")).drop("entity_types")


# ── Streams ──────────────────────────────────────────────────────────────


def _stream_of(spark, df: DataFrame) -> DataFrame:
    """The table as a stream of files, a few per micro-batch."""
    path = _scratch(spark)
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("R1_stream_mask", f"SELECT doc_id, regexp_replace(text, '{RE2_EMAIL}', '<EMAIL_ADDRESS>', 'g') AS text FROM documents")
def _(spark, sf):
    base = _scratch(spark)
    store = VaultStore(spark, f"{base}/vault")
    stream = _stream_of(spark, load(spark, sf, _DOCUMENTS))
    _finish(streams.mask_stream(stream, store, lambda: EMAIL_ONLY, CHECK_KEY, ["doc_id"], f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out").select("doc_id", "text")


@query("R2_stream_demask", f"SELECT o_orderkey, text FROM ({_ARGS_OUT}) a")
def _(spark, sf):
    base = _scratch(spark)
    store = VaultStore(spark, f"{base}/vault")
    store.write(0, load(spark, sf, inp.VAULT))
    stream = _stream_of(spark, docs_of(spark, sf, _ARGS_IN, "o_orderkey"))
    _finish(streams.demask_stream(stream, store, lambda: _SKIP, ["o_orderkey"], f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out").select("o_orderkey", "text")


@query(
    "R3_stream_audit",
    """SELECT kind, name, count(*) AS n FROM (SELECT 'server' AS kind, 's1' AS name FROM events WHERE event_id % 3 = 0
       UNION ALL SELECT 'tool_name', event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'entity_type', 'PERSON' FROM events WHERE event_id % 3 = 0) x GROUP BY kind, name""",
)
def _(spark, sf):
    base = _scratch(spark)
    counts = streams.running_counts(streams.audit_events(_stream_of(spark, load(spark, sf, _BODIES_OF_EVENTS))))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    _finish(counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out")


def _halves(spark, base: str, rows: DataFrame, start, between) -> None:
    """Even rows as the first micro-batch of a stream, ``between``, then odd rows as the second."""
    for half in (0, 1):
        rows.where(F.col(rows.columns[0]) % 2 == half).write.mode("append").parquet(f"{base}/in")
        _finish(start(spark.readStream.schema(rows.schema).parquet(f"{base}/in")))
        if half == 0:
            between()


@query(
    "R4_policy_reload",
    f"SELECT doc_id, regexp_replace(text, '{RE2_EMAIL}', CASE WHEN doc_id % 2 = 0 THEN '<EMAIL_ADDRESS>' ELSE '[mail]' END, 'g') AS text FROM documents",
)
def _(spark, sf):
    base = _scratch(spark)
    store, policies = VaultStore(spark, f"{base}/vault"), PolicyStore(spark, f"{base}/policy")
    policies.publish(EMAIL_ONLY)
    changed = Policy(entities={"EMAIL_ADDRESS": EntityRule(REPLACE, new_value="[mail]")})
    _halves(
        spark, base, load(spark, sf, _DOCUMENTS),
        lambda stream: streams.mask_stream(stream, store, policies, CHECK_KEY, ["doc_id"], f"{base}/out", f"{base}/ckpt"),
        lambda: policies.publish(changed, from_batch=1),
    )
    return spark.read.parquet(f"{base}/out").select("doc_id", "text")


_SHIPPED = "SELECT o_orderkey, 'Order for ' || %s || ' shipped' AS text FROM (%s) n"


@query("R5_vault_refresh", _SHIPPED % ("CASE WHEN o_orderkey % 2 = 0 THEN full_name ELSE s_name END", _NOTE_ROWS))
def _(spark, sf):
    base = _scratch(spark)
    store, other = VaultStore(spark, f"{base}/vault"), VaultStore(spark, f"{base}/vault", writer="other")
    _halves(
        spark, base, load(spark, sf, _SHIPPED % ("full_name", _NOTE_ROWS)),
        lambda stream: streams.mask_stream(stream, store, default_policy, CHECK_KEY, ["o_orderkey"], f"{base}/out", f"{base}/ckpt"),
        lambda: other.write(0, load(spark, sf, inp.VAULT)),
    )
    return spark.read.parquet(f"{base}/out").select("o_orderkey", "text")


# ── User hook ────────────────────────────────────────────────────────────

_BADGES = "SELECT l_orderkey * 10 + l_linenumber AS line, 'badge EMP-' || lpad(cast(l_partkey as string), 6, '0') || ' seen, org_' || 'EMP00000' || cast(l_linenumber as string) AS text FROM lineitem"


@query(
    "U1_user_recognizer",
    "SELECT l_orderkey * 10 + l_linenumber AS line, 'badge <EMPLOYEE_ID> seen, org_' || 'EMP00000' || cast(l_linenumber as string) AS text FROM lineitem",
)
def _(spark, sf):
    def badges(units):
        hits = units.withColumn("at", F.locate("EMP-", F.col("text")) - 1).where("at >= 0")
        return hits.withColumns(
            {"start": F.col("at"), "end": F.col("at") + 10, "entity_type": F.lit("EMPLOYEE_ID"), "score": F.lit(0.9)}
        )

    policy = Policy(entities={"EMPLOYEE_ID": EntityRule(REPLACE)})
    done = mask(load(spark, sf, _BADGES), ["line"], policy, CHECK_KEY, hooks=[badges])
    return done.documents.select("line", "text")
