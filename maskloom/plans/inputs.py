"""Inputs the checks derive from the given tables: SQL both engines read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskloom.runtime import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_FIRST = "Anna,Boris,Clara,Dmitri,Elena,Farid,Greta,Hugo,Ines,Jonas,Katya,Liam"
_LAST = "Abel,Brandt,Castro,Dietrich,Eklund,Ferrari,Garcia,Haas,Ivanov,Jensen,Keller,Lopez,Moreau,Novak,Ortega"


def _word(number: str) -> str:
    return f"translate(cast({number} as string), '0123456789', 'abcdefghij')"


# One invented person per customer; the family name is unique.
PEOPLE = f"""
SELECT c_custkey, c_nationkey, first_name, last_name, first_name || ' ' || last_name AS full_name,
       lower(first_name) || '.' || lower(last_name) || '@example.com' AS email,
       '(' || cast(200 + c_custkey % 700 as string) || ') 555-' || lpad(cast(c_custkey % 10000 as string), 4, '0') AS phone,
       substr(n9, 1, 3) || '-' || substr(n9, 4, 2) || '-' || substr(n9, 6, 4) AS ssn
FROM (SELECT c_custkey, c_nationkey,
             split_part('{_FIRST}', ',', cast(c_custkey % 12 + 1 as int)) AS first_name,
             split_part('{_LAST}', ',', cast(floor(c_custkey / 12) % 15 + 1 as int)) || {_word('c_custkey')} AS last_name,
             lpad(cast((c_custkey * 7919 + 100000001) % 1000000000 as string), 9, '0') AS n9
      FROM customer) k"""

# A vault: each person's name, email and SSN with invented surrogates.
VAULT = f"""
SELECT 'PERSON' AS entity_type, full_name AS real_value,
       'Q' || {_word('c_custkey')} || ' Z' || {_word('c_custkey * 3 + 1')} AS surrogate, c_custkey * 3 AS seq, false AS derived
FROM ({PEOPLE}) p
UNION ALL
SELECT 'EMAIL_ADDRESS', email, 'u' || substr(md5(email), 1, 10) || '@example.net', c_custkey * 3 + 1, false FROM ({PEOPLE}) p
UNION ALL
SELECT 'US_SSN', ssn, substr(ssn, 9, 3) || '-' || substr(ssn, 5, 2) || '-' || substr(ssn, 1, 3) || cast(c_custkey % 10 as string),
       c_custkey * 3 + 2, false FROM ({PEOPLE}) p"""

# Order notes that mention the customer: as written, in capitals, glued to a word, inside
# a URL, inside a longer word.
NOTES = f"""
SELECT o_orderkey, CASE o_orderkey % 5
         WHEN 0 THEN 'Order for ' || full_name || ' shipped, write to ' || email || '.'
         WHEN 1 THEN 'NOTE: ' || upper(first_name) || ' ' || lower(last_name) || ' (' || o_orderpriority || ')'
         WHEN 2 THEN 'pre' || full_name || 'post and ' || ssn || '9 stay'
         WHEN 3 THEN 'https://shop.example.org/u/' || lower(last_name) || '?m=' || email || ' é' || full_name
         ELSE ssn || ' is the number of ' || lower(full_name) END AS text,
       full_name, email, ssn, o_orderkey % 5 AS form
FROM orders JOIN ({PEOPLE}) p ON o_custkey = c_custkey"""

_HEX72 = "md5(cast(event_id as string)) || md5(cast(event_id + 7 as string)) || md5(event_type)"
# Secrets of each kind, one per event.
SECRETS = f"""
SELECT event_id, 'run ' || CASE event_id % 6
         WHEN 0 THEN 'eyJ' || substr(h, 1, 20) || '.' || substr(h, 21, 30) || '.' || substr(h, 51, 20)
         WHEN 1 THEN 'ghp_' || substr(h, 1, 36)
         WHEN 2 THEN 'AKIA' || upper(substr(h, 1, 16))
         WHEN 3 THEN 'sk_live_' || substr(h, 1, 30)
         WHEN 4 THEN 'xoxb-' || substr(h, 1, 12) || '-' || substr(h, 13, 12)
         ELSE 'sk-ant-' || substr(h, 1, 40) END || ' and ghp_' || substr(h, 1, 20) || ' é.' AS text
FROM (SELECT event_id, {_HEX72} AS h FROM events) e"""

# Texts full of identifiers that must stay as they are.
IDS = f"""
SELECT event_id, 'id ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
       || ' in C0' || upper(substr(h, 1, 9)) || ', org_' || substr(h, 3, 12) || ' see https://a' || substr(h, 1, 3) || '.example.com/p?q=' || substr(h, 1, 5)
       || ' or files.' || event_type || '.io/x, mail u' || substr(h, 1, 4) || '@corp.example.org' AS text
FROM (SELECT event_id, event_type, md5(cast(event_id as string)) AS h FROM events) e"""

# JSON records of the customers.
RECORDS = f"""
SELECT c_custkey, '{{"customer":{{"name":"' || full_name || '","email":"' || email || '","phone":"' || phone || '","tags":["vip","' || email
       || '"]}},"first_name":"' || first_name || '","last_name":"' || last_name || '","account":{{"password":"pw' || ssn || '","secret_key":"' || email
       || '"}},"note":"call ' || email || ' soon","id":' || cast(c_custkey as string) || ',"ok":true,"none":null}}' AS text,
       full_name, first_name, last_name, email, phone, ssn
FROM ({PEOPLE}) p"""

# Audit events stand-in.
AUDIT = """
SELECT event_id AS ingest_seq, cast(event_id as string) AS timestamp, CASE WHEN user_id % 4 = 3 THEN '' ELSE 's' || cast(user_id % 4 as string) END AS server,
       event_type AS tool_name, CASE WHEN event_id % 2 = 0 THEN 'mask' ELSE 'demap' END AS direction,
       CASE WHEN event_id % 2 = 0 THEN cast(user_id % 9 as bigint) ELSE cast(0 as bigint) END AS masked_count,
       CASE WHEN event_id % 2 = 1 THEN cast(user_id % 5 as bigint) ELSE cast(0 as bigint) END AS demapped_count,
       CASE WHEN event_id % 3 = 0 THEN 'PERSON,US_SSN' WHEN event_id % 3 = 1 THEN 'EMAIL_ADDRESS' ELSE '' END AS types
FROM events"""


#: Tables of narrow rows, from which much longer texts are derived: a few megabytes would be one task's work.
NARROW = ("customer", "orders", "lineitem", "events")


def tables(spark: SparkSession, sf_dir: str) -> SparkSession:
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (spread(rows) if name in NARROW else rows).createOrReplaceTempView(name)
    return spark


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return tables(spark, sf_dir).sql(sql)
