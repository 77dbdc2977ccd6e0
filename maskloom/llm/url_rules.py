"""URL filter: range-partitioned sort-merge sweep of URLs and host rules.

A host read from its last label to its first (``com.example.www``) turns "this host and its
subdomains" into one interval of keys. URLs and rules are range partitioned by that key; each
rule goes to every range its interval meets. A sorted sweep of a range keeps a stack of the
rules whose intervals are open; intervals of hosts either nest or are disjoint, so closing is
popping. A URL takes the longest rule on the stack whose path begins its own path.

Hot hosts: the ranges are cut on (key, path, row hash), so that a host with a third of all
rows spreads over as many ranges as its rows need; its rules are repeated once per range.
The driver sees range bounds only (a bounded sample of keys), never rows.

Defined results. Null url, or one without ``://``: empty host and path, and so no rule fits.
Repeated rows stay repeated. An empty table gives an empty result. A rule table without rows
leaves every verdict at the default. Rules are matched as written after lower-casing the
host's A-Z; of two equal (host, path) rules the one whose verdict sorts first stays. Columns
of the input other than the url are carried along untouched; clashing ones are refused.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from maskloom.llm.common import parts, table

#: Rules of the registered query: (host, path, verdict). Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_PER_RANGE = 40
RANGES_PER_PARTITION = 2


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed by U+0001, which sorts below any host character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


def _bounds(rows: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """Upper bounds of all ranges but the last, from a sample whose size depends on ``ranges`` only.

    The sample keeps the rows with the smallest hashes, so reruns agree.
    """
    total = rows.count()
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(total, 1))
    limit = int(share * 2**62)
    sample = rows if share == 1.0 else rows.where(F.shiftrightunsigned("tie", 2) < limit)
    keys = sorted((r[0], r[1], r[2]) for r in sample.select("key", "path", "tie").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, rules first): one pass with a stack of open rules."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    current = None
    for batch in batches:
        range_id, key, is_rule, path, rule, verdict = (batch.column(i).to_pylist() for i in range(6))
        out_at, out_rule, out_verdict = [], [], []
        for i in range(len(key)):
            if range_id[i] != current:
                current, stack = range_id[i], []
            while stack and not key[i].startswith(stack[-1][0]):
                stack.pop()
            if is_rule[i] == 0:
                if not stack or stack[-1][0] != key[i]:
                    stack.append((key[i], []))
                stack[-1][1].append((path[i], rule[i], verdict[i]))
                continue
            best = None
            for _, rules in reversed(stack):
                for prefix, name, says in rules:
                    if path[i].startswith(prefix) and (best is None or len(name) > len(best[0])):
                        best = (name, says)
            out_at.append(i)
            out_rule.append(best and best[0])
            out_verdict.append(best and best[1])
        if out_at:
            data = batch.column(6).take(pa.array(out_at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [data, pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())], ["row", "rule", "verdict"]
            )


def _placed(bounds: list[tuple[str, str, int]]):
    """Add the range of each row: where it falls for a URL, all it meets for a rule's interval."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, path, tie, is_rule = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "path", "tie", "is_rule"))
            take, ranges = [], []
            for i in range(len(key)):
                if is_rule[i] == 1:
                    found = [bisect_right(bounds, (key[i], path[i], tie[i]))]
                else:
                    found = range(bisect_right(bounds, (key[i], "", -(2**63))), bisect_right(bounds, (key[i][:-1] + "\x02", "", -(2**63))) + 1)
                take += [i] * len(found)
                ranges += found
            if take:
                moved = batch.take(pa.array(take, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *moved.columns], ["range_id", *batch.schema.names])

    return place


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to the rows of ``pages``; ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    clash = {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    ranges = parts(spark) * RANGES_PER_PARTITION
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    source = F.col(f"`{url}`")
    urls = pages.select(row.alias("row"), url_host(source).alias("host"), url_path(source).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("is_rule"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.xxhash64("row").alias("tie"), "row", "host")
    known = rules.where("host is not null and path is not null")
    known = known.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    known = known.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("is_rule"), "path", F.concat("host", "path").alias("rule"), "verdict", F.lit(0).cast("long").alias("tie"), F.lit(None).cast(urls.schema["row"].dataType).alias("row"), "host")
    both = urls.unionByName(known)
    placed = both.mapInArrow(_placed(_bounds(urls, ranges)), T.StructType([T.StructField("range_id", T.IntegerType()), *both.schema.fields]))
    swept = (
        placed.repartition(ranges, "range_id")
        .sortWithinPartitions("range_id", "key", "is_rule")
        .select("range_id", "key", "is_rule", "path", "rule", "verdict", F.struct("row", "host", "path").alias("row"))
    )
    found = swept.mapInArrow(_sweep, T.StructType([swept.schema["row"], *[T.StructField(c, T.StringType()) for c in ("rule", "verdict")]]))
    return found.select("row.row.*", "row.host", "row.path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}"
    for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0] + x[1][1]))
)
SQL = f"""
SELECT page_id, host, path,
       CASE {_FITS.format(*[f"'{h}{p}'" for h, p, _ in RULES])} END AS rule,
       CASE {_FITS.format(*[f"'{v}'" for _, _, v in RULES])} ELSE 'allow' END AS verdict
FROM (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1), '') AS path FROM pages) p"""
