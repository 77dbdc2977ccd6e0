"""Audit events of masking and demapping, and the statistics over them.

``audit(ingest_seq, ts, server, tool_name, direction, entity_types, masked_count, demapped_count)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RETENTION = 1000
EVENT_JSON = (
    "timestamp string, server string, tool_name string, direction string, entity_types array<string>, "
    "masked_count long, demapped_count long"
)
FIELDS = ["timestamp", "server", "tool_name", "direction", "entity_types", "masked_count", "demapped_count"]


def events_of(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One ``mask`` and one ``demap`` event per call, each only when something changed.

    ``calls``: keys, server, tool_name, entity_types, masked_count, demapped_count.
    """
    none = F.lit([]).cast("array<string>")
    made = F.array(
        F.struct(
            F.lit("demap").alias("direction"),
            none.alias("entity_types"),
            F.lit(0).cast("long").alias("masked_count"),
            F.col("demapped_count").cast("long").alias("demapped_count"),
        ),
        F.struct(
            F.lit("mask").alias("direction"),
            F.col("entity_types").alias("entity_types"),
            F.col("masked_count").cast("long").alias("masked_count"),
            F.lit(0).cast("long").alias("demapped_count"),
        ),
    )
    return (
        calls.select(*keys, "server", "tool_name", F.explode(made).alias("e"))
        .select(*keys, "server", "tool_name", "e.*")
        .where((F.col("masked_count") > 0) | (F.col("demapped_count") > 0))
    )


def ingest(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse event bodies; what is missing becomes '', an empty list or 0."""
    event = F.from_json(F.col(body), EVENT_JSON)
    rest = [c for c in bodies.columns if c != body]
    text = [F.coalesce(event[c], F.lit("")).alias(c) for c in FIELDS[:4]]
    return bodies.select(
        *rest,
        *text,
        F.coalesce(event["entity_types"], F.lit([]).cast("array<string>")).alias("entity_types"),
        F.coalesce(event["masked_count"], F.lit(0).cast("long")).alias("masked_count"),
        F.coalesce(event["demapped_count"], F.lit(0).cast("long")).alias("demapped_count"),
    )


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum("masked_count"), F.lit(0)).alias("total_masked"),
        F.coalesce(F.sum("demapped_count"), F.lit(0)).alias("total_demapped"),
    )


def entity_counts(events: DataFrame) -> DataFrame:
    return events.select(F.explode("entity_types").alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def column_counts(events: DataFrame, column: str) -> DataFrame:
    """Events per tool or server; blanks are skipped."""
    return events.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, n: int = 50) -> DataFrame:
    """Newest first by arrival. Each task keeps its own top n, only those meet."""
    return events.orderBy(F.desc("ingest_seq")).limit(n)


def retained(events: DataFrame, bound: int = RETENTION) -> DataFrame:
    return recent(events, bound)


def to_json(events: DataFrame) -> DataFrame:
    """Each event as one JSON record, all fields present."""
    return events.select("ingest_seq", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("record"))


def export(events: DataFrame, path: str) -> None:
    events.select(*FIELDS).write.mode("overwrite").json(path)
