"""Reversal: surrogates in text and arguments back to real values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskloom.functions.splice import splice
from maskloom.operators import detect, vault as v
from maskloom.operators.scan import scan, surrogate_patterns
from maskloom.policy import Policy
from maskloom.runtime import checked_broadcast, materialize, spread


def demask(docs: DataFrame, keys: list[str], vault: DataFrame, text: str = "text") -> DataFrame:
    """Every surrogate in ``docs.text``, case-sensitive, longest first, also inside words.

    Adds ``demasked`` and ``replacements`` (distinct surrogate, real value, type).
    """
    source = spread(docs.select(*keys, F.col(text).alias("text")))
    hits = scan(source, keys, surrogate_patterns(vault, fold=False), words=False, fold=False)
    kept = detect.resolve(hits, keys, prefer="length")
    edit = F.struct("start", "end", F.col("real_value").alias("replacement"), F.col("value").alias("surrogate"), "entity_type")
    edits = materialize(kept.groupBy(*keys).agg(F.sort_array(F.collect_list(edit)).alias("__edits")))
    side, _ = checked_broadcast(edits)
    replaced = F.array_sort(
        F.array_distinct(
            F.transform(
                "__edits",
                lambda e: F.struct(
                    e["surrogate"].alias("surrogate"), e["replacement"].alias("real_value"), e["entity_type"].alias("entity_type")
                ),
            )
        )
    )
    has = F.col("__edits").isNotNull()
    none = F.lit([]).cast("array<struct<surrogate:string,real_value:string,entity_type:string>>")
    return (
        docs.join(side, keys, "left")
        .withColumns(
            {
                "demasked": F.when(has, splice(F.col(text), F.col("__edits"))).otherwise(F.col(text)),
                "replacements": F.when(has, replaced).otherwise(none),
            }
        )
        .drop("__edits")
    )


def demap_findings(docs: DataFrame, keys: list[str], policy: Policy, vault: DataFrame, kind: str = "document") -> DataFrame:
    """Surrogates in argument strings: any letter case, whole words, four characters or more.

    JSON text is searched value by value; values under never-mask paths are left alone.
    """
    leaf_rows = detect.leaves(docs, keys, kind)
    leaf_rows = leaf_rows.where(~detect.excluded_path(F.col("path"), policy))
    units = detect.as_units(leaf_rows, keys)
    hits = scan(units, [*keys, "unit", "at", "quote"], surrogate_patterns(vault, fold=True, floor=4), words=True, fold=True)
    placed = detect.placed(hits).withColumnRenamed("real_value", "replacement")
    return detect.resolve(placed, keys, prefer="length")


def demap(docs: DataFrame, keys: list[str], policy: Policy, vault: DataFrame, kind: str = "document") -> DataFrame:
    """Demap ``docs.text``; adds ``demapped_count``, the number of string values that changed."""
    from maskloom.plans.mask import apply_findings

    found = materialize(demap_findings(spread(docs.select(*keys, *[c for c in ("path", "text") if c in docs.columns])), keys, policy, vault, kind))
    changed = found.where(F.col("value") != F.col("replacement")).groupBy(*keys).agg(
        F.count_distinct("unit.leaf_no").cast("int").alias("demapped_count")
    )
    side, _ = checked_broadcast(changed)
    out = apply_findings(docs, keys, found).drop("entity_types", "masked_count")
    return out.join(side, keys, "left").withColumn("demapped_count", F.coalesce("demapped_count", F.lit(0)))


def count_changes(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Changed string values between two versions of the same JSON documents."""
    a = detect.leaves(before.select(*keys, F.col(text).alias("text")), keys).select(*keys, "leaf_no", F.col("text").alias("old"))
    b = detect.leaves(after.select(*keys, F.col(text).alias("text")), keys).select(*keys, "leaf_no", F.col("text").alias("new"))
    return a.join(b, [*keys, "leaf_no"]).groupBy(*keys).agg(F.count_if(F.col("old") != F.col("new")).alias("changed"))


def lookup(surrogates: DataFrame, vault: DataFrame) -> DataFrame:
    """Surrogate lookup with a ``found`` flag."""
    out = v.find_real_anywhere(surrogates, vault)
    return out.select("surrogate", F.col("found_type").alias("entity_type"), "real_value", F.col("real_value").isNotNull().alias("found"))
