"""Mask a table of documents: discover, assign, apply.

One plan cannot both create a surrogate and use it, so there are two passes over the
text with the vault written in between:

1. *discover*: pattern, dictionary and field-rule findings; only narrow rows are kept;
2. *assign*: the distinct new values get surrogates; the vault grows;
3. *apply*: vault values are found in all texts (also those seen first in this batch),
   conflicts are settled, and each document is spliced once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import filters, text as tx
from maskloom.functions.splice import splice
from maskloom.operators import assign as asg, detect, fields, vault as v
from maskloom.policy import Policy, policy_table
from maskloom.runtime import checked_broadcast, computed, is_spread, materialize, spread, spread_join

Hook = Callable[[DataFrame], DataFrame]


@dataclass
class Masked:
    """``documents``: keys, masked text, entity_types, masked_count. ``findings``: what was
    replaced. ``vault``: everything known now. ``added``: the rows this call added."""

    documents: DataFrame
    findings: DataFrame
    vault: DataFrame
    added: DataFrame


def _layout(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.select(*keys, *detect.FINDING_COLUMNS)


def hooked(units: DataFrame, keys: list[str], policy: Policy, hooks: Sequence[Hook]) -> DataFrame | None:
    """Findings of the user's own detectors.

    A hook gets ``units(keys, unit, path, text)`` and returns keys, unit, start, end,
    entity_type and score; it may wrap a pandas UDF. Its rows pass the same filters.
    """
    out = None
    for hook in hooks:
        made = hook(units.select(*keys, "unit", "path", "text"))
        made = made.select(*keys, "unit", F.col("start").cast("int"), F.col("end").cast("int"), "entity_type", F.col("score").cast("double"))
        rows = units.join(made, [*keys, "unit"]).withColumn(
            "value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
        )
        rows = computed(rows, protected=filters.protected_spans(F.col("text"))).where(
            filters.unprotected(F.col("entity_type"), F.col("start"), F.col("end"), F.col("protected"))
            & filters.quality(policy)
        )
        rows = rows.drop("protected", "text").withColumns(
            {"phase": F.lit("recognizer"), "surrogate": F.lit(None).cast("string")}
        )
        rows = _layout(detect.placed(rows), keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def discover(
    docs: DataFrame,
    keys: list[str],
    policy: Policy,
    vault: DataFrame | None = None,
    *,
    gazetteer: DataFrame | None = None,
    hooks: Sequence[Hook] = (),
    kind: str = "document",
) -> DataFrame:
    """Findings of ``docs(keys, text[, path])`` except known vault values.

    Partial masks come out as phase ``partial`` with the surrogate they stand for.
    """
    vault = v.empty_vault(docs.sparkSession) if vault is None else vault
    leaf_rows = detect.leaves(docs, keys, kind)
    leaf_rows = leaf_rows.where(~detect.excluded_path(F.col("path"), policy))
    units = detect.pieces(fields.without_fields(leaf_rows, policy), keys)

    found = _layout(detect.recognized(units, keys, policy), keys)
    if gazetteer is not None:
        found = found.unionByName(_layout(detect.dictionary(units, keys, policy, gazetteer), keys))
    extra = hooked(units, keys, policy, hooks)
    if extra is not None:
        found = found.unionByName(extra)
    found = materialize(found)  # the text is read once; what follows works on narrow rows
    partial = found.where(F.col("phase") == "partial")
    found = detect.without_known_surrogates(found.where(F.col("phase") != "partial"), vault)
    answers = v.reconcile(partial.select("entity_type", F.col("value").alias("partial")), vault)
    partial = spread_join(
        partial.drop("surrogate"),
        answers.withColumnRenamed("partial", "value"),
        ["entity_type", "value"],
        "inner",
    )
    ruled_rows = detect.leaves(docs, keys, kind, ruled=True)
    ruled_rows = ruled_rows.where(~detect.excluded_path(F.col("path"), policy))
    ruled = _layout(fields.field_findings(ruled_rows, keys, policy, vault, gazetteer), keys)
    return found.select(ruled.columns).unionByName(partial.select(ruled.columns)).unionByName(ruled)


def _blobs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-text SECRET findings."""
    size = F.length("text")
    return docs.where(~tx.blank(F.col("text"))).select(
        *keys,
        F.struct(F.lit(0).alias("leaf_no"), F.lit(0).alias("piece_no")).alias("unit"),
        F.lit("").alias("path"),
        F.lit(0).alias("start"),
        size.alias("end"),
        F.lit("SECRET").alias("entity_type"),
        F.col("text").alias("value"),
        F.lit(1.0).alias("score"),
        F.lit("blob").alias("phase"),
        F.lit(None).cast("string").alias("surrogate"),
        F.lit(0).alias("doc_start"),
        size.alias("doc_end"),
        F.lit(0).alias("quote"),
    )


def _quoted(replacement: Column, quote: Column) -> Column:
    html = F.when(quote.bitwiseAND(2) > 0, tx.html_quoted(replacement)).otherwise(replacement)
    return F.when(quote.bitwiseAND(1) > 0, tx.json_quoted(html)).otherwise(html)


def apply_findings(docs: DataFrame, keys: list[str], findings: DataFrame, text: str = "text") -> DataFrame:
    """Splice ``findings(keys, doc_start, doc_end, entity_type, replacement, quote)`` into the texts."""
    edit = F.struct(
        F.col("doc_start").alias("start"),
        F.col("doc_end").alias("end"),
        _quoted(F.col("replacement"), F.col("quote")).alias("replacement"),
        "entity_type",
    )
    edits = findings.groupBy(*keys).agg(F.sort_array(F.collect_list(edit)).alias("__edits"))
    side, _ = checked_broadcast(edits)
    joined = docs.join(side, keys, "left")
    has = F.col("__edits").isNotNull()
    return joined.withColumns(
        {
            text: F.when(has, splice(F.col(text), F.col("__edits"))).otherwise(F.col(text)),
            "entity_types": F.when(
                has, F.array_distinct(F.transform("__edits", lambda e: e["entity_type"]))
            ).otherwise(F.lit([]).cast("array<string>")),
            "masked_count": F.when(has, F.size("__edits")).otherwise(F.lit(0)),
        }
    ).drop("__edits")


def with_replacements(findings: DataFrame, vault: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``replacement``: the finding's own surrogate, else the one of its value."""
    asked = findings.where("surrogate is null").select("entity_type", F.col("value").alias("real_value"))
    answers = asg.surrogates_for(asked, vault, rules).withColumnRenamed("real_value", "value")
    joined = spread_join(findings, answers, ["entity_type", "value"], "left")
    return joined.withColumn(
        "replacement",
        F.coalesce("surrogate", "replacement", F.concat(F.lit("<"), F.col("entity_type"), F.lit(">"))),
    )


def mask(
    docs: DataFrame,
    keys: list[str],
    policy: Policy,
    key: str,
    vault: DataFrame | None = None,
    *,
    gazetteer: DataFrame | None = None,
    hooks: Sequence[Hook] = (),
    kind: str = "document",
    rescan: bool = True,
) -> Masked:
    """Mask ``docs(keys, text, ...)``; other columns pass through.

    A boolean column ``blob``, when there, marks texts replaced whole as one SECRET.

    ``rescan``: look for all vault values, those added by this call included. Without it
    only findings are replaced (no second pass over the text when the vault is empty).
    """
    spark = docs.sparkSession
    vault = v.empty_vault(spark) if vault is None else vault
    source = docs.select(*keys, *[c for c in ("path", "text", "blob") if c in docs.columns])
    blobs = None
    if "blob" in docs.columns:
        blobs = _blobs(source.where("blob"), keys)
        source = source.where(~F.col("blob")).drop("blob")
    source = source if is_spread(docs) else spread(source)
    held = v.settled(vault)
    found = discover(source, keys, policy, held, gazetteer=gazetteer, hooks=hooks, kind=kind)
    if blobs is not None:
        found = found.unionByName(blobs.select(found.columns))
    found = materialize(found)
    seen = [r[0] for r in found.select("entity_type").distinct().collect()]
    rules = policy_table(spark, policy, key, [*seen, "PERSON"])

    order = F.struct(*keys, "doc_start")
    values = found.where("surrogate is null").select("entity_type", F.col("value").alias("real_value"), order.alias("ord"))
    if policy.field_rules:
        named = detect.leaves(source, keys, kind, ruled=True).where(~detect.excluded_path(F.col("path"), policy))
        names = fields.full_names(named, keys, policy)
        values = values.unionByName(
            names.select(F.lit("PERSON").alias("entity_type"), "real_value", F.struct(*keys, F.lit(-1).alias("doc_start")).alias("ord"))
        )
    added = asg.assign(values, held, rules)
    total = materialize(vault.unionByName(added))

    every = found
    if rescan:
        leaf_rows = detect.leaves(source, keys, kind)
        leaf_rows = leaf_rows.where(~detect.excluded_path(F.col("path"), policy))
        units = detect.pieces(fields.without_fields(leaf_rows, policy), keys)
        known = detect.known(units, keys, policy, total)
        every = every.unionByName(_layout(known, keys).select(every.columns))
    kept = materialize(detect.resolve(every, keys, prefer="length"))
    final = materialize(with_replacements(kept, total, rules))
    return Masked(apply_findings(docs, keys, final), final, total, added)
