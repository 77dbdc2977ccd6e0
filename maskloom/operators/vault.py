"""The vault: lookups, upsert, sub-tokens, partial reconciliation, listings.

``vault(entity_type, real_value, surrogate, seq, derived)``. A probe table is joined to
it on a lower-cased key; the exact match and the insertion order are ranked afterwards
among the few rows that share that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions.text import preview, words
from maskloom.runtime import materialize, spread_join

VAULT = "entity_type string, real_value string, surrogate string, seq long, derived boolean"
SUBTOKEN_TYPES = ("PERSON",)


def empty_vault(spark) -> DataFrame:
    return spark.createDataFrame([], VAULT)


def forward(vault: DataFrame) -> DataFrame:
    """One row per (type, real value): the last one written."""
    if getattr(vault, "_settled", False):
        return vault
    return (
        vault.groupBy("entity_type", "real_value")
        .agg(F.max_by(F.struct("surrogate", "seq", "derived"), "seq").alias("w"))
        .select("entity_type", "real_value", "w.surrogate", "w.seq", "w.derived")
    )


def settled(vault: DataFrame) -> DataFrame:
    """``forward``, computed once for all the lookups that begin with it."""
    if getattr(vault, "_settled", False):
        return vault
    done = materialize(forward(vault))
    done._settled = True
    return done


def reverse(vault: DataFrame) -> DataFrame:
    """One row per (type, surrogate): the last real value written, and its CI key."""
    return (
        forward(vault)
        .groupBy("entity_type", "surrogate")
        .agg(F.max_by(F.struct("real_value", "seq"), "seq").alias("w"))
        .select(
            "entity_type",
            "surrogate",
            F.lower("surrogate").alias("surrogate_lower"),
            "w.real_value",
            "w.seq",
        )
    )


def upsert(vault: DataFrame, rows: DataFrame) -> DataFrame:
    return forward(vault.unionByName(rows))


def _best(probes: DataFrame, table: DataFrame, key: str, keys: list[str], rank: Column, payload: Column) -> DataFrame:
    """Left join on ``key`` and keep the best-ranked row of the matches of each probe."""
    return (
        probes.join(table, key, "left")
        .groupBy(*keys)
        .agg(F.min_by(payload, rank).alias("best"))
        .select(*keys, "best.*")
    )


def _probe(
    rows: DataFrame, table: DataFrame, *, probe: Column, key: Column, keys: list[str], rank: Column, payload: Column
) -> DataFrame:
    """Distinct the probe values first, look each one up once, join the answers back.

    A value held by a third of all rows costs one lookup, and the join back salts it.
    """
    distinct = rows.select(*keys).distinct().withColumn("__k", probe)
    answers = _best(distinct, table.withColumn("__k", key), "__k", keys, rank, payload)
    return spread_join(rows, answers, keys, "left")


def find_surrogate(rows: DataFrame, vault: DataFrame, out: str = "surrogate") -> DataFrame:
    """(type, real) -> surrogate within the type: exact, then any letter case."""
    table = forward(vault).select(
        F.col("entity_type").alias("__type"), F.col("real_value").alias("__real"), F.col("surrogate").alias("__s"), "seq"
    )
    rank = F.struct((F.col("__real") != F.col("real_value")).cast("int"), F.col("seq"))
    ok = F.col("__type") == F.col("entity_type")
    return _probe(
        rows,
        table,
        probe=F.lower("real_value"),
        key=F.lower("__real"),
        keys=["entity_type", "real_value"],
        rank=F.when(ok, rank),
        payload=F.struct(F.when(ok, F.col("__s")).alias(out)),
    )


def find_surrogate_anywhere(rows: DataFrame, vault: DataFrame, out: str = "surrogate") -> DataFrame:
    """real -> surrogate in any type: an exact match anywhere first, then CI, oldest first.

    Types are tried in the order of their first row; within a type the oldest row wins.
    """
    fwd = forward(vault)
    ages = fwd.groupBy("entity_type").agg(F.min("seq").alias("__age"))
    table = fwd.join(F.broadcast(ages), "entity_type").select(
        F.col("entity_type").alias("found_type"), F.col("real_value").alias("__real"), F.col("surrogate").alias("__s"), "__age", "seq"
    )
    rank = F.struct((F.col("__real") != F.col("real_value")).cast("int"), F.col("__age"), F.col("seq"))
    return _probe(
        rows,
        table,
        probe=F.lower("real_value"),
        key=F.lower("__real"),
        keys=["real_value"],
        rank=rank,
        payload=F.struct(F.col("found_type"), F.col("__s").alias(out)),
    )


def find_both(distinct: DataFrame, vault: DataFrame) -> DataFrame:
    """For distinct ``(entity_type, real_value, ...)``: ``same`` (within the type) and
    ``anywhere`` (any type) in one join. Other columns of ``distinct`` must be per value."""
    fwd = forward(vault)
    ages = fwd.groupBy("entity_type").agg(F.min("seq").alias("__age"))
    table = fwd.join(F.broadcast(ages), "entity_type").select(
        F.lower("real_value").alias("__k"), F.col("entity_type").alias("__type"),
        F.col("real_value").alias("__real"), F.col("surrogate").alias("__s"), "__age", F.col("seq").alias("__seq"),
    )
    inexact = (F.col("__real") != F.col("real_value")).cast("int")
    typed = F.when(F.col("__type") == F.col("entity_type"), F.struct(inexact, F.col("__seq")))
    rest = [c for c in distinct.columns if c not in ("entity_type", "real_value")]
    return (
        distinct.withColumn("__k", F.lower("real_value"))
        .join(table, "__k", "left")
        .groupBy("entity_type", "real_value")
        .agg(
            F.min_by("__s", typed).alias("same"),
            F.min_by("__s", F.struct(inexact, F.col("__age"), F.col("__seq"))).alias("anywhere"),
            *[F.first(c).alias(c) for c in rest],
        )
    )


def find_real(rows: DataFrame, vault: DataFrame, out: str = "real_value") -> DataFrame:
    """(type, surrogate) -> real, exact only."""
    return spread_join(
        rows, reverse(vault).select("entity_type", "surrogate", F.col("real_value").alias(out)), ["entity_type", "surrogate"]
    )


def find_real_anywhere(rows: DataFrame, vault: DataFrame, out: str = "real_value") -> DataFrame:
    """surrogate -> (type, real) in any type: exact first, then any letter case."""
    rev = reverse(vault)
    ages = rev.groupBy("entity_type").agg(F.min("seq").alias("__age"))
    table = rev.join(F.broadcast(ages), "entity_type").select(
        F.col("entity_type").alias("found_type"),
        F.col("surrogate").alias("__sur"),
        F.col("real_value").alias("__r"),
        "surrogate_lower",
        "__age",
        "seq",
    )
    exact = F.col("__sur") == F.col("surrogate")
    # among other letter cases of one type the last one written is the indexed one
    rank = F.struct(
        (~exact).cast("int"), F.col("__age"), F.when(exact, F.col("seq")).otherwise(-F.col("seq"))
    )
    return _probe(
        rows,
        table,
        probe=F.lower("surrogate"),
        key=F.col("surrogate_lower"),
        keys=["surrogate"],
        rank=rank,
        payload=F.struct(F.col("found_type"), F.col("__r").alias(out)),
    )


def restore(rows: DataFrame, vault: DataFrame, out: str = "restored") -> DataFrame:
    """Typed reverse lookup, then any type, else the surrogate itself."""
    typed = find_real(rows, vault, "__typed")
    both = find_real_anywhere(typed, vault, "__any")
    return both.withColumn(out, F.coalesce("__typed", "__any", "surrogate")).drop("__typed", "__any", "found_type")


# ── Sub-tokens ───────────────────────────────────────────────────────────


def aligned_pairs(real: Column, surrogate: Column) -> Column:
    """Word pairs of a multi-word value whose surrogate has as many words (else empty)."""
    left, right = words(real), words(surrogate)
    pairs = F.transform(
        left, lambda w, i: F.struct(w.alias("real"), F.element_at(right, i + 1).alias("surrogate"), i.alias("pos"))
    )
    return F.when((F.size(left) > 1) & (F.size(left) == F.size(right)), pairs).otherwise(
        F.lit([]).cast("array<struct<real:string,surrogate:string,pos:int>>")
    )


def subtokens(rows: DataFrame, vault: DataFrame) -> DataFrame:
    """Word mappings of new PERSON rows: the earliest pair wins in both directions.

    ``rows`` are vault rows. A word that already has a surrogate keeps it; a surrogate
    word owned by another real word is not reused. Map-side min aggregates, no windows.
    """
    pairs = (
        rows.where(F.col("entity_type").isin(*SUBTOKEN_TYPES))
        .select("entity_type", "seq", F.explode(aligned_pairs(F.col("real_value"), F.col("surrogate"))).alias("p"))
        .select(
            "entity_type",
            F.col("p.real").alias("real_value"),
            F.col("p.surrogate").alias("surrogate"),
            F.struct("seq", F.col("p.pos").alias("pos")).alias("ord"),
        )
    )
    taken = forward(vault)
    own = reverse(vault).select("entity_type", "surrogate", F.col("real_value").alias("__owner"))
    by_real = (
        pairs.groupBy("entity_type", "real_value")
        .agg(F.min_by(F.struct("surrogate", "ord"), "ord").alias("w"))
        .select("entity_type", "real_value", "w.surrogate", "w.ord")
        .join(taken.select("entity_type", "real_value"), ["entity_type", "real_value"], "left_anti")
        .join(own, ["entity_type", "surrogate"], "left")
        .where(F.col("__owner").isNull() | (F.col("__owner") == F.col("real_value")))
    )
    return (
        by_real.groupBy("entity_type", "surrogate")
        .agg(F.min_by(F.struct("real_value", "ord"), "ord").alias("w"))
        .select("entity_type", "w.real_value", "surrogate", F.col("w.ord.seq").alias("seq"), F.lit(True).alias("derived"))
    )


def claims(rows: DataFrame, column: str, keep=()) -> DataFrame:
    """Every word form a candidate would occupy: itself, and its aligned PERSON words."""
    kind = "struct<token:string,owner:string>"
    own = F.array(F.struct(F.lower(column).alias("token"), F.col("real_value").alias("owner")).cast(kind))
    aligned = F.transform(
        aligned_pairs(F.col("real_value"), F.col(column)),
        lambda p: F.struct(F.lower(p["surrogate"]).alias("token"), p["real"].alias("owner")).cast(kind),
    )
    both = F.when(F.col("entity_type").isin(*SUBTOKEN_TYPES), F.concat(own, aligned)).otherwise(own)
    names = ["entity_type", "real_value", *keep]
    return rows.select(*names, F.explode(both).alias("c")).select(*names, "c.token", "c.owner")


def collisions(candidates: DataFrame, vault: DataFrame) -> DataFrame:
    """``(entity_type, real_value, candidate)`` plus ``collides``: the candidate, or one of
    its aligned PERSON words, belongs to another real value in the vault or the batch."""
    wanted = claims(candidates, "candidate")
    owners = reverse(vault).select(F.col("surrogate_lower").alias("token"), F.col("real_value").alias("owner"))
    spans = (
        owners.union(wanted.select("token", "owner"))
        .groupBy("token")
        .agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    )
    bad = (
        wanted.join(spans.where("lo <> hi"), "token", "left_semi")
        .select("entity_type", "real_value")
        .distinct()
        .withColumn("collides", F.lit(True))
    )
    return candidates.join(bad, ["entity_type", "real_value"], "left").withColumn(
        "collides", F.coalesce("collides", F.lit(False))
    )


# ── Partial masks ────────────────────────────────────────────────────────

MASK_CHARS = "*X"


def mask_shape(value: Column) -> Column:
    """Which positions are visible, as a 0/1 string (null when nothing is masked)."""
    shape = F.regexp_replace(F.regexp_replace(value, r"(?s)[^*X]", "1"), "[*X]", "0")
    return F.when(F.contains(shape, F.lit("0")), shape)


def visible(value: Column, shape: Column) -> Column:
    """The characters of ``value`` at the visible positions of ``shape``."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    kept = F.filter(chars, lambda _, i: F.substring(shape, i + 1, F.lit(1)) == "1")
    return F.array_join(kept, "")


def reconcile(partials: DataFrame, vault: DataFrame) -> DataFrame:
    """``(entity_type, partial)`` -> the surrogate of the one real value it can stand for.

    Each mask shape in use is applied to the vault values of its type and length; the
    visible characters are then an equi-join key. Shapes are few (one per number format) and
    are broadcast once measured; should they be many, the values of a frequent type and length
    are salted.
    """
    probes = partials.select("entity_type", "partial").distinct().withColumn("shape", mask_shape(F.col("partial")))
    probes = probes.where("shape is not null").withColumn("seen", visible(F.col("partial"), F.col("shape")))
    shapes = probes.select("entity_type", "shape", F.length("shape").alias("n")).distinct()
    fwd = forward(vault).withColumn("n", F.length("real_value"))
    keyed = spread_join(fwd, shapes, ["entity_type", "n"], "inner").withColumn("seen", visible(F.col("real_value"), F.col("shape")))
    # one vault row per visible signature: counted map-side, so a popular ending is one row
    unique = (
        keyed.groupBy("entity_type", "shape", "seen")
        .agg(F.count(F.lit(1)).alias("matches"), F.max("surrogate").alias("surrogate"))
        .where("matches = 1")
        .drop("matches")
    )
    return probes.join(unique, ["entity_type", "shape", "seen"]).select("entity_type", "partial", "surrogate")


# ── Listings ─────────────────────────────────────────────────────────────


def all_surrogates(vault: DataFrame) -> DataFrame:
    return forward(vault).select("surrogate").distinct()


def summary(vault: DataFrame) -> DataFrame:
    """Entries per type, and one row for the total (type null)."""
    return forward(vault).rollup("entity_type").agg(F.count(F.lit(1)).alias("entries"))


def listing(vault: DataFrame, reveal: bool = False) -> DataFrame:
    shown = F.col("real_value") if reveal else preview(F.col("real_value"))
    return forward(vault).select("entity_type", shown.alias("real_shown"), "surrogate")
