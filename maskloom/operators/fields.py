"""Field rules on JSON leaves, and typed nested columns rebuilt leaf by leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from maskloom.functions import markup, text as tx
from maskloom.operators import vault as v
from maskloom.operators.detect import AT, excluded_path, field_entity, placed
from maskloom.policy import Policy
from maskloom.runtime import computed


def with_field_entity(leaf_rows: DataFrame, policy: Policy) -> DataFrame:
    """Add ``entity_type`` (null: no rule) and ``doubtful`` (a bare ``name`` that does not
    look like a person by its shape; it is masked only when known or detected)."""
    # one rule test after another, each computed once: the filters behind name the result many times
    path = F.col("path")
    # what holds for texts without a path is a constant
    rows = computed(leaf_rows, entity_type=F.when(path == "", field_entity(F.lit(""), policy)).otherwise(field_entity(path, policy)))
    entity = F.col("entity_type")
    secret_mail = entity.eqNullSafe("SECRET") & tx.looks_like_email(F.col("text"))  # without a rule the text is not looked at
    rows = rows.withColumn("__rule", F.when(secret_mail, F.lit("EMAIL_ADDRESS")).otherwise(entity)).drop("entity_type")
    bare_name = (F.col("key") == "name") & (F.col("__rule") == "PERSON")
    refused = bare_name & tx.name_rejected(F.col("text"), policy)
    judged = computed(
        rows,
        entity_type=F.when(F.coalesce(refused, F.lit(False)), F.lit(None)).otherwise(F.col("__rule")),
        doubtful=F.coalesce(bare_name & ~refused & ~tx.name_structure(F.col("text")), F.lit(False)),
    )
    return judged.drop("__rule")


def field_findings(leaf_rows: DataFrame, keys: list[str], policy: Policy, vault: DataFrame, gazetteer=None) -> DataFrame:
    """Whole-value findings of the field rules, in the findings layout."""
    ruled = with_field_entity(leaf_rows.where(F.col("path") != ""), policy).where("entity_type is not null")
    sure = ruled.where(~F.col("doubtful"))
    doubtful = ruled.where("doubtful")
    persons = v.forward(vault).where(F.col("entity_type") == "PERSON").select(F.lower("real_value").alias("probe"))
    if gazetteer is not None:
        persons = persons.union(
            gazetteer.where(F.col("entity_type") == "PERSON").select(F.lower("term"))
        )
    confirmed = doubtful.withColumn("probe", F.lower(tx.strip(F.col("text")))).join(
        persons.distinct(), "probe", "left_semi"
    )
    rows = sure.unionByName(confirmed.drop("probe"))
    at = F.struct(
        F.col("leaf_start").alias("leaf"),
        "leaf_moved",
        F.lit(0).alias("piece"),
        F.lit([]).cast(markup.SHIFT).alias("piece_moved"),
    ).cast(AT)
    return placed(
        rows.select(
            *keys,
            F.struct("leaf_no", F.lit(0).alias("piece_no")).alias("unit"),
            "path",
            at.alias("at"),
            F.lit(0).alias("start"),
            F.length("text").alias("end"),
            "entity_type",
            F.col("text").alias("value"),
            F.lit(1.0).alias("score"),
            F.lit("field_rule").alias("phase"),
            F.lit(None).cast("string").alias("surrogate"),
            F.col("json").cast("int").alias("quote"),
        )
    )


def without_fields(leaf_rows: DataFrame, policy: Policy) -> DataFrame:
    """Leaves that go on to text detection: all but those a rule replaces for certain."""
    rows = with_field_entity(leaf_rows, policy)
    return rows.where(F.col("entity_type").isNull() | F.col("doubtful")).drop("entity_type", "doubtful")


def full_names(leaf_rows: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """``first_name`` + ``last_name`` of one object, when together they look like a person."""
    if not policy.field_rules:
        return leaf_rows.where(F.lit(False)).select(*keys, F.lit("").alias("real_value"))
    parts = leaf_rows.where(F.col("key").isin("first_name", "last_name")).groupBy(*keys, "obj")
    both = parts.agg(
        F.max(F.when(F.col("key") == "first_name", F.col("text"))).alias("first"),
        F.max(F.when(F.col("key") == "last_name", F.col("text"))).alias("last"),
    )
    whole = F.concat("first", F.lit(" "), "last")
    return (
        both.select(*keys, whole.alias("real_value"))
        .where(F.col("real_value").isNotNull())
        .where(~tx.name_rejected(F.col("real_value"), policy) & tx.name_structure(F.col("real_value")))
    )


# ── Typed nested columns ─────────────────────────────────────────────────


def string_leaves(value: Column, kind: T.DataType, path: str = "") -> Column:
    """Every string inside a nested value: ``array<struct<path,obj,text>>``.

    The schema is walked on the driver; only column expressions reach the executors.
    """
    layout = "array<struct<path:string,text:string>>"
    if isinstance(kind, T.StringType):
        return F.array(F.struct(F.lit(path).alias("path"), value.alias("text"))).cast(layout)
    if isinstance(kind, T.StructType):
        parts = [
            string_leaves(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)
            for f in kind.fields
            if _has_strings(f.dataType)
        ]
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(F.lit([]).cast(layout)) if parts else F.lit([]).cast(layout)
    if isinstance(kind, T.ArrayType) and _has_strings(kind.elementType):
        inner = F.transform(value, lambda x: string_leaves(x, kind.elementType, path))
        return F.coalesce(F.flatten(inner), F.lit([]).cast(layout))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and _has_strings(kind.valueType):
        prefix = f"{path}." if path else ""
        inner = F.transform(
            F.map_entries(value),
            lambda e: F.transform(
                string_leaves(e["value"], kind.valueType, ""),
                lambda leaf: F.struct(
                    F.concat(F.lit(prefix), e["key"], F.when(leaf["path"] == "", F.lit("")).otherwise(F.concat(F.lit("."), leaf["path"]))).alias("path"),
                    leaf["text"].alias("text"),
                ),
            ),
        )
        return F.coalesce(F.flatten(inner), F.lit([]).cast(layout))
    return F.lit([]).cast(layout)


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _has_strings(kind.valueType)
    return isinstance(kind, T.StringType)


def rebuild(value: Column, kind: T.DataType, changes: Column, path: Column | str = "") -> Column:
    """The same value with each string replaced by its entry in ``changes``.

    ``changes``: ``array<struct<path,text,masked>>`` of this row, only what changed.
    Everything that is not a string keeps its type and value.
    """
    here = F.lit(path) if isinstance(path, str) else path

    def below(name) -> Column:
        return F.when(here == "", name).otherwise(F.concat(here, F.lit("."), name))

    if isinstance(kind, T.StringType):
        hit = F.filter(changes, lambda c: (c["path"] == here) & (c["text"] == value))
        return F.coalesce(F.try_element_at(hit, F.lit(1))["masked"], value)
    if not _has_strings(kind):
        return value
    if isinstance(kind, T.StructType):
        fields = [rebuild(value[f.name], f.dataType, changes, below(F.lit(f.name))).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rebuild(x, kind.elementType, changes, here))
    return F.transform_values(value, lambda k, x: rebuild(x, kind.valueType, changes, below(k)))
