"""Masking records: typed nested columns, JSON-RPC bodies, tables of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from maskloom.functions import filters, markup, text as tx
from maskloom.functions.spans import walk
from maskloom.functions.splice import splice
from maskloom.operators import audit, demask, fields
from maskloom.plans.mask import Masked, mask
from maskloom.policy import Policy, glob_regex
from maskloom.runtime import checked_broadcast, computed, materialize

#: A text of a call's result and where it stands there.
ITEM = "array<struct<item:int,text:string>>"


def mask_columns(
    df: DataFrame, keys: list[str], columns: list[str], policy: Policy, key: str, vault: DataFrame | None = None, **options
) -> Masked:
    """Mask every string inside ``columns`` of any shape; other types pass unchanged.

    The distinct (path, value) pairs of each row are masked as values; the columns are
    then rebuilt from the schema. Paths start with the field names inside the column.
    """
    parts = [_tagged(c, fields.string_leaves(F.col(c), df.schema[c].dataType)) for c in columns]
    flat = F.array_distinct(F.concat(*parts))
    leaf_docs = df.select(*keys, F.posexplode(flat).alias("__n", "__leaf")).select(*keys, "__n", "__leaf.*")
    inner = [*keys, "__n"]
    done = mask(leaf_docs, inner, policy, key, vault, kind="value", **options)
    before = leaf_docs.select(*inner, F.col("text").alias("__before"))
    changed = done.documents.where("masked_count > 0").join(before, inner)
    edits = materialize(
        changed.groupBy(*keys).agg(
            F.collect_list(F.struct("column", "path", F.col("__before").alias("text"), F.col("text").alias("masked"))).alias("__changes"),
            F.array_distinct(F.flatten(F.collect_list("entity_types"))).alias("entity_types"),
            F.sum("masked_count").cast("int").alias("masked_count"),
        )
    )
    side, _ = checked_broadcast(edits)
    joined = df.join(side, keys, "left")
    rebuilt = {
        c: F.when(
            F.col("__changes").isNotNull(),
            fields.rebuild(F.col(c), df.schema[c].dataType, F.filter("__changes", _in_column(c))),
        ).otherwise(F.col(c))
        for c in columns
    }
    out = joined.withColumns(
        {
            **rebuilt,
            "entity_types": F.coalesce("entity_types", F.lit([]).cast("array<string>")),
            "masked_count": F.coalesce("masked_count", F.lit(0)),
        }
    ).drop("__changes")
    return Masked(out, done.findings, done.vault, done.added)


def _tagged(column: str, leaves):
    return F.transform(
        leaves, lambda leaf: F.struct(F.lit(column).alias("column"), leaf["path"].alias("path"), leaf["text"].alias("text"))
    )


def _in_column(column: str):
    return lambda change: change["column"] == column


# ── JSON-RPC bodies ──────────────────────────────────────────────────────


def mask_envelopes(
    bodies: DataFrame, keys: list[str], policy: Policy, key: str, vault: DataFrame | None = None, body: str = "body", **options
) -> Masked:
    """Mask ``result.content[*].text`` of items of type ``text``, in single and batch bodies.

    All other bytes of a body stay as they are; a body that is not JSON is left alone.
    """
    docs = computed(bodies.select(*keys, F.col(body).alias("text")), json=filters.is_json(F.col("text"))).where("json")
    docs = computed(docs, leaves=markup.json_leaves(F.col("text")))
    wanted = markup.siblings(F.col("leaves"), "result.content.type", "text", "result.content.text")
    items = docs.select(*keys, F.explode(wanted).alias("leaf")).select(
        *keys, F.col("leaf.start").alias("__start"), F.col("leaf.raw").alias("__raw"), markup.json_string(F.col("leaf.raw")).alias("text")
    )
    done = mask(items, [*keys, "__start"], policy, key, vault, **options)
    changed = done.documents.where("masked_count > 0")
    edit = F.struct(
        F.col("__start").alias("start"),
        (F.col("__start") + F.length("__raw")).alias("end"),
        tx.json_quoted(F.col("text")).alias("replacement"),
    )
    edits = materialize(
        changed.groupBy(*keys).agg(
            F.sort_array(F.collect_list(edit)).alias("__edits"), F.sum("masked_count").cast("int").alias("masked_count")
        )
    )
    side, _ = checked_broadcast(edits)
    out = (
        bodies.join(side, keys, "left")
        .withColumns(
            {
                body: F.when(F.col("__edits").isNotNull(), splice(F.col(body), F.col("__edits"))).otherwise(F.col(body)),
                "masked_count": F.coalesce("masked_count", F.lit(0)),
            }
        )
        .drop("__edits")
    )
    return Masked(out, done.findings, done.vault, done.added)


# ── Tool calls ───────────────────────────────────────────────────────────


def sensitive(text, policy: Policy):
    """Any string of the argument JSON matches a sensitive-argument glob."""
    if not policy.sensitive_args:
        return F.lit(False)
    leaves = markup.json_leaves(F.when(filters.is_json(text), text))

    def matches(leaf):
        value = markup.json_string(leaf["raw"])
        hit = F.lit(False)
        for pattern in policy.sensitive_args:
            hit = hit | value.rlike(glob_regex(pattern))
        return hit

    return F.coalesce(F.exists(leaves, matches), F.lit(False))


def content_texts(content: Column, kind: T.DataType) -> Column:
    """The texts of a result with their positions: a string is one text, a list of strings has one an item;
    of a list of structs the items with a ``text`` count, if they have a ``type`` only those of type ``text``."""

    def at(i: Column, text: Column) -> Column:
        return F.struct(i.cast("int").alias("item"), text.alias("text"))

    if isinstance(kind, T.StringType):
        texts = F.array(at(F.lit(0), content))
    elif isinstance(kind.elementType, T.StringType):
        texts = F.transform(content, lambda c, i: at(i, c))
    elif "text" in kind.elementType.names:
        shown = (lambda c: c["type"] == "text") if "type" in kind.elementType.names else (lambda c: F.lit(True))
        texts = F.transform(content, lambda c, i: at(i, F.when(shown(c), c["text"])))
    else:
        return F.lit([]).cast(ITEM)
    return F.coalesce(F.filter(texts.cast(ITEM), lambda x: x["text"].isNotNull()), F.lit([]).cast(ITEM))


def with_texts(content: Column, kind: T.DataType, changes: Column) -> Column:
    """The result with the texts of ``changes`` (sorted by position) in place; all else keeps its type and value."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.get(changes, F.lit(0))["text"], content)
    layout = kind.simpleString()
    plain = isinstance(kind.elementType, T.StringType)

    def step(done: Column, here: Column) -> tuple[Column, Column]:
        change = F.get(changes, done)
        hit = F.coalesce(change["item"] == here["i"], F.lit(False))
        new = change["text"] if plain else here["c"].withField("text", change["text"])
        return done + hit.cast("int"), F.array(F.when(hit, new).otherwise(here["c"])).cast(layout)

    places = F.transform(content, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return F.when(content.isNotNull(), walk(places, F.lit(0), layout, step))


def mask_calls(
    calls: DataFrame, keys: list[str], policy: Policy, key: str, vault: DataFrame, **options
) -> tuple[Masked, DataFrame]:
    """The full round trip of ``calls(keys, server, tool_name, args, content)``.

    Arguments are demapped; a call whose arguments match a sensitive glob has each text
    replaced whole by one SECRET surrogate; other texts are masked; a notice is added.
    ``content`` is a string, a list of strings or a list of structs with any fields; what
    is not text passes unchanged, a null result stays null. ``structured`` (a struct column),
    when there, is masked too and nulled for sensitive calls. Returns the calls and their
    audit events.
    """
    kind = calls.schema["content"].dataType
    vault = materialize(vault)
    args = demask.demap(calls.select(*keys, F.col("args").alias("text")), keys, policy, vault)
    args = computed(args, sensitive=sensitive(F.col("text"), policy))
    args = args.withColumnRenamed("text", "args")
    flagged = materialize(calls.drop("args").join(args, keys))
    inner = [*keys, "__item"]
    items = flagged.select(*keys, F.explode(content_texts(F.col("content"), kind)).alias("__c"), F.col("sensitive").alias("blob"))
    items = items.select(*keys, F.col("__c.item").alias("__item"), F.col("__c.text").alias("text"), "blob")
    items._rows_of = flagged
    done = mask(items, inner, policy, key, vault, **options)
    changed = done.documents.where("masked_count > 0")
    edits = materialize(
        changed.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(F.col("__item").alias("item"), "text"))).alias("__items"),
            F.array_distinct(F.flatten(F.collect_list("entity_types"))).alias("entity_types"),
            F.sum("masked_count").cast("int").alias("masked_count"),
        )
    )
    side, _ = checked_broadcast(edits)
    joined = flagged.join(side, keys, "left")
    content = F.when(F.col("__items").isNotNull(), with_texts(F.col("content"), kind, F.col("__items"))).otherwise(F.col("content"))
    out = joined.withColumn("masked_count", F.coalesce("masked_count", F.lit(0)))
    out = out.withColumns(
        {
            "content": content,
            "entity_types": F.coalesce("entity_types", F.lit([]).cast("array<string>")),
        }
    ).drop("__items")
    added, vault = done.added, done.vault
    if "structured" in calls.columns:
        out = out.withColumn("structured", F.when(~F.col("sensitive"), F.col("structured")))
        texts = out.withColumnsRenamed({"entity_types": "__types", "masked_count": "__count"})
        both = mask_columns(texts, keys, ["structured"], policy, key, vault, **options)
        out = both.documents.withColumns(
            {
                "entity_types": F.array_distinct(F.concat("__types", "entity_types")),
                "masked_count": F.col("__count") + F.col("masked_count"),
            }
        ).drop("__types", "__count")
        added, vault = added.unionByName(both.added), both.vault
    out = out.withColumn("content", tx.content_with_notice(F.col("content"), kind, F.col("masked_count"), policy))
    return Masked(out, done.findings, vault, added), audit.events_of(out, keys)
