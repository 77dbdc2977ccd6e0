"""Documents -> units (pieces of text worth looking at) -> findings.

A unit is a whole plain text, one string value of a JSON document, or the text between
two tags of HTML. ``at`` says where the unit lies in its document, so each finding ends
up with offsets in the original text (``doc_start``, ``doc_end``) and the quoting its
replacement needs there (``quote``: 1 JSON, 2 HTML, 3 both).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.functions import filters, markup, recognizers, text as tx
from maskloom.functions.splice import keep_greedy
from maskloom.operators.scan import known_patterns, scan
from maskloom.operators.vault import all_surrogates
from maskloom.policy import Policy, glob_regex
from maskloom.runtime import computed, spread_join

AT = f"struct<leaf:int,leaf_moved:{markup.SHIFT},piece:int,piece_moved:{markup.SHIFT}>"
FINDING_COLUMNS = [
    "unit", "path", "start", "end", "entity_type", "value", "score", "phase", "surrogate",
    "doc_start", "doc_end", "quote",
]


def any_path(path: Column, patterns) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | path.rlike(glob_regex(pattern))
    return hit


def field_entity(path: Column, policy: Policy) -> Column:
    """Entity of the first field rule whose glob matches the path, else null."""
    if not policy.field_rules:
        return F.lit(None).cast("string")
    return F.coalesce(
        *[F.when(path.rlike(glob_regex(r.pattern)), F.lit(r.entity)) for r in policy.field_rules]
    )


def excluded_path(path: Column, policy: Policy) -> Column:
    """The path, or any path above it, matches a never-mask glob."""
    if not policy.never_mask_paths:
        return F.lit(False)
    steps = F.split(path, r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ".")
    )
    return F.exists(above, lambda p: any_path(p, policy.never_mask_paths))


def leaves(docs: DataFrame, keys: list[str], kind: str = "document", ruled: bool = False) -> DataFrame:
    """``docs(keys, text[, path])`` -> one row per JSON string value, or the whole text.

    ``kind='value'``: the text is itself one value of a record and is not parsed.
    ``ruled``: only texts with leaves that have a path, as field rules need one.
    """
    base = F.col("path") if "path" in docs.columns else F.lit("")
    key = F.regexp_extract(base, r"[^.]*\z", 0)
    whole = F.array(
        F.struct(
            base.alias("path"), key.alias("key"), F.lit(0).alias("obj"), F.lit(0).alias("start"), F.col("text").alias("raw")
        )
    ).cast(markup.LEAF)
    rows = docs.where(~tx.blank(F.col("text")))
    plain = markup.decoded_leaves(whole, False)
    pathless = ruled and "path" not in docs.columns
    if kind == "value":
        rows = rows.withColumn("json", F.lit(False)).where(F.lit(not pathless))
        cut = plain
    else:
        text = F.col("text")
        rows = computed(rows, json=filters.is_json(text))
        rows = rows.where("json") if pathless else rows
        rows = rows.withColumn("__leaves", markup.json_leaves(F.when(F.col("json"), text)))
        cut = F.when(F.col("json"), markup.decoded_json(text, F.col("__leaves"))).otherwise(plain)
    # computed first: the filters that come with an explode would each repeat the walk
    rows = computed(rows.select(*keys, "json", *[c for c in ("path", "text", "__leaves") if c in rows.columns and c not in keys]), __cut=cut)
    rows = rows.select(*keys, "json", F.posexplode("__cut").alias("leaf_no", "leaf"))
    return rows.select(*keys, "json", "leaf_no", "leaf.*").where(~tx.blank(F.col("text")))


def pieces(leaf_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cut HTML leaves at their tags; other leaves are one piece. Returns units."""
    text = F.col("text")
    rows = computed(leaf_rows, html=tx.looks_like_html(text))
    cut = F.when(F.col("html"), markup.decoded_pieces(text, True)).otherwise(markup.decoded_pieces(text, False))
    rows = computed(rows, __cut=cut).select(
        *keys, "json", "html", "leaf_no", "path", "leaf_start", "leaf_moved",
        F.posexplode("__cut").alias("piece_no", "piece"),
    )
    at = F.struct(
        F.col("leaf_start").alias("leaf"),
        "leaf_moved",
        F.col("piece.start").alias("piece"),
        F.col("piece.moved").alias("piece_moved"),
    ).cast(AT)
    return rows.select(
        *keys,
        F.struct("leaf_no", "piece_no").alias("unit"),
        "path",
        "piece.text",
        at.alias("at"),
        (F.col("json").cast("int") + F.col("html").cast("int") * 2).alias("quote"),
    )


def as_units(leaf_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves as units without looking for HTML in them."""
    none = F.lit([]).cast(markup.SHIFT)
    at = F.struct(F.col("leaf_start").alias("leaf"), "leaf_moved", F.lit(0).alias("piece"), none.alias("piece_moved"))
    return leaf_rows.select(
        *keys,
        F.struct("leaf_no", F.lit(0).alias("piece_no")).alias("unit"),
        "path",
        "text",
        at.cast(AT).alias("at"),
        F.col("json").cast("int").alias("quote"),
    )


def placed(findings: DataFrame) -> DataFrame:
    """Turn unit offsets into document offsets."""
    at = F.col("at")

    def place(offset: Column, at_end: bool) -> Column:
        # an end is the place after its last character: step back over a trailing escape
        probe = offset - 1 if at_end else offset
        piece = at["piece"] + markup.source_offset(probe, at["piece_moved"])
        if at_end:
            piece = piece + 1 + _extra_at(probe, at["piece_moved"])
            last = piece - 1
            return at["leaf"] + markup.source_offset(last, at["leaf_moved"]) + 1 + _extra_at(last, at["leaf_moved"])
        return at["leaf"] + markup.source_offset(piece, at["leaf_moved"])

    return findings.withColumns(
        {"doc_start": place(F.col("start"), False), "doc_end": place(F.col("end"), True)}
    ).drop("at")


def _extra_at(offset: Column, moved: Column) -> Column:
    here = F.filter(moved, lambda s: s["at"] == offset)
    return F.aggregate(here, F.lit(0), lambda acc, s: acc + s["extra"])


# ── Findings ─────────────────────────────────────────────────────────────


def recognized(units: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """Regex findings that survive the protected spans and the quality filters, and the
    partial masks, in one pass over the text.

    Protected spans are only computed for texts that have a finding. Partial masks are
    not filtered: they are settled against the vault.
    """
    text = F.col("text")
    found = computed(
        units.select(*keys, "unit", "path", "at", "quote", "text"),
        f=recognizers.pattern_findings(text, policy),
        p=recognizers.partial_findings(text),
    ).where((F.size("f") > 0) | (F.size("p") > 0))
    found = computed(
        found,
        protected=F.when(F.size("f") > 0, filters.protected_spans(text)).otherwise(F.lit([]).cast(filters.PROTECTED)),
    )
    kept = F.filter(
        F.col("f"), lambda f: filters.unprotected(f["entity_type"], f["start"], f["end"], F.col("protected"))
    )
    rows = found.select(*keys, "unit", "path", "at", "quote", F.explode(F.concat(kept, "p")).alias("f")).select(
        *keys, "unit", "path", "at", "quote", "f.*"
    )
    rows = rows.where((F.col("phase") == "partial") | filters.quality(policy))
    return placed(rows.withColumn("surrogate", F.lit(None).cast("string")))


def with_protection(units: DataFrame, kinds) -> DataFrame:
    return computed(units, protected=filters.protected_spans(F.col("text"), kinds))


def dictionary(units: DataFrame, keys: list[str], policy: Policy, gazetteer: DataFrame) -> DataFrame:
    """Gazetteer findings: ``gazetteer(term, entity_type, score)``, case-sensitive, whole words."""
    terms = (
        gazetteer.where(filters.above_floor(F.col("entity_type"), F.col("score")))
        .groupBy(F.col("term").alias("pattern"))
        .agg(F.max_by(F.struct("entity_type", "score"), F.struct("score", "entity_type")).alias("w"))
        .select("pattern", "w.entity_type", "w.score")
    )
    guarded = with_protection(units, tuple(filters._KINDS))
    hits = scan(guarded, [*keys, "unit", "path", "at", "quote", "protected"], terms, words=True, fold=False)
    hits = hits.where(filters.unprotected(F.col("entity_type"), F.col("start"), F.col("end"), F.col("protected")))
    hits = hits.where(filters.quality(policy)).drop("protected")
    return placed(hits.withColumns({"phase": F.lit("recognizer"), "surrogate": F.lit(None).cast("string")}))


def known(units: DataFrame, keys: list[str], policy: Policy, vault: DataFrame) -> DataFrame:
    """Occurrences of vault values: any letter case, whole words, also inside URLs, never inside ids."""
    patterns = known_patterns(vault, filters.allowed_vault_value(F.col("real_value"), policy))
    guarded = with_protection(units, filters.ID_KINDS)
    hits = scan(guarded, [*keys, "unit", "path", "at", "quote", "protected"], patterns, words=True, fold=True)
    # a secret that looks like an id is still a secret
    hits = hits.where(filters.unprotected(F.col("entity_type"), F.col("start"), F.col("end"), F.col("protected")))
    return placed(hits.drop("protected").withColumns({"phase": F.lit("known"), "score": F.lit(1.0)}))


def without_known_surrogates(findings: DataFrame, vault: DataFrame) -> DataFrame:
    """Drop findings whose text is a surrogate already (as it is, or lower-cased)."""
    used = all_surrogates(vault)
    used = used.union(used.select(F.lower("surrogate"))).distinct().select(F.col("surrogate").alias("value"))
    return spread_join(findings, used, ["value"], "left_anti")


# ── Conflicts ────────────────────────────────────────────────────────────

PHASE_ORDER = "CASE phase WHEN 'blob' THEN 0 WHEN 'field_rule' THEN 1 ELSE 2 END"


def resolve(findings: DataFrame, keys: list[str], prefer: str = "score") -> DataFrame:
    """Keep non-overlapping findings of each text.

    Order: whole-value phases, then score, length, start (``prefer='length'``: length
    before score, so that the larger of two nested spans is replaced and nothing of it
    stays readable). A running maximum of the ends cuts each text into clusters of
    overlapping spans; the greedy walk only runs inside clusters of two or more.
    """
    start, end = ("doc_start", "doc_end") if "doc_start" in findings.columns else ("start", "end")
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = findings.withColumn(
        "__new", (F.col(start) >= F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int")
    ).withColumn("__cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    score = -F.col("score") if "score" in findings.columns else F.lit(0.0)
    length = F.col(start) - F.col(end)
    first, second = (length, score) if prefer == "length" else (score, length)
    phase = F.expr(PHASE_ORDER) if "phase" in findings.columns else F.lit(0)
    payload = [c for c in findings.columns if c not in keys]
    item = F.struct(
        phase.alias("r0"), first.alias("r1"), second.alias("r2"), F.col(start).alias("start"), F.col(end).alias("end"),
        F.col("entity_type").alias("r3") if "entity_type" in findings.columns else F.lit("").alias("r3"),
        F.struct(*payload).alias("row"),
    )
    rows = marked.select(*keys, "__cluster", item.alias("s"))
    kind = "array<" + rows.schema["s"].dataType.simpleString() + ">"
    grouped = rows.groupBy(*keys, "__cluster").agg(F.sort_array(F.collect_list("s")).alias("a"))
    kept = F.when(F.size("a") == 1, F.col("a")).otherwise(keep_greedy(F.col("a"), kind))
    return grouped.select(*keys, F.explode(kept).alias("s")).select(*keys, "s.row.*")
