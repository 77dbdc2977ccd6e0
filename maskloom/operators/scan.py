"""Find every occurrence of a table of patterns in a table of texts, without pairs.

The naive plan compares each text with each pattern. Here each text is read once:

1. every candidate position yields the next ``W`` characters (one regex pass);
2. a *gate* (first four characters -> the pattern lengths that start so) drops almost
   all positions and says which lengths to cut. It has one row per prefix, so it is
   small however large the vault is; its size is measured before it is broadcast;
3. each cut piece is equi-joined with the patterns on the whole text of the piece.

No pattern ever meets a text it does not occur in, so a prefix shared by millions of
patterns costs nothing. Patterns longer than ``W`` go through the same scan with their
first ``W`` characters and are then compared in full.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.runtime import checked_broadcast, materialize, spread_join

WINDOW = 96
GATE = 4
CHUNK = 16_384
#: Characters up to which a candidate is taken with all that follows it, whose length tells its place.
BRIEF = 256
ALNUM = r"\p{L}\p{N}"


def _fold(text: Column, fold: bool) -> Column:
    return F.lower(text) if fold else text


def _first_characters(patterns: DataFrame, fold: bool) -> str:
    """Regex class of the characters patterns start with ('' when there are too many)."""
    head = F.left(F.col("pattern"), F.lit(1))
    firsts = patterns.select(head.alias("c")).distinct()
    rows = [r[0] for r in firsts.limit(257).collect()]
    if len(rows) > 256 or not rows:
        return ""
    chars = {v for c in rows for v in ((c, c.lower(), c.upper()) if fold else (c,)) if len(v) == 1}
    if fold:  # listed, as a class that ignores case is slow
        chars |= {v for c in rows for v in _folded().get(c.lower()[0], ())}
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted(chars)) + "]"


@cache
def _folded() -> dict[str, list[str]]:
    """The other characters whose lower case starts with a character."""
    out: dict[str, list[str]] = {}
    for number in (*range(0xD800), *range(0xE000, 0x110000)):
        low = chr(number).lower()
        if low != chr(number):
            out.setdefault(low[0], []).append(chr(number))
    return out


def _chunks(text: Column, reach: int) -> Column:
    """Overlapping slices of long texts, so one huge text is never one huge array.

    ``array<struct<left,body,after>>``: the character before, the slice, what follows it.
    """
    bodies = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    afters = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}(?=(.{{0,{reach}}}))"), F.lit(1))
    cut = F.transform(
        bodies,
        lambda b, i: F.struct(
            F.when(i > 0, F.right(F.try_element_at(bodies, i), F.lit(1))).otherwise(F.lit("")).alias("left"),
            b.alias("body"),
            F.element_at(afters, i + 1).alias("after"),
        ),
    )
    whole = F.array(F.struct(F.lit("").alias("left"), text.alias("body"), F.lit("").alias("after")))
    return F.when(F.length(text) > CHUNK, cut).otherwise(whole)


def _windows(units: DataFrame, keep: list[str], gates: DataFrame, first: str, min_len: int, reach: int, words: bool, fold: bool) -> DataFrame:
    """Candidate positions that pass the gate: ``keep`` columns, start, window, lengths."""
    behind = rf"(?<![{ALNUM}])" if words else ""
    body = rf"{first or '.'}.{{{min_len - 1},{reach - 1}}}"
    regex = rf"(?s)(?:{behind}(?=({body})))?."
    rest = rf"(?s){behind}(?=({first or '.'}.{{{min_len - 1},}}))."
    sliced = units.select(
        *keep, (F.length("text") <= min(BRIEF, CHUNK)).alias("__brief"), F.posexplode(_chunks(F.col("text"), reach)).alias("__chunk", "__slice")
    ).select(*keep, "__brief", "__chunk", "__slice.*")
    lead, brief = F.length("left"), F.col("__brief")
    found = F.when(brief, F.regexp_extract_all(F.col("body"), F.lit(rest), F.lit(1))).otherwise(
        F.regexp_extract_all(F.concat("left", "body", "after"), F.lit(regex), F.lit(1))
    )
    positions = sliced.select(
        *keep,
        "__brief",
        (F.col("__chunk") * CHUNK - lead).alias("__base"),
        lead.alias("__lead"),
        F.length("body").alias("__size"),
        F.posexplode(found).alias("__pos", "__window"),
    ).where(brief | ((F.col("__window") != "") & (F.col("__pos") >= F.col("__lead")) & (F.col("__pos") < F.col("__lead") + F.col("__size"))))
    start = F.when(brief, F.col("__size") - F.length("__window")).otherwise(F.col("__base") + F.col("__pos"))
    positions = positions.withColumns({"start": start, "__window": F.when(brief, F.left(F.col("__window"), F.lit(reach))).otherwise(F.col("__window"))}).withColumn(
        "__gate", _fold(F.left(F.col("__window"), F.lit(min(GATE, min_len))), fold)
    )
    side, _ = checked_broadcast(gates)
    return positions.join(side, "__gate").select(*keep, "start", "__window", "__lens")


def _cut(windows: DataFrame, keep: list[str], words: bool, fold: bool) -> DataFrame:
    cut = windows.select(*keep, "start", "__window", F.explode("__lens").alias("__len")).where(
        F.length("__window") >= F.col("__len")
    )
    if words:
        after = F.substring("__window", F.col("__len") + 1, F.lit(1))
        cut = cut.where(~after.rlike(rf"[{ALNUM}]"))
    value = F.left(F.col("__window"), F.col("__len"))
    return cut.select(*keep, "start", (F.col("start") + F.col("__len")).alias("end"), value.alias("value")).withColumn(
        "__cut", _fold(F.col("value"), fold)
    )


def scan(units: DataFrame, keep: list[str], patterns: DataFrame, *, words: bool, fold: bool) -> DataFrame:
    """All occurrences of ``patterns.pattern`` in ``units.text``.

    ``keep``: unit columns to carry. ``words``: neighbours must not be letters or digits.
    ``fold``: ignore letter case. Returns ``keep``, start, end, value and the other
    columns of ``patterns`` (one row per folded pattern is expected there).
    """
    patterns = materialize(patterns.where(F.length("pattern") > 0).withColumn("__n", F.length("pattern")))
    shortest, longest = patterns.agg(F.min("__n"), F.max("__n")).first()
    payload = [c for c in patterns.columns if c not in ("pattern", "__n")]
    if shortest is None:
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patterns.schema if f.name in payload)
        none = units.sparkSession.createDataFrame([], types) if payload else None
        empty = units.where(F.lit(False)).select(
            *keep, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value")
        )
        for field in patterns.schema:
            if none is not None and field.name in payload:
                empty = empty.withColumn(field.name, F.lit(None).cast(field.dataType))
        return empty
    parts = []
    # texts shorter than the gate need their own narrower gate
    bands = [(n, n) for n in range(shortest, min(longest, GATE - 1) + 1)]
    if longest >= GATE:
        bands.append((max(shortest, GATE), WINDOW))
    first = _first_characters(patterns, fold)
    for low, high in bands:
        part = patterns.where(F.col("__n").between(low, high))
        gates = (
            part.withColumn("__gate", _fold(F.left(F.col("pattern"), F.lit(min(GATE, low))), fold))
            .groupBy("__gate")
            .agg(F.sort_array(F.collect_set("__n")).alias("__lens"))
        )
        reach = min(longest, high) + 1
        found = _cut(_windows(units, keep, gates, first, low, reach, words, fold), keep, words, fold)
        right = part.withColumn("__cut", _fold(F.col("pattern"), fold)).select("__cut", *payload)
        parts.append(spread_join(found, right, ["__cut"], "inner", F.col("start")).drop("__cut"))
    if longest > WINDOW:
        parts.append(_scan_long(units, keep, patterns.where(F.col("__n") > WINDOW), payload, first, words, fold))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


def _scan_long(units, keep, patterns, payload, first, words, fold) -> DataFrame:
    """Patterns longer than the window: their heads gate, then the whole text is compared."""
    heads = (
        patterns.withColumn("__head", _fold(F.left(F.col("pattern"), F.lit(WINDOW)), fold))
        .groupBy("__head")
        .agg(F.sort_array(F.collect_set("__n")).alias("__lens"))
    )
    gates = heads.select(F.left(F.col("__head"), F.lit(GATE)).alias("__gate")).distinct().withColumn(
        "__lens", F.array(F.lit(WINDOW))
    )
    spots = _windows(units, [*keep, "text"], gates, first, WINDOW, WINDOW, words, fold)
    spots = spots.withColumn("__head", _fold(F.left(F.col("__window"), F.lit(WINDOW)), fold)).drop("__lens")
    side, _ = checked_broadcast(heads)
    cut = spots.join(side, "__head").withColumn("__len", F.explode("__lens"))
    value = F.substring("text", F.col("start") + 1, F.col("__len"))
    cut = cut.withColumn("value", value).where(F.length("value") == F.col("__len"))
    if words:
        after = F.substring("text", F.col("start") + F.col("__len") + 1, F.lit(1))
        cut = cut.where(~after.rlike(rf"[{ALNUM}]"))
    found = cut.select(
        *keep, "start", (F.col("start") + F.col("__len")).alias("end"), "value", _fold(F.col("value"), fold).alias("__cut")
    )
    right = patterns.withColumn("__cut", _fold(F.col("pattern"), fold)).select("__cut", *payload)
    return spread_join(found, right, ["__cut"], "inner", F.col("start")).drop("__cut")


def known_patterns(vault: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Vault real values as scan patterns: four characters or more, one per letter case fold."""
    rows = vault.where(F.length("real_value") >= 4)
    if allowed is not None:
        rows = rows.where(~allowed)
    return (
        rows.groupBy(F.lower("real_value").alias("k"))
        .agg(F.min_by(F.struct("real_value", "surrogate", "entity_type"), F.struct("seq", "entity_type")).alias("w"))
        .select(
            F.col("w.real_value").alias("pattern"),
            F.col("w.surrogate").alias("surrogate"),
            F.col("w.entity_type").alias("entity_type"),
        )
    )


def surrogate_patterns(vault: DataFrame, fold: bool, floor: int = 1) -> DataFrame:
    """Surrogates as scan patterns for reversal; on a fold clash the last writer is used."""
    from maskloom.operators.vault import reverse

    rev = reverse(vault).where(F.length("surrogate") >= floor)
    ages = rev.groupBy("entity_type").agg(F.min("seq").alias("age"))
    rev = rev.join(F.broadcast(ages), "entity_type")
    return (
        rev.groupBy((F.lower("surrogate") if fold else F.col("surrogate")).alias("k"))
        .agg(
            F.min_by(
                F.struct("surrogate", "real_value", "entity_type"), F.struct(F.col("age"), -F.col("seq"))
            ).alias("w")
        )
        .select(
            F.col("w.surrogate").alias("pattern"),
            F.col("w.real_value").alias("real_value"),
            F.col("w.entity_type").alias("entity_type"),
        )
    )
