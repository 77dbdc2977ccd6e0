"""Surrogates for values the vault does not have yet.

New values are made distinct first, so a value in a third of all rows is one row here.
A fake value whose hash names what another value owns is dealt words that nobody uses, in one
step; steps are checkpointed, so a lost executor never replays the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from maskloom.functions.fpe import fpe, spread_digits
from maskloom.functions.surrogates import (
    SYLLABLE, SYLLABLES, discriminator, hmac_hex, mac_message, syllable_word, with_fake, with_words,
)
from maskloom.functions.text import words
from maskloom.operators import vault as v
from maskloom.policy import FAKE, FPE, REPLACE
from maskloom.runtime import computed, global_rank, materialize, rebalanced

CIPHER_STEPS = 8  # values unsettled then are dealt the free numbers of their format
LOW_DIGITS = 15  # digits that vary among the numbers dealt
BLOCK = 4096
MIN_SYLLABLES, MAX_SYLLABLES = 3, 8
ROOM = 16  # numbers a word for each that is needed
ROW = ["entity_type", "real_value", "surrogate", "ord"]
KEY = ["entity_type", "real_value"]


def _taken(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> DataFrame:
    """Rows whose candidate belongs to another value already, or equals a real value that
    somebody may want masked."""
    held = v.claims(rows, "surrogate").join(owned.withColumnRenamed("owner", "holder"), "token").where("owner <> holder")
    real = rows.withColumn("token", F.lower("surrogate")).join(reals, "token", "left_semi")
    return held.select(KEY).union(real.select(KEY))


def _clashing(rows: DataFrame) -> DataFrame:
    """Rows that want a word form an earlier one of them wants too."""
    claims = v.claims(rows, "surrogate", ("ord",))
    first = claims.groupBy("token").agg(F.min_by("owner", "ord").alias("winner"))
    return claims.join(first, "token").where("owner <> winner").select(KEY)


def _settle(tried: DataFrame, owned: DataFrame, reals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows nobody contests, and the rest."""
    lost = _taken(tried, owned, reals).union(_clashing(tried)).distinct().withColumn("lost", F.lit(True))
    state = materialize(tried.join(lost, KEY, "left"))
    return state.where("lost is null").select(*ROW), state.where("lost").drop("lost")


def _with_claims(owned: DataFrame, rows: DataFrame) -> DataFrame:
    return owned.union(v.claims(rows, "surrogate").select("token", "owner"))


def _named(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> list[DataFrame]:
    """Fake surrogates: the one the hash of the value names, or else a dealt one.

    Where the hash of a value names what another value owns, the value is dealt two words that
    nobody uses, so no further rounds are needed however full the word lists are. A hash suffix
    comes only where the kind of surrogate holds no word and its hash is taken.
    """
    won, pending = _settle(materialize(with_fake(rebalanced(rows), "surrogate")), owned, reals)
    done = [won]
    if pending.isEmpty():
        return done
    owned = _with_claims(owned, won)
    won, pending = _settle(_dealt_names(pending.drop("surrogate"), owned, reals), owned, reals)
    done.append(won)
    for size in (6, 16, 64):
        if pending.isEmpty():
            return done
        owned = _with_claims(owned, done[-1])
        suffixed = F.concat("surrogate", F.lit(" ("), discriminator(size), F.lit(")"))
        won, pending = _settle(materialize(with_fake(pending, "surrogate").withColumn("surrogate", suffixed)), owned, reals)
        done.append(won)
    if not pending.isEmpty():
        raise RuntimeError("values left without a surrogate")
    return done


def _dealt_names(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> DataFrame:
    """``rows`` with surrogates of two words each that no surrogate and no real value holds.

    Words are numbers written in syllables, so two numbers never give one word. The number of
    syllables grows with the vault; a keyed linear map strews the numbers over all words of that
    many. With u of them in use and n rows waiting, 2 n + u numbers hold enough free ones.
    """
    rows = materialize(rows)
    n = rows.count()
    texts = owned.select("token").union(reals.select("token"))
    found = F.regexp_extract_all("token", F.lit(f"(?<![a-z])({SYLLABLE}{{{MIN_SYLLABLES},{MAX_SYLLABLES}}})(?![a-z])"), F.lit(1))
    held = materialize(texts.select(F.explode(found).alias("word")).distinct())
    in_use = {r[0]: r[1] for r in held.groupBy(F.length("word")).count().collect()}  # one row per length
    roomy = (s for s in range(MIN_SYLLABLES, MAX_SYLLABLES) if SYLLABLES**s >= ROOM * (2 * n + in_use.get(2 * s, 0)))
    syllables = next(roomy, MAX_SYLLABLES)
    size, needed = SYLLABLES**syllables, 2 * n + in_use.get(2 * syllables, 0)
    # SYLLABLES * k + 3 has no factor in common with the number of words, so no word comes twice
    mac = hmac_hex(F.lit(f"WORDS:{syllables}"))
    part = [F.conv(F.substring("mac", i, 12), 16, 10).cast("decimal(19,0)") for i in (1, 13)]
    map_of = rows.agg(F.min_by(F.struct("inner_pad", "outer_pad"), F.struct(*KEY)).alias("pads")).select("pads.*").select(mac.alias("mac"))
    map_of = map_of.select(F.lit(0).alias("all"), ((part[0] * SYLLABLES + 3) % size).cast("decimal(19,0)").alias("times"), part[1].alias("plus"))
    number = (F.col("id").cast("decimal(19,0)") * F.col("times") + F.col("plus")) % F.lit(size).cast("decimal(19,0)")
    made = rows.sparkSession.range(needed).withColumn("all", F.lit(0)).join(F.broadcast(map_of), "all")  # one row
    made = computed(made, number=number.cast("long")).select("id", syllable_word(F.col("number"), syllables).alias("word"))
    free = global_rank(made.join(held, "word", "left_anti"), [F.col("id")], "place")
    second = F.col("place") % 2 == 1
    pairs = free.groupBy(F.floor(F.col("place") / 2).alias("place")).agg(
        F.max(F.when(~second, F.initcap("word"))).alias("first"), F.max(F.when(second, F.initcap("word"))).alias("last")
    )
    waiting = rows.withColumn("mac", hmac_hex(mac_message(F.col("entity_type"), F.col("real_value"))))
    waiting = global_rank(waiting, [F.col(c) for c in ("mac", *KEY)], "place").drop("mac")
    got = with_words(waiting.join(pairs, "place"), "surrogate", "first", "last")
    return materialize(got.drop("place", "first", "last"))


def assign(values: DataFrame, vault: DataFrame, rules: DataFrame) -> DataFrame:
    """New vault rows for ``values(entity_type, real_value, ord)``.

    ``rules``: the policy table. ``ord``: any sortable column, the order of first
    appearance; ties on it are broken by type and value, so the result does not depend
    on partitioning. Values the vault can already answer, and entities that are merely
    replaced, give no row. Letter-case variants share the surrogate of the first one.
    """
    spark = values.sparkSession
    rules = F.broadcast(rules.where(F.col("operator") != REPLACE))
    fresh = values.groupBy("entity_type", "real_value").agg(F.min("ord").alias("ord"))
    fresh = fresh.withColumn("ord", F.struct("ord", "entity_type", "real_value"))
    fresh = v.find_both(fresh, vault).join(rules, "entity_type")
    fresh = fresh.where(F.col("same").isNull() & ((F.col("operator") == FPE) | F.col("anywhere").isNull()))
    # one row per value: same type and letter-case fold for FPE, any type for fakes; the
    # groups are the spellings of one value, so both windows are tiny and share a shuffle
    fold = Window.partitionBy(F.lower("real_value"))
    typed = Window.partitionBy(F.lower("real_value"), "entity_type")
    fresh = fresh.withColumns({"__any": F.min("ord").over(fold), "__typed": F.min("ord").over(typed)})
    fresh = fresh.where(
        (F.col("ord") == F.col("__typed")) & ((F.col("operator") == FPE) | (F.col("ord") == F.col("__any")))
    ).drop("same", "anywhere", "__any", "__typed")
    fresh = materialize(rebalanced(fresh))
    kinds = {(r[0], r[1]) for r in fresh.select("operator", _is_single(fresh)).distinct().collect()}
    if not kinds:
        return v.empty_vault(spark)
    owned = materialize(v.reverse(vault).select(F.col("surrogate_lower").alias("token"), F.col("real_value").alias("owner")))
    reals = materialize(vault.select(F.lower("real_value").alias("token")).union(fresh.select(F.lower("real_value"))).distinct())
    rows: list[DataFrame] = []

    if any(op == FPE for op, _ in kinds):
        rows += _encrypt(fresh.where(F.col("operator") == FPE), owned, reals)
        owned = owned.union(_union(rows).select(F.lower("surrogate"), "real_value"))
    fakes = fresh.where(F.col("operator") == FAKE)
    single = _is_single(fresh)
    if (FAKE, False) in kinds:
        won = _named(fakes.where(~single), owned, reals)
        rows += won
        owned = _with_claims(owned, _union(won))
    if not rows:
        ranked = None
    else:
        ranked = _ranked(_union(rows), vault)
    derived = v.subtokens(ranked, vault) if ranked is not None else None
    if (FAKE, True) in kinds:
        # single words: the aligned word of a full name, if there is one now
        alone = fakes.where(single)
        if derived is not None:
            derived = materialize(derived)
            alone = v.find_surrogate(alone, derived, "__got").where("__got is null").drop("__got")
        if not alone.isEmpty():
            more = _ranked(_union(_named(alone, owned, reals)), vault if ranked is None else vault.unionByName(ranked))
            ranked = more if ranked is None else ranked.unionByName(more)
    out = ranked if derived is None else ranked.unionByName(derived)
    return materialize(out.select("entity_type", "real_value", "surrogate", "seq", "derived"))


def _is_single(df: DataFrame):
    return (df["entity_type"].isin(*v.SUBTOKEN_TYPES) & (F.size(words(df["real_value"])) < 2)).alias("single")


def _encrypt(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> list[DataFrame]:
    """FPE surrogates. One that is a real value, or taken, is encrypted again, so the format stays.

    Values that ``CIPHER_STEPS`` steps leave unsettled, or whose walk is a ring of numbers in
    use, are dealt the free numbers of their format. Only where a format has fewer free numbers
    than values, the values left over get a hash suffix. Values the cipher cannot take get no
    row, and masking falls back to the type name.
    """
    done: list[DataFrame] = []
    made = materialize(fpe(rows, "real_value", "surrogate"))  # filtered after, so that the cipher runs once a row
    first = pending = made.where("surrogate is not null")

    def settle(tried: DataFrame) -> DataFrame:
        """Keep the rows nobody contests; the rest is returned."""
        nonlocal owned
        won, lost = _settle(tried, owned, reals)
        done.append(won)
        owned = _with_claims(owned, won)
        return lost

    stuck = None  # values of formats all of whose numbers are in use: no step can settle them
    for step in range(CIPHER_STEPS):
        pending = settle(pending)
        if pending.isEmpty():
            break
        if step == 0:
            full = _full_formats(pending, owned, reals)
            if not full.isEmpty():
                marked = pending.withColumn("format", _format(F.col("real_value")))
                stuck = marked.join(full, "format", "left_semi").select(KEY)
                pending = marked.join(full, "format", "left_anti").drop("format")
        again = rebalanced(pending.withColumnRenamed("surrogate", "before"))
        pending = materialize(fpe(again, "before", "surrogate").drop("before"))
    if not pending.isEmpty():
        free = _dealt(pending.drop("surrogate"), owned, reals)
        left = pending.join(free.select(KEY), KEY, "left_anti").select(KEY)
        pending = settle(free).select(KEY).union(left)
    pending = pending.select(KEY)
    if stuck is not None:
        pending = pending.union(stuck)
    if pending.isEmpty():
        return done
    for size in (16, 64):
        tried = first.join(pending.select(KEY), KEY, "left_semi")
        pending = settle(materialize(tried.withColumn("surrogate", F.concat("surrogate", F.lit(" ("), discriminator(size), F.lit(")")))))
        if pending.isEmpty():
            return done
    raise RuntimeError("values left without a surrogate")


def _format(text):
    """Values of one format compete for its numbers, whatever their type and letter case."""
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _full_formats(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> DataFrame:
    """Formats of ``rows`` without a free number."""
    formats = rows.select(_format(F.col("real_value")).alias("format")).distinct()
    used = owned.select("token").union(reals.select("token")).withColumn("format", _format(F.col("token")))
    used = used.join(formats, "format", "left_semi").distinct().groupBy("format").agg(F.count(F.lit(1)).alias("u"))
    digits = F.length(F.regexp_replace("format", "[^0]", ""))
    return materialize(used.where(F.col("u") >= F.pow(F.lit(10.0), digits)).select("format"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``, the 0-based rank within a format, without a task that holds a format."""
    ranked = materialize(global_rank(rows, [F.col(c) for c in ("format", *order)], "rank"))
    first = ranked.groupBy("format").agg(F.min("rank").alias("first"))
    return ranked.join(first, "format").withColumn("place", F.col("rank") - F.col("first")).drop("rank", "first")


def _dealt(rows: DataFrame, owned: DataFrame, reals: DataFrame) -> DataFrame:
    """``rows`` with a free number of their format as surrogate, as far as there are any.

    With u numbers of a format in use and n values waiting, u + n distinct numbers (or all the
    format has) hold a free one for each value, so no more are made. A keyed linear map strews
    them over the format; digits beyond ``LOW_DIGITS`` come from the same MAC.
    """
    rows = materialize(rows.withColumn("format", _format(F.col("real_value"))))
    wanted = rows.groupBy("format").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("inner_pad", "outer_pad"), F.struct(*KEY)).alias("pads"),
    )
    wanted = materialize(wanted.select("format", "n", "pads.*"))
    used = owned.select("token").union(reals.select("token")).withColumn("format", _format(F.col("token")))
    used = materialize(used.join(wanted.select("format"), "format", "left_semi").distinct())
    wanted = wanted.join(used.groupBy("format").agg(F.count(F.lit(1)).alias("u")), "format", "left")
    digits = F.length(F.regexp_replace("format", "[^0]", ""))
    low = F.least(digits, F.lit(LOW_DIGITS))
    wanted = wanted.select("format", digits.alias("digits"), low.alias("low"), F.rpad(F.lit("1"), low + 1, F.lit("0")).cast("long").alias("numbers"),
                           (F.col("n") + F.coalesce("u", F.lit(0))).alias("needed"),
                           hmac_hex(F.concat(F.lit("FORMAT:"), F.col("format"))).alias("mac"))
    # 10 k + 1, 3, 7 or 9 has no factor in common with the numbers of a format, so none comes twice.
    part = [F.conv(F.substring("mac", i, 12), 16, 10).cast("long") for i in (1, 13)]
    high = F.translate(F.substring(F.concat("mac", F.reverse("mac")), 1, F.col("digits") - F.col("low")), "abcdef", "031479")
    wanted = materialize(wanted.withColumns({"times": part[0] * 10 + 7, "plus": part[1], "high": high, "needed": F.least("needed", "numbers")}))
    blocks = wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("needed") - 1) / BLOCK))))
    start = F.col("block") * BLOCK
    made = rebalanced(blocks).withColumn("at", F.explode(F.sequence(start, F.least(start + BLOCK, F.col("needed")) - 1)))
    wide = "decimal(19,0)"
    number = (F.col("at").cast(wide) * F.col("times").cast(wide) + F.col("plus")) % F.col("numbers").cast(wide)
    made = made.select("format", "at", F.concat("high", F.lpad(number.cast("decimal(19,0)").cast("string"), F.col("low"), F.lit("0"))).alias("digits"))
    taken = used.select("format", F.regexp_replace("token", "[^0-9]", "").alias("digits"))
    free = _placed(made.join(taken, ["format", "digits"], "left_anti"), ["at"]).select("format", "place", "digits")
    mac = hmac_hex(mac_message(F.col("entity_type"), F.col("real_value")))
    waiting = _placed(rows.withColumn("mac", mac), ["mac", *KEY]).drop("mac")
    got = waiting.join(free, ["format", "place"])
    return materialize(got.withColumn("surrogate", spread_digits(F.col("real_value"), F.col("digits"))).drop("format", "place", "digits"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(rows: DataFrame, vault: DataFrame) -> DataFrame:
    """Give new rows their place after everything already in the vault."""
    last = vault.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    ranked = global_rank(rows, [F.col("ord")], "rank")
    return materialize(
        ranked.select(
            "entity_type", "real_value", "surrogate", (F.col("rank") + last + 1).alias("seq"), F.lit(False).alias("derived")
        )
    )


def surrogates_for(values: DataFrame, vault: DataFrame, rules: DataFrame) -> DataFrame:
    """The replacement of each distinct ``(entity_type, real_value)``.

    Vault of the same type, then (fakes only) of any type; replaced entities take their
    fixed text. Anything without an answer fails closed to ``<TYPE>``.
    """
    distinct = values.select("entity_type", "real_value").distinct()
    got = v.find_both(distinct, vault)
    got = got.join(F.broadcast(rules.select("entity_type", "operator", "new_value")), "entity_type", "left")
    found = F.when(F.col("operator") == FPE, F.col("same")).when(F.col("operator") == FAKE, F.coalesce("same", "anywhere"))
    fallback = F.coalesce("new_value", F.concat(F.lit("<"), F.col("entity_type"), F.lit(">")))
    return got.select("entity_type", "real_value", F.coalesce(found, fallback).alias("replacement"))
