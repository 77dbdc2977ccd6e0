"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame operations. For each source its documents are laid end to end in a hashed order
and cut into blocks of ``block_words`` words. The target of a source is a number of words; it is
met exactly by whole passes (epochs) over the source plus some blocks of one more pass.

* Targets: sources share ``total`` times all words by weight; none gets more than ``cap`` times
  its own words, the excess is shared again by weight. The water level that this leads to is
  found in one sorted pass over the sources.
* Splitting tree: the block quotas of all sources are split between the two halves of the
  shards, and so on. Each split is one draw from the multivariate hypergeometric law (source by
  source, the rest conditioned on what is drawn), so that every shard holds what a random deal
  of all blocks would give it, and quotas are kept exactly. It needs counts only.
* Which blocks: each pass orders a source's blocks by a keyed permutation of 0..n-1
  (swap-or-not shuffle, computed per block, no sort). Shards own disjoint runs of that order.
* ``shuffled`` puts rows into their shards and sorts each shard by ``place``, a hash: the local
  shuffle. A run of blocks that stays one text goes to the shard of its first block.

The running positions of documents need no big window: documents are dealt into hashed cells
of their source, cells get their offset from cell sums, and windows run inside cells. A source
with a third of all rows has as many cells as the others have, each with its share of rows.
The tables of sources and of shards times sources are metadata; they pass one task.

Defined results. Words are separated by ASCII white space; a null text has none, and a document
without words gets no piece. A null source is a source of its own, last in order. Repeated rows
are documents of their own. An empty table gives an empty result. Extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import SPACE, parts, saved, table, words_of

WEIGHTS = (3, 1, 2)
TOTAL, CAP = 1.5, 2.0
BLOCK_WORDS = 256
SHARDS = 16
SEED = 20240229
CELLS = 4096
ROUNDS = 24
_OWN = ("size", "skey", "start", "pieces", "target", "source_size", "src", "run", "shard", "place")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(skey, source_size) -> with target; one row per source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = sizes.withColumn("at", F.row_number().over(Window.orderBy("skey")) - 1)
    ordered = ordered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    ordered = ordered.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = ordered.withColumn("all", F.sum("source_size").over(everything) * F.lit(total)).withColumn("weights", F.sum("weight").over(everything))
    before = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ordered = ordered.withColumn("level", level)
    ordered = ordered.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at"))).over(everything))
    return ordered.select("skey", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


# The law of the number x of good ones among m drawn from n of which k are good: weights relative
# to the mode's, followed to both sides by their ratios over twelve standard deviations and twenty
# steps more, beyond which nothing is left in double precision; then the inverse of the law at u.
_BOUND = """
transform(array(named_struct('n', double({total}), 'k', double({good}), 'm', double({drawn}), 'u', {u})), p ->
  transform(array(named_struct(
      'mode', least(greatest(double(floor((p.m + 1) * (p.k + 1) / (p.n + 2))), p.m - (p.n - p.k), 0D), p.m, p.k),
      'steps', sequence(1L, 20L + bigint(ceil(12 * sqrt(greatest(0D,
          p.m * p.k / greatest(p.n, 1D) * (1 - p.k / greatest(p.n, 1D)) * (p.n - p.m) / greatest(p.n - 1, 1D)))))))), q ->
    {body})[0])[0]"""
_UP = "IF({a} > 0, {a} * greatest(p.k - (q.mode + {t}), 0D) * greatest(p.m - (q.mode + {t}), 0D) / ((q.mode + {t} + 1) * (p.n - p.k - p.m + q.mode + {t} + 1)), 0D)"
_DOWN = "IF({b} > 0, {b} * greatest(q.mode - {t}, 0D) * greatest(p.n - p.k - p.m + q.mode - {t}, 0D) / ((p.k - q.mode + {t} + 1) * (p.m - q.mode + {t} + 1)), 0D)"
_FIRST = f"'a', {_UP.format(a='1D', t=0)}, 'b', {_DOWN.format(b='1D', t=0)}"
_NEXT = f"'a', {_UP.format(a='s.a', t='t')}, 'b', {_DOWN.format(b='s.b', t='t')}"
_MASS = f"aggregate(q.steps, named_struct({_FIRST}, 'c', 1D), (s, t) -> named_struct({_NEXT}, 'c', s.c + s.a + s.b), s -> s.c)"
_PICK = f"""bigint(transform(array(p.u * {_MASS}), goal -> aggregate(q.steps,
    named_struct({_FIRST}, 'c', 1D, 'x', IF(1D > goal, q.mode, NULL)),
    (s, t) -> named_struct({_NEXT}, 'c', s.c + s.a + s.b, 'x', coalesce(s.x,
        IF(s.a > 0 AND s.c + s.a > goal, q.mode + t, NULL), IF(s.b > 0 AND s.c + s.a + s.b > goal, q.mode - t, NULL))),
    s -> coalesce(s.x, q.mode)))[0])"""


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL of one draw: how many of ``drawn`` out of ``total`` are among the ``good``."""
    return _BOUND.format(total=total, good=good, drawn=drawn, u=u, body=_PICK)


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(skey, quota) -> (skey, shard, blocks); shards is a power of two, their totals differ by one at most."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    kind = "array<struct<skey:string,k:bigint>>"
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", F.col("quota").cast("long").alias("k")))).alias("quotas")).select(F.lit(0).alias("node"), "quotas")
    for level in range(shards.bit_length() - 1):
        u = f"(shiftrightunsigned(xxhash64({seed}L, {level}, node, x.skey), 11) / {2.0**53!r}D)"
        draw = f"IF(x.k = 0, 0L, {hypergeometric('s.total', 'x.k', 's.left', u)})"
        lefts = f"""aggregate(quotas, named_struct('total', total, 'left', (total + node % 2) div 2, 'out', cast(array() AS {kind})),
            (s, x) -> transform(array({draw}), got -> named_struct('total', s.total - x.k, 'left', s.left - got,
                'out', array_append(s.out, named_struct('skey', x.skey, 'k', got))))[0], s -> s.out)"""
        nodes = nodes.selectExpr("node", "quotas", "aggregate(quotas, 0L, (s, x) -> s + x.k) AS total").selectExpr("node", "quotas", f"{lefts} AS lefts")
        nodes = nodes.selectExpr("""inline(array(named_struct('node', node * 2, 'quotas', lefts), named_struct('node', node * 2 + 1,
            'quotas', zip_with(quotas, lefts, (a, b) -> named_struct('skey', a.skey, 'k', a.k - b.k)))))""")
    return saved(nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("q.skey", "shard", F.col("q.k").alias("blocks")))


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: the place of x in a keyed permutation of 0..n-1."""

    def swap(s: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - s, n)
        return F.when(F.xxhash64(F.lit("b"), r, *key, F.greatest(s, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add size, source_size, target and pieces to each document.

    pieces: array of (epoch, block, shard, place, from_word, words), what the mix takes of it.
    """
    clash = {*_OWN, "cell", "base"} & {c.lower() for c in docs.columns} - ({"size"} if size is None else set())
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    w = F.lit(block_words).cast("long")
    base = docs.withColumn("size", words_of() if size is None and "size" not in docs.columns else (F.col("size") if size is None else size)).withColumn("skey", source_key(F.col("source")))
    order = F.xxhash64(F.lit(seed), "doc_id", "skey")
    base = base.withColumn("cell", F.pmod(F.shiftrightunsigned(order, 8), F.lit(CELLS)))
    cells = saved(base.groupBy("skey", "cell").agg(F.sum("size").alias("words")))
    sources = targets(cells.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, total, cap)
    size_of, goal = F.col("source_size"), F.least(F.floor(F.col("target") + 0.5).cast("long"), F.floor(F.col("source_size") * F.lit(cap)).cast("long"))
    sources = sources.withColumn("goal", goal).withColumn("full", F.floor(size_of / w)).withColumn("blocks", F.floor((size_of + w - 1) / w))
    sources = sources.withColumn("epochs", F.when(size_of > 0, F.floor(F.col("goal") / size_of)).otherwise(F.lit(0).cast("long")))
    sources = sources.withColumn("rest", F.col("goal") - F.col("epochs") * size_of)
    sources = saved(sources.withColumn("quota", F.col("epochs") * F.col("blocks") + F.floor((F.col("rest") + w - 1) / w)))
    split = split_tree(sources.select("skey", "quota"), shards, seed)
    split = split.withColumn("upto", F.sum("blocks").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    ends = split.groupBy("skey").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("ends"))
    inside = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("base", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sources.join(ends, "skey"), "skey")
    offsets = offsets.select("skey", "cell", "base", F.struct("source_size", "target", "full", "blocks", "epochs", "rest", "ends").alias("src"))
    # A fixed number of partitions: the rows are narrow, but their pieces cost CPU.
    base = base.repartition(parts(docs.sparkSession), "skey", "cell")
    before = Window.partitionBy("skey", "cell").orderBy(order, F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).join(saved(offsets).hint("shuffle_hash"), ["skey", "cell"])
    placed = placed.withColumn("start", F.col("start") + F.col("base"))
    src, start, end = F.col("src"), F.col("start"), F.col("start") + F.col("size")

    # Each block's slot is computed once: what follows reads it as a field.
    def slotted(epoch: Column, block: Column) -> Column:
        slot = F.when(block >= src["full"], block).otherwise(permuted(block, src["full"], F.lit(seed), epoch, F.col("skey")))
        return F.struct(epoch.alias("epoch"), block.alias("block"), slot.alias("slot"), (epoch * src["blocks"] + slot).alias("at"))

    def piece(x: Column) -> Column:
        epoch, block, slot = x["epoch"], x["block"], x["slot"]
        share = F.when(epoch < src["epochs"], w).otherwise(F.least(F.greatest(src["rest"] - slot * w, F.lit(0)), w))
        first, last = F.greatest(start, block * w), F.least(end, block * w + share)
        return F.struct(
            epoch.alias("epoch"), block.alias("block"),
            F.size(F.filter(src["ends"], lambda e: e <= x["at"])).alias("shard"),
            F.xxhash64(F.lit(seed), F.lit("place"), F.col("doc_id"), epoch, block).alias("place"),
            (first - start).alias("from_word"), F.greatest(last - first, F.lit(0).cast("long")).alias("words"),
        )

    epochs = F.sequence(F.lit(0).cast("long"), F.when(src["rest"] > 0, src["epochs"]).otherwise(F.greatest(src["epochs"] - 1, F.lit(0))))
    blocks = F.sequence(F.floor(start / w), F.floor((end - 1) / w))
    pieces = F.filter(F.transform(F.flatten(F.transform(epochs, lambda e: F.transform(blocks, lambda b: slotted(e, b)))), piece), lambda p: p["words"] > 0)
    none = F.array().cast("array<struct<epoch:bigint,block:bigint,shard:int,place:bigint,from_word:bigint,words:bigint>>")
    return placed.select(*[f"`{c}`" for c in docs.columns if c != "size"], "size", "src.source_size", "src.target", F.when(F.col("size") > 0, pieces).otherwise(none).alias("pieces"))


def taken(pieces: str = "pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s + p["words"])


def taken_by_shard(pieces: str = "pieces") -> Column:
    """(shard, words) of each shard that takes words of the document, in order of shards."""

    def words(shard: Column) -> Column:
        mine = F.filter(pieces, lambda p: p["shard"] == shard)
        return F.struct(shard.alias("shard"), F.aggregate(mine, F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("words"))

    return F.transform(F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p["shard"]))), words)


def shuffled(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with a shard and a place: a shard's rows together, and in order of their places.

    A shard has several slices of its places, so that it is no single task.
    """
    slices = max(1, -(-parts(rows.sparkSession) // shards))
    dealt = rows.repartition(shards * slices, F.col("shard"), F.pmod(F.col("place"), F.lit(slices)))
    return dealt.sortWithinPartitions("shard", "place")


def mixed_texts(mixed: DataFrame) -> DataFrame:
    """One row per run of words the mix takes: the document's columns, text cut to that run, shard and place.

    Blocks that follow each other in a document and pass are one run, cut at word starts; white
    space stays with the word before it, so that a whole document comes back as it was.
    """
    kind = "array<struct<epoch:bigint,from_word:bigint,words:bigint,shard:int,place:bigint>>"

    def join(s, p):
        last = F.element_at(s, -1)
        more = F.struct(p["epoch"].alias("epoch"), p["from_word"].alias("from_word"), p["words"].alias("words"), p["shard"].alias("shard"), p["place"].alias("place"))
        longer = F.struct(last["epoch"].alias("epoch"), last["from_word"].alias("from_word"), (last["words"] + p["words"]).alias("words"), last["shard"].alias("shard"), last["place"].alias("place"))
        follows = (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["epoch"] == p["epoch"]) & (F.try_element_at(s, F.lit(-1))["from_word"] + F.try_element_at(s, F.lit(-1))["words"] == p["from_word"])
        return F.when(F.coalesce(follows, F.lit(False)), F.array_append(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), longer)).otherwise(F.array_append(s, more))

    runs = F.aggregate("pieces", F.array().cast(kind), join)
    rows = mixed.select("*", F.explode(runs).alias("run"))
    whole = F.col("run.words") == F.col("size")
    words = F.regexp_extract_all("text", F.lit(rf"(?:^[{SPACE}]+)?[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("run.from_word") + 1).cast("int"), F.col("run.words").cast("int")), "")
    return rows.withColumns({"text": F.when(whole, F.col("text")).otherwise(cut), "shard": F.col("run.shard"), "place": F.col("run.place")})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = saved(table(spark, sf_dir, "documents").select("doc_id", "source", words_of().alias("size")))
    return mix(docs).select("doc_id", "size", "source_size", "target", taken().alias("taken"), taken_by_shard().alias("taken_by_shard"))
