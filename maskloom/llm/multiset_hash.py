"""Document fingerprints: a homomorphic multiset hash of paragraphs, DataFrame operations only.

Each paragraph (text between newlines) is hashed to a wide vector of lanes; the fingerprint of a
document is the sum of its paragraphs' vectors, each lane modulo 2**32. So the order of the
paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting the
fingerprint of that paragraph alone.

* Lanes 0-7: 256 bits from four 64-bit hashes of the paragraph. Equal multisets have equal lanes,
  others differ in them but for chance.
* Lane 8: number of word shingles of the paragraph (three words; shorter at its end).
* Lanes 9-72: bit j of each shingle's hash, summed. ``2 * lane - lane 8`` is a sum of random
  signs, so squared differences of two documents' lanes estimate how many shingles they do not
  share; ``likeness`` is 1 less that number over both documents' own (0 to 1, error about 0.12).

The summing is one hash aggregation with buffers of fixed size; it runs within the tasks that
hold the texts wherever these are partitioned by the document already.

Defined results. A null text is an empty text: one empty paragraph. Repeated rows are documents
of their own. In ``with_next`` rows are ordered by doc_id, then text, null ids last. An empty
table gives an empty result. Lanes count up to 2**31 shingles, more than a string can hold. The
query reads doc_id and text alone: extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import SPACE, parts, table

SIGNS = 64
IDENTITY = 8
MASK = 0xFFFFFFFF
RANGES_PER_PARTITION = 4


def lanes_of(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per key with ``lanes``; rows that share a key are summed."""
    paragraphs = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("p"))
    words = F.split("p", rf"[{SPACE}]+", -1)
    paragraphs = paragraphs.select(*keys, *[F.xxhash64(F.lit(i), "p").alias(f"h{i}") for i in range(IDENTITY // 2)], words.alias("w"))
    zipped = F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")).alias("w2"), F.slice("w", F.lit(3), F.size("w")).alias("w3"))
    shingles = paragraphs.select(*keys, *[f"h{i}" for i in range(IDENTITY // 2)], F.posexplode(zipped).alias("at", "s"))
    shingles = shingles.withColumn("h", F.xxhash64("s.*"))

    def first(value: Column) -> Column:
        return F.sum(F.when(F.col("at") == 0, value).otherwise(F.lit(0).cast("long")))

    sums = []
    for i in range(IDENTITY // 2):
        sums += [first(F.col(f"h{i}").bitwiseAND(F.lit(MASK))).alias(f"i{2 * i}"), first(F.shiftrightunsigned(f"h{i}", 32)).alias(f"i{2 * i + 1}")]
    # Two lanes share a long: neither sum reaches 2**31.
    pairs = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1)) + F.shiftleft(F.shiftrightunsigned("h", j + 32).bitwiseAND(F.lit(1)), 32)).alias(f"s{j}") for j in range(SIGNS // 2)]
    done = shingles.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"), *pairs)
    low = [F.col(f"s{j}").bitwiseAND(F.lit(MASK)) for j in range(SIGNS // 2)]
    high = [F.shiftrightunsigned(f"s{j}", 32) for j in range(SIGNS // 2)]
    return done.select(*keys, F.array(*[F.pmod(F.col(f"i{i}"), F.lit(MASK + 1)) for i in range(IDENTITY)], F.col("n"), *low, *high).alias("lanes"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after inserting (sign 1) or deleting (sign -1) what b is the fingerprint of."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * sign, F.lit(MASK + 1)))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 (no shingle in common) to 1 (equal multisets of paragraphs)."""

    def signs(lanes: Column) -> Column:
        return F.transform(F.slice(lanes, IDENTITY + 2, SIGNS), lambda x: (x * 2 - F.element_at(lanes, IDENTITY + 1)).cast("double"))

    def norm(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    apart = norm(F.zip_with(signs(a), signs(b), lambda x, y: x - y))
    own = norm(signs(a)) + norm(signs(b))
    share = F.when(own > 0, F.greatest(F.lit(0.0), 1 - apart / own)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of doc_id with a number in each range, and the first row of the range after as a guest.

    Adds range_id, place and guest; after the last range comes the first. The bounds are values
    of doc_id from one aggregation, as many as there are ranges.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    ranges = parts(spark) * RANGES_PER_PARTITION
    found = docs.agg(F.min(order).alias("least"), F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10_000)).alias("b")).first()
    bounds = sorted({found.least, *found.b}) if found.least is not None else [0]
    listed = "array(" + ",".join(f"{b}L" if b > -(2**63) else "bigint('-9223372036854775808')" for b in bounds) + ")"
    # The range of a row is the number of bounds up to its id, less one: bisection by powers of two.
    steps = f"sequence({len(bounds).bit_length() - 1}, 0, -1)" if len(bounds) > 1 else "array(0)"
    upto = f"aggregate({steps}, 0, (lo, i) -> IF(lo + shiftleft(1, i) <= {len(bounds)} AND get(bounds, lo + shiftleft(1, i) - 1) <= ord, lo + shiftleft(1, i), lo))"
    rows = docs.withColumn("ord", order).withColumn("bounds", F.expr(listed)).withColumn("range_id", F.expr(upto) - 1)
    first = F.get("bounds", F.col("range_id")) == F.col("ord")
    own = F.struct(F.col("range_id").alias("range_id"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range_id") - 1, F.lit(len(bounds))).alias("range_id"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).drop("range_id", "bounds").select("*", "to.*").drop("to")
    inside = Window.partitionBy("range_id").orderBy("guest", "ord", F.col("text"))
    # The lead over the same window runs in the same sort, so the next text comes along.
    return rows.withColumn("place", F.row_number().over(inside)).withColumn("next_text", F.coalesce(F.lead("text").over(inside), F.lit(""))).drop("ord")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, int(n_chars) - int(floor(n_chars / 2)))"), F.expr("left(next_text, int(floor(n_chars / 2)))"))
    rows = rows.withColumn("edited", edited)
    keys = ["range_id", "place", "guest", "doc_id", "n_chars", "edited_sha256", "kind"]
    rows = rows.select("range_id", "place", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array("text", "edited"))).alias("kind", "text"))
    lanes = lanes_of(rows.where("kind = 0 or not guest"), keys)
    inside = Window.partitionBy("range_id").orderBy("place", "kind")
    following = F.lead("lanes").over(inside)
    # Own fingerprint, then the edited text's, then the next document's own.
    done = lanes.withColumn("edited_lanes", following).withColumn("next_lanes", F.lead("lanes", 2).over(inside)).where("kind = 0 and not guest")
    lanes_c, edited_c, next_c = F.col("lanes"), F.col("edited_lanes"), F.col("next_lanes")
    return done.select("doc_id", "n_chars", "edited_sha256", as_text(lanes_c).alias("fingerprint"), as_text(edited_c).alias("edited_fingerprint"),
                       likeness(lanes_c, edited_c).alias("near_edited"), likeness(lanes_c, next_c).alias("near_next"))
