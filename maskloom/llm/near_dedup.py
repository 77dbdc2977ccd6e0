"""Near-duplicate classes: banded MinHash, odd sketches, exact confirmation, components.

1. Tasks hash each text's word shingles to a set of 64-bit numbers and take ``HASHES`` MinHash
   samples. Documents with one and the same set (128-bit digest) form a class; from here on one
   row per class is used, its smallest document.
2. The samples are folded into an odd sketch: sample (i, value) flips one of ``SKETCH_BITS``
   bits. The XOR of two sketches holds a bit for samples that differ; its population count d
   estimates the similarity as 1 + bits / (4 * hashes) * ln(1 - 2 d / bits), which is sharpest
   for similar sets. A pair is verified only if the estimate is within ``SLACK`` of the
   threshold (over six standard deviations).
3. Bands of samples make buckets. Within a bucket every class is paired with the bucket's
   smallest class only; confirmed pairs are joined into components. Where classes of a bucket
   still lie in several components, these classes get a wide sketch of ``WIDE`` samples, whose
   estimate is sharp enough to leave out texts that merely resemble each other, and an odd
   sketch of the whole set: with the shingles no other of these classes has, it bounds the
   similarity from above, without error. ``LEADS`` more classes, drawn by hash, are paired with
   those of other components if that is less work than all pairs, and then all pairs across
   components are searched - pairs inside one component cannot change the result, so a bucket
   of thousands of mutual near copies costs a few pairs each. No bucket is cut or skipped.
4. A pair is confirmed on the full sets, with whole numbers.

A pair at the threshold 0.85 shares none of the bands with a chance of about 3e-8.

Hot buckets: bucket rows hold no text and no set, only a class number and a 32-byte sketch (two
of 128 bytes for the classes of buckets with several components).
The pairing with the smallest class is an aggregate and an equi-join that adaptive execution
can split; sets come in by two equi-joins on class numbers.

Defined results. Fewer words than a shingle: the whole word sequence is the one shingle. Null,
empty or blank texts: empty set, linked with nothing. Rows with one doc_id and different texts
belong to one document whose classes are linked through it; rows that repeat count once. Rows
with a null doc_id take no part. An empty table gives an empty result. Sets of very long texts
are whole. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskloom.llm import words as wd
from maskloom.llm.common import chunks, mix64, saved, table, text_bytes

BANDS, ROWS = 26, 4
HASHES = BANDS * ROWS
SKETCH_BITS = 256
SLACK = 0.28
#: Samples and bits of the wide sketch, and its slack, again six standard deviations.
WIDE, WIDE_BITS, WIDE_SLACK = 512, 1024, 0.13
#: Classes of a bucket that are paired with the others before all pairs are.
LEADS = 16
CHUNK_BYTES = 1 << 19
_A = mix64(np.arange(WIDE, dtype=np.uint64) + np.uint64(0xA11CE)) | np.uint64(1)
_B = mix64(np.arange(WIDE, dtype=np.uint64) + np.uint64(0xB0B))
_LANES = [f"w{i}" for i in range(WIDE_BITS // 64)]
#: 1024 parity bits of the shingles themselves, and of those that only one class has.
_PARITY, _ALONE = [f"p{i}" for i in range(16)], [f"a{i}" for i in range(16)]
_SIGNED = "n_shingles long, digest string, sketch binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, doc = wd.word_spans(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    hashes = wd.span_hashes(wd.prefix_hashes(wd.LOWER[data]), starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    # Position i begins a shingle if its document has enough words from there, or is too short for any.
    place = np.arange(len(doc)) - first[doc]
    short = count[doc] < width
    begins = np.flatnonzero((place + width <= count[doc]) | (short & (place == 0)))
    value = np.full(len(begins), 0x51, np.uint64)
    for k in range(width):
        at = np.minimum(begins + k, len(hashes) - 1)
        inside = place[begins] + k < count[doc[begins]]
        value = np.where(inside, mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at]), value)
    owner = doc[begins]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.split(value, np.searchsorted(owner, np.arange(1, n)))


def minhash(values: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The smallest of each of the keyed hashes over the set."""
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(values), 1024):
        np.minimum(least, (values[s : s + 1024, None] * _A[None, :hashes] + _B[None, :hashes]).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the samples that fall on each bit."""
    at = (mix64(samples ^ _B[: len(samples)]) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1 != 0).tobytes()


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    rows = samples.reshape(BANDS, ROWS)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return keys.view(np.int64)


def most_different(threshold: float, hashes: int = HASHES, bits: int = SKETCH_BITS, slack: float = SLACK) -> int:
    """Largest population count of two sketches whose estimate may belong to a pair at the threshold."""
    least = threshold - slack
    return int(bits / 2 * (1 - np.exp((least - 1) * 4 * hashes / bits)))


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch, "text", CHUNK_BYTES):
                sets = shingle_sets(data, offsets, width)
                rows: tuple[list, ...] = ([], [], [], [])
                for values in sets:
                    samples = minhash(values)
                    made = (len(values), xxhash.xxh3_128_hexdigest(values.tobytes()), odd_sketch(samples), band_keys(samples).tolist() if len(values) else [])
                    for to, x in zip(rows, made):
                        to.append(x)
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *[pa.array(x, k) for x, k in zip(rows, kinds)]], ["doc_id", *[x.split()[0] for x in _SIGNED.split(", ")]])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch, "text", CHUNK_BYTES):
                sets = [x.tobytes() for x in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([xxhash.xxh3_128_hexdigest(x) for x in sets]), pa.array(sets, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def parity_lanes(values: np.ndarray) -> bytes:
    """Odd sketch of the shingles themselves: two sets differ in at least as many as in bits."""
    return np.packbits(np.bincount((values & np.uint64(15)) * np.uint64(64) + (values >> np.uint64(4) & np.uint64(63)), minlength=1024) & 1 != 0, bitorder="little").tobytes()


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        sketches = [odd_sketch(minhash(x, WIDE), WIDE_BITS) + parity_lanes(x) for x in sets]
        names = [*_LANES, *_PARITY]
        lanes = np.frombuffer(b"".join(sketches), np.int64).reshape(-1, len(names))
        columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(lanes[:, i]) for i in range(len(names))]]
        yield pa.RecordBatch.from_arrays(columns, ["c", "size", *names])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(x.as_buffer(), np.int64)
            for s in range(0, len(values), 1 << 16):
                part = values[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c)), pa.array(part)], ["c", "shingle"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b): comp is the smallest node reachable.

    Each round points every node at the smallest neighbour of its label's neighbours and jumps
    along the pointers; rounds grow with the logarithm of the longest path.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
    both = saved(both)
    labels = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        # Smallest label among a node's neighbours, given to the node's own label (a hook), then one jump.
        near = both.join(labels.select(F.col("u").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        seen = saved(labels.join(near, "u").select("u", "comp", F.least("comp", "near").alias("low")))
        hooks = seen.groupBy("comp").agg(F.min("low").alias("low"))
        hooked = seen.select("u", "comp").join(hooks, "comp").select("u", F.col("low").alias("comp"))
        jump = labels.select(F.col("u").alias("comp"), F.col("comp").alias("further"))
        moved = saved(hooked.join(jump, "comp", "left").select("u", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        changed = moved.join(labels.withColumnRenamed("comp", "before"), "u").where("comp <> before").limit(1).count()
        labels = moved
        if not changed:
            return labels.select(F.col("u").alias("node"), "comp")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept); linked if 100 * intersection >= percent * union."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    signed = saved(texts.mapInArrow(_signed(width), f"doc_id long, {_SIGNED}"))
    full = signed.where("n_shingles > 0")
    classes = saved(full.groupBy("digest").agg(F.min("doc_id").alias("c"), F.min(F.struct("doc_id", "sketch", "bands")).alias("x")).select("digest", "c", "x.sketch", "x.bands"))
    # A document with several texts links their classes; ordinary tables have none.
    shared = full.groupBy("doc_id").agg(F.collect_set("digest").alias("d")).where(F.size("d") > 1).select("doc_id", F.explode("d").alias("digest"))
    shared = shared.join(classes.select("digest", "c"), "digest").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
    buckets = classes.select("c", "sketch", F.posexplode("bands").alias("band", "bucket"))
    first = buckets.groupBy("band", "bucket").agg(F.min(F.struct("c", "sketch")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = saved(first.select("band", "bucket", F.col("x.c").alias("lead"), F.col("x.sketch").alias("lead_sketch")))
    crowded = saved(buckets.join(first, ["band", "bucket"]))
    most = most_different(percent / 100)

    def apart(x: str, y: str):
        words = [F.bit_count(F.conv(F.hex(F.substring(x, 1 + 4 * i, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(y, 1 + 4 * i, 4)), 16, 10).cast("long"))) for i in range(SKETCH_BITS // 32)]
        return sum(words[1:], words[0])

    tested = crowded.where(F.col("c") != F.col("lead")).where(apart("sketch", "lead_sketch") <= most).select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct()
    tested = saved(tested)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(c, shingles) of the classes in ``wanted``, which may repeat them."""
        picked = classes.select("c", "digest").join(wanted.distinct(), "c")
        sets = texts.join(picked.select(F.col("c").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = sets.mapInArrow(_sets(width), "doc_id long, digest string, shingles binary").dropDuplicates(["doc_id", "digest"])
        return sets.join(picked.withColumnRenamed("c", "doc_id"), ["doc_id", "digest"]).select(F.col("doc_id").alias("c"), "shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = saved(sets_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b"))))
        left = pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a")
        return left.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long")

    links = saved(confirmed(tested).union(shared))
    comp = components(links)
    member = crowded.select("band", "bucket", "c")
    widest = most_different(percent / 100, WIDE, WIDE_BITS, WIDE_SLACK)

    def unsettled(member: DataFrame) -> tuple[DataFrame, int, int]:
        """Rows of buckets that hold several components; how many, and pairs across components there."""
        member = saved(member.drop("comp").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c")))
        sizes = member.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("band", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside")).where("n * n > inside")
        sizes = saved(sizes)
        rows, pairs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0))).first()
        return saved(member.join(sizes.select("band", "bucket"), ["band", "bucket"])), rows, pairs

    def hopeful(sets: DataFrame) -> DataFrame:
        """(c, alone, parity of those): shingles of a class that no other class of ``sets`` has.

        Classes that cannot reach the threshold without them are left out. Two aggregates that
        combine before the shuffle; no join on shingles, so none is hot.
        """
        sizes = sets.groupBy("c").agg((F.min(F.octet_length("shingles")) / 8).alias("size"), F.count(F.lit(1)).alias("texts"))
        alone = sets.mapInArrow(_exploded, "c long, shingle long").groupBy("shingle").agg(F.min("c").alias("c"), F.max("c").alias("last"))
        bit = "shiftleft(1L, cast(shiftright(shingle, 4) & 63 AS int))"
        parity = [F.expr(f"bit_xor(if((shingle & 15) = {i}, {bit}, 0L))").alias(x) for i, x in enumerate(_ALONE)]
        alone = alone.where("c = last").groupBy("c").agg(F.count(F.lit(1)).alias("alone"), *parity)
        # A class number that stands for several texts (one document, several rows) is not bounded.
        one = F.col("texts") == 1
        found = sizes.join(alone, "c", "left").select("c", "size", *[F.coalesce(F.when(one, F.col(x)), F.lit(0)).alias(x) for x in ("alone", *_ALONE)])
        return saved(found.where(100 * (F.col("size") - F.col("alone")) >= percent * F.col("size")).drop("size"))

    def across(member: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs of different components in a bucket that were not tested before."""
        other = other.select("band", "bucket", F.col("c").alias("d"), F.col("comp").alias("comp2"), *[F.col(x).alias(f"other_{x}") for x in ("size", "alone", *_LANES, *_PARITY)])
        lanes = [F.bit_count(F.col(x).bitwiseXOR(F.col(f"other_{x}"))) for x in _LANES]
        # Shingles that only one of the two has: those alone, and for the rest at least the bits that differ.
        parity = [F.bit_count(F.col(x).bitwiseXOR(F.col(f"other_{x}"))) for x in _PARITY]
        rest = F.greatest(sum(parity[1:], parity[0]), F.abs(F.col("size") - F.col("alone") - F.col("other_size") + F.col("other_alone")))
        can = (100 + percent) * (F.col("alone") + F.col("other_alone") + rest) <= (100 - percent) * (F.col("size") + F.col("other_size"))
        near = can & (sum(lanes[1:], lanes[0]) <= widest)
        pairs = member.join(other, ["band", "bucket"]).where((F.col("comp") != F.col("comp2")) & near)
        return saved(pairs.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))

    member, rows, pairs = unsettled(member)
    if rows:
        sets = saved(sets_of(member.select("c")))
        bound = hopeful(sets)
        wide = sets.join(bound.select("c"), "c").mapInArrow(_wide, "c long, size long, " + ", ".join(f"{x} long" for x in [*_LANES, *_PARITY]))
        others = [F.col(x).bitwiseXOR(F.col(y)).alias(x) for x, y in zip(_PARITY, _ALONE)]
        wide = saved(wide.join(bound, "c").select("c", "size", "alone", *_LANES, *others))
        member, rows, pairs = unsettled(member.join(wide, "c"))
    if pairs > LEADS * rows:
        drawn = Window.partitionBy("band", "bucket").orderBy(F.xxhash64("c"), "c")
        wanted = across(member, member.withColumn("at", F.row_number().over(drawn)).where(F.col("at") <= LEADS))
        links, tested = links.union(saved(confirmed(wanted))), tested.union(wanted)
        comp = components(links)
        member, rows, pairs = unsettled(member)
    if rows:
        more = saved(confirmed(across(member, member)))
        if not more.isEmpty():
            comp = components(links.union(more))
    rows = signed.join(classes.select("digest", "c"), "digest", "left").join(comp.withColumnRenamed("node", "c"), "c", "left")
    rows = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("comp", "c", "doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)
