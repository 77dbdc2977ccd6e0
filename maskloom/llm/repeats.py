"""Exact removal of repeated byte strings by a column-wise built transform of many short texts.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else. Building the
Burrows-Wheeler transform of a whole collection column by column takes as many rounds as the
longest document has bytes, each over all that was inserted before. So the collection is first
cut into short texts in such a way that equal strings always lie at equal columns:

1. Every window of LENGTH bytes has an anchor, the substring of ``GRAM`` bytes in it with the
   smallest hash (the last of equals). Equal windows have equal anchors at equal places. The
   windows of one anchor are neighbours; the bytes they cover are a segment, under 350 bytes.
2. Only anchors found twice can hold repeated windows. Counts are pre-aggregated in tasks.
3. Equal segments (128-bit digests) are counted first; one of each goes on, and only where
   different segments share an anchor is there anything left to compare.
4. Segments of one anchor, aligned at it, are the collection. From the last column to the first,
   each round inserts one symbol per segment: a stable sort by symbol turns the order of the
   suffixes from the column after into that of the suffixes from here, and common prefixes with
   the neighbour are updated by range minima. Symbols are read column by column from a
   sequential file of the task. As columns are aligned, a round costs one pass over the segments
   and not over all that was inserted. A common prefix of LENGTH marks both windows.
5. An anchor with more than ``GROUP`` different segments (a passage of many documents) is split:
   windows are dealt by their distance to the anchor into narrower classes, whose key is the
   hash of all bytes that the windows of a class have in common. At distance classes of width
   one the key is the window, and counting decides. Nothing is capped.

Defined results. A null text is empty. Repeated rows are documents like others: a text of at
least LENGTH bytes that occurs twice goes entirely. Very long texts are worked on whole. Rows
with a null doc_id count like others. An empty table gives an empty result. Only doc_id and text
are read: extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import words as wd
from maskloom.llm.common import chunks, measured, parts, saved, table, text_bytes

LENGTH, GRAM = 200, 50
REACH = LENGTH - GRAM  # largest distance of a window's start from its anchor
GROUP, BLOCK = 4096, 16384
WIDTHS = (38, 10, 3, 1)
CHUNK_BYTES = 1 << 18
_SEGMENTS = "key long, c1 long, c2 long, uid long, uid2 long, weight long, starts binary, d0 int, d1 int, bytes binary"
_UNITS = "key long, c1 long, c2 long, r1 long, r2 long, weight long, d0 int, d1 int, bytes binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first start, last start, anchor's place, anchor's hash."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if not (lengths >= LENGTH).any():
        return none, none, none, none, none.astype(np.uint64)
    sums = wd.prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = wd.span_hashes(sums, at, at + GRAM)
    low = np.uint64((1 << int(len(data)).bit_length()) - 1)
    least = (grams & ~low) | (low - at.astype(np.uint64))
    width = 1
    while width * 2 <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.flatnonzero(np.repeat(lengths, lengths) >= LENGTH)  # of texts with a window at all
    doc = np.repeat(np.arange(len(lengths)), lengths)[starts]
    fits = starts + LENGTH <= offsets[doc + 1]
    starts, doc = starts[fits], doc[fits]
    place = (low - (least[starts] & low)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], starts[first], starts[last], place[first], grams[place[first]]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text, once, with a 2 if they are there more than once."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch, "text", CHUNK_BYTES):
            doc, _, _, _, grams = anchors(data, offsets)
            order = np.lexsort((grams, doc))
            doc, grams = doc[order], grams[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
            at = np.flatnonzero(new)
            counts = np.minimum(np.diff(np.append(at, len(doc))), 2)
            uid, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[first:last] for c in ("uid", "copies"))
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(uid[doc[at]]), pa.array(np.maximum(counts, np.minimum(copies[doc[at]], 2)))], ["gram", "uid", "n"])


def _digest(content: bytes, distance: int) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(content, seed=distance)
    return (value >> 64) - 2**63, (value & (2**64 - 1)) - 2**63


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the anchors in ``grams``; equal ones of a text are one row with all their starts."""
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        uid, uid2, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("uid", "uid2", "copies"))
        wanted = batch.column(batch.schema.get_field_index("grams"))
        for begin, end, data, offsets in chunks(batch, "text", CHUNK_BYTES):
            doc, first, last, place, grams = anchors(data, offsets)
            whole = data.tobytes()
            rows: list[list] = [[] for _ in names]
            cuts = np.searchsorted(doc, np.arange(end - begin + 1))
            for i in range(end - begin):
                run = slice(cuts[i], cuts[i + 1])
                good = np.isin(grams[run].view(np.int64), wanted[begin + i].values.to_numpy())
                found: dict[tuple[int, int], list] = {}
                for s0, s1, a, gram in zip(*(x[run][good].tolist() for x in (first, last, place, grams.view(np.int64)))):
                    content = whole[s0 : s1 + LENGTH]
                    digest = _digest(content, a - s0)
                    found.setdefault(digest, [gram, a - s1, a - s0, content, []])[4].append(s0 - int(offsets[i]))
                for (c1, c2), (gram, d0, d1, content, starts) in found.items():
                    made = (gram, c1, c2, uid[begin + i], uid2[begin + i], 2 if len(starts) > 1 or copies[begin + i] > 1 else 1, np.array(starts, np.int64).tobytes(), d0, d1, content)
                    for to, x in zip(rows, made):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)


def repeated_windows(groups: np.ndarray, d0: np.ndarray, d1: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Which windows (segment, distance to the anchor) are found in another segment of their group.

    Segments come group by group. Columns are counted so that all anchors begin at column REACH.
    """
    n, wide = len(contents), REACH + LENGTH
    marks = np.zeros((n, REACH + 1), bool)
    begin, end = REACH - d1, wide - d0
    with tempfile.TemporaryFile() as columns:
        table_ = np.zeros((n, wide), np.uint8)
        for i, content in enumerate(contents):
            table_[i, begin[i] : begin[i] + len(content)] = np.frombuffer(content, np.uint8)
        columns.write(np.ascontiguousarray(table_.T).tobytes())
        del table_
        order, prefix = np.arange(n), np.zeros(n, np.int32)
        group = np.unique(groups, return_inverse=True)[1].astype(np.int64) * 257
        for column in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
            columns.seek(column * n)
            symbols = np.frombuffer(columns.read(n), np.uint8).astype(np.int64)
            symbols[(column < begin) | (column >= end)] = 256
            old = symbols[order]
            keys = group[order] + old
            moved = np.argsort(keys, kind="stable")
            p, q = moved[:-1], moved[1:]
            same = np.flatnonzero((keys[p] == keys[q]) & (old[q] < 256))
            after = np.zeros(n, np.int32)
            after[same + 1] = prefix[q[same]] + 1
            apart = same[q[same] - p[same] > 1]
            if len(apart):
                ends = np.stack([p[apart] + 1, q[apart] + 1], axis=1).ravel()
                after[apart + 1] = np.minimum.reduceat(np.append(prefix, 0), ends)[::2] + 1
            order, prefix = order[moved], after
            if column <= REACH:
                hit = np.flatnonzero(prefix >= LENGTH)
                marks[order[hit], REACH - column] = True
                marks[order[hit - 1], REACH - column] = True
    return marks


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole groups from rows sorted by key; results for contents found once only."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        if rows:
            key, r1, r2, weight, d0, d1, contents = zip(*rows)
            marks = repeated_windows(np.array(key), np.array(d0), np.array(d1), list(contents))
            for i in np.flatnonzero(marks.any(axis=1) & (np.array(weight) == 1)).tolist():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], marks[i].astype(np.int8), [0]])))
                for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    for to, x in zip(out, (r1[i], r2[i], low, high - 1)):
                        to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["r1", "r2", "low", "high"])

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "r1", "r2", "weight", "d0", "d1", "bytes")]
        for row in zip(*columns):
            if len(held) >= BLOCK and held[-1][0] != row[0]:
                yield work(held)
                held = []
            held.append(row)
    yield work(held)


def _narrowed(width: int):
    """Deal the windows of segments into classes of distances; the key is what a class has in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _UNITS.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("r1", "r2", "weight", "d0", "d1", "bytes")]
            for r1, r2, weight, d0, d1, content in zip(*columns):
                for low in range(d0 // width * width, d1 + 1, width):
                    high = min(low + width - 1, REACH)
                    a, b = max(low, d0), min(high, d1)
                    part = content[d1 - b : d1 - a + LENGTH]
                    # What all windows of the whole class cover, from ``low`` before the anchor on: each
                    # window of the segment covers it too, wherever the segment's own windows end.
                    common = content[d1 - low : d1 - high + LENGTH]
                    key = xxhash.xxh3_64_intdigest(common, seed=low * 1000 + width) - 2**63
                    c1, c2 = _digest(part, b)
                    for to, x in zip(rows, (key, c1, c2, r1, r2, weight, a, b, part)):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    return run


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed stretches of each text, from ranges of repeated starts."""
    for batch in batches:
        packed = []
        for ranges in batch.column(2):
            low, high = (ranges.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            packed.append(merged(low, high + LENGTH).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["uid", "uid2", "spans"])


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal stretches covered by [begin, end), touching ones joined; flat array of borders."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([begin[at], end[np.append(at[1:], len(begin)) - 1]], axis=1).ravel()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, digests, spans_out = [], [], [], [], []
        for text, spans, copies in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            text = text.as_py()
            at = np.frombuffer(spans.as_py(), np.int64) if spans.is_valid else np.zeros(0, np.int64)
            if copies > 1 and len(text) >= LENGTH:
                at = np.array([0, len(text)])
            kept, last = hashlib.sha256(), 0
            for s, e in zip(at[::2].tolist(), at[1::2].tolist()):
                kept.update(text[last:s])
                last = e
            kept.update(text[last:])
            sizes.append(len(text))
            removed.append(int((at[1::2] - at[::2]).sum()))
            runs.append(len(at) // 2)
            digests.append(kept.hexdigest())
            spans_out.append(at.tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(spans_out, pa.list_(pa.int64()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _level(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of saved units: ranges found repeated, ranges to come from comparison, and units left for narrower classes."""
    content = saved(units.groupBy("key", "c1", "c2").agg(F.sum("weight").alias("all"), F.min(F.struct("r1", "r2", "weight")).alias("rep")))
    twice = content.where("all > 1").select("c1", "c2")
    whole = units.where("weight = 1").join(twice, ["c1", "c2"], "left_semi").select("r1", "r2", F.col("d0").alias("low"), F.col("d1").alias("high"))
    keys = content.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.when(F.col("all") == 1, 1).otherwise(0)).alias("open")).where("m > 1 and open = 1").select("key", "m")
    picked = content.join(keys, "key").select("key", "c1", "c2", "rep.r1", "rep.r2", "all", "m")
    one = units.drop("weight").join(picked, ["key", "c1", "c2", "r1", "r2"]).withColumn("weight", F.least("all", F.lit(2).cast("long"))).drop("all")
    one = one.dropDuplicates(["key", "c1", "c2"])
    one = saved(one)
    return whole, _close(one), one.where(F.col("m") > GROUP).drop("m")


def _close(units: DataFrame) -> DataFrame:
    """Compare the units of groups that are small enough for one block."""
    near = units.where(F.col("m") <= GROUP).repartition(parts(units.sparkSession), "key").sortWithinPartitions("key")
    return near.mapInArrow(_compared, "r1 long, r2 long, low int, high int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans are byte borders."""
    texts = docs.select("doc_id", text_bytes().alias("text"))
    texts = texts.withColumn("uid", F.xxhash64("text")).withColumn("uid2", F.xxhash64(F.lit(17), "text"))
    copies = texts.groupBy("uid", "uid2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")).where("copies > 1")
    copies = measured(saved(copies))
    texts = texts.join(copies, ["uid", "uid2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    again = texts.where((F.col("copies") > 1) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["uid", "uid2"])
    one = texts.where("copies = 1").unionByName(again)
    found = saved(one.select("text", "uid", "copies").mapInArrow(_occurrences, "gram long, uid long, n long"))
    twice = found.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    flags = saved(found.join(twice, "gram", "left_semi").groupBy("uid").agg(F.collect_list("gram").alias("grams")))
    segments = one.select("uid", "uid2", "copies", "text").join(flags, "uid").mapInArrow(_segments, _SEGMENTS)
    segments = saved(segments)
    # Segments of any number of texts with one content are one unit from here on.
    contents = saved(segments.groupBy("key", "c1", "c2").agg(F.sum("weight").alias("weight"), F.min(F.struct("uid", "uid2")).alias("of")))
    open_keys = contents.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("weight").alias("w")).where("m > 1 and w = 1").select("key", "m")
    chosen = contents.join(open_keys, "key").select("c1", "c2", "of.uid", "of.uid2", F.least("weight", F.lit(2).cast("long")).alias("weight"), "m")
    units = segments.select("key", "c1", "c2", "uid", "uid2", "d0", "d1", "bytes").join(chosen, ["c1", "c2", "uid", "uid2"])
    units = saved(units.select("key", "c1", "c2", F.col("c1").alias("r1"), F.col("c2").alias("r2"), "weight", "d0", "d1", "bytes", "m"))
    ranges = [saved(_close(units))]
    units = units.where(F.col("m") > GROUP).drop("m")
    for width in WIDTHS:
        if units.isEmpty():
            break
        whole, near, units = _level(saved(units.mapInArrow(_narrowed(width), _UNITS)))
        ranges += [whole, saved(near)]
    every = ranges[0]
    for more in ranges[1:]:
        every = every.union(more)
    single = every.groupBy(F.col("r1").alias("c1"), F.col("r2").alias("c2")).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    spots = segments.select("c1", "c2", "uid", "uid2", "starts", "d0", "d1")
    many = contents.where("weight > 1").select("c1", "c2")
    whole = spots.join(many, ["c1", "c2"]).select("uid", "uid2", "starts", F.array(F.struct(F.col("d0").alias("low"), F.col("d1").alias("high"))).alias("ranges"), "d1")
    partly = spots.join(single, ["c1", "c2"]).select("uid", "uid2", "starts", "ranges", "d1")
    places = whole.union(partly).mapInArrow(_places, "uid long, uid2 long, low long, high long")
    spans = places.groupBy("uid", "uid2").agg(F.collect_list(F.struct("low", "high")).alias("x")).mapInArrow(_joined_spans, "uid long, uid2 long, spans binary")
    return texts.join(measured(saved(spans)), ["uid", "uid2"], "left").select("doc_id", "text", "spans", "copies").mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of repeated windows in the text: the anchor's place less the distances."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for uid, uid2, starts, ranges, d1 in zip(*(c.to_pylist() for c in batch.columns)):
            for start in np.frombuffer(starts, np.int64).tolist():
                for r in ranges:
                    for to, x in zip(out, (uid, uid2, start + d1 - r["high"], start + d1 - r["low"])):
                        to.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["uid", "uid2", "low", "high"])


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
