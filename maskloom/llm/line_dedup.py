"""Line deduplication by range-partitioned hashes; documents get keep bitmaps, not texts.

1. Tasks cut texts into lines and hash the keys of the long ones (128 bits).
2. The rows (hash, doc_id, position) are range partitioned and sorted by hash, then doc_id
   descending, then position. The ranges are cut on all of these, so that a line found in a
   third of all documents spreads over as many ranges as its rows need.
3. A stream over each range sees the occurrence that stays first. It holds back the rows of a
   hash until ``min_docs`` documents are seen, then returns every later row as dropped.
   Only the first and last hash of a range can go on in another range: a stream before it
   counts those two alone, and the counts (two per range, whatever the input) are put
   together on the driver.
4. Dropped positions are gathered per document into a zlib-compressed bitmap: a set bit drops
   the line, lines beyond its end stay.

Defined results. A null or empty text is one empty line. A null doc_id takes no part: its
lines stay. Repeated rows with one doc_id count as one document; if it is the largest holder,
all of them keep the line. Very long lines are hashed like others. An empty table gives an
empty result. Columns other than doc_id and text are carried along; clashing ones are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from maskloom.llm.common import measured, parts, saved, table, text_bytes
from maskloom.runtime import materialize

MIN_CHARS = 40
MIN_DOCS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NAMES = ("h1", "h2", "doc_id", "uid", "pos")
ROWS = pa.schema([(c, pa.int32() if c == "pos" else pa.int64()) for c in _NAMES])


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").translate(_LOWER)


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line_key(line)
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_intdigest(key)
                    for to, x in zip(rows, ((digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, doc, uid, i)):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, ROWS)], schema=ROWS)

    return run


def _by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict[str, np.ndarray]]]:
    """Pieces of one hash, in order; a hash comes in several pieces if its rows span batches."""
    for batch in batches:
        x = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(_NAMES)}
        cuts = np.flatnonzero((x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if s < e:
                yield (int(x["h1"][s]), int(x["h2"][s])), {c: v[s:e] for c, v in x.items()}


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last hash of a range: how many documents, from which one to which."""
    runs: list[list[int]] = []
    for (h1, h2), x in _by_hash(batches):
        doc = x["doc_id"]
        n = 1 + int(np.count_nonzero(doc[1:] != doc[:-1]))
        if runs and runs[-1][:2] == [h1, h2]:
            runs[-1][2] += n - int(runs[-1][4] == doc[0])
            runs[-1][4] = int(doc[-1])
        else:
            runs = [*runs[:1], [h1, h2, n, int(doc[0]), int(doc[-1])]]
    out = list(zip(*runs)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["h1", "h2", "docs", "most", "least"])


def _resolved(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest document of each hash at an edge, over all ranges in their order."""
    found: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        if (key := (r.h1, r.h2)) not in found:
            found[key] = [r.docs, r.most, r.least]
        else:  # a document's rows may lie on both sides of a cut
            found[key] = [found[key][0] + r.docs - int(found[key][2] == r.most), found[key][1], r.least]
    return {k: (v[0], v[1]) for k, v in found.items()}


def _dropped(min_docs: int, edges: dict[tuple[int, int], tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keeper, docs, last, held = None, 0, 0, None, []

        def out(x: dict[str, np.ndarray], mask: np.ndarray) -> list:
            return [(x["doc_id"][mask], x["uid"][mask], x["pos"][mask])] if mask.any() else []

        ready: list = []
        for now, x in _by_hash(batches):
            doc = x["doc_id"]
            if now != key:
                key, held, last, docs = now, [], None, 0
                keeper = int(doc[0])
                if now in edges:
                    total, keeper = edges[now]
                    docs = total if total >= min_docs else -(2**62)
            docs += int(doc[0] != last) + int(np.count_nonzero(doc[1:] != doc[:-1]))
            last = doc[-1]
            mine = out(x, doc != keeper)
            if docs >= min_docs:
                ready += [*held, *mine]
                held = []
            elif docs >= 0:
                held += mine
            if len(ready) >= 4096:
                yield _positions(ready)
                ready = []
        yield _positions(ready)

    return run


def _positions(found: list) -> pa.RecordBatch:
    columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32))], ["doc_id", "uid", "pos"])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for at in batch.column(2):
            at = at.values.to_numpy()
            bits = np.zeros(int(at.max()) + 1, np.uint8)
            bits[at] = 1
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "uid", "bitmap"])


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, uid, bitmap) of each document that loses a line; uid is the hash of the text."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("uid"), text_bytes().alias("text"))
    lines = saved(texts.mapInArrow(_hashed(min_chars), "h1 long, h2 long, doc_id long, uid long, pos int"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("uid"), F.col("pos")]
    # The checkpoint keeps the ranges as they are, which both streams below need.
    ranged = materialize(lines.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order))
    edges = ranged.mapInArrow(_edges, "h1 long, h2 long, docs long, most long, least long")
    edges = _resolved(edges.withColumn("part", F.spark_partition_id()).sort("part", "h1", "h2").collect())
    dropped = ranged.mapInArrow(_dropped(min_docs, edges), "doc_id long, uid long, pos int")
    gathered = dropped.groupBy("doc_id", "uid").agg(F.collect_set("pos").alias("at"))
    return gathered.mapInArrow(_bitmap, "doc_id long, uid long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Add kept (the text without its dropped lines), n_lines and n_dropped; the other columns stay."""
    clash = {"kept", "n_lines", "n_dropped", "uid", "bitmap"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    joined = docs.withColumn("uid", F.xxhash64(text_bytes())).join(measured(saved(bitmaps)), ["doc_id", "uid"], "left").select(*docs.columns, "bitmap")
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bits = batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1)
            kept, total, gone = [], [], []
            for text, bit in zip(texts, bits):
                lines = (text.as_py() or "").split("\n")
                total.append(len(lines))
                if bit.is_valid:
                    drop = np.unpackbits(np.frombuffer(zlib.decompress(bit.as_py()), np.uint8))[: len(lines)]
                    lines = [x for i, x in enumerate(lines) if i >= len(drop) or not drop[i]]
                gone.append(total[-1] - len(lines))
                kept.append("\n".join(lines))
            new = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], schema=pa.schema([*list(batch.schema)[:-1], ("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    return joined.mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, drop_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
