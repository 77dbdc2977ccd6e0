"""Exact top-k by inner product over vector-approximation files.

Files. Components are scaled to whole numbers. Distinct-enough vectors are dealt into blocks; a
block's approximation file holds, per vector, the number of the cell each component lies in
(``BITS`` bits a component, cells hold about equally many of the block's components) and, per
cell, its least and largest value. The exact vectors are a second file.

Scan. For each query and vector the cells give a least and a largest possible score. Queries go
in blocks; a block of queries meets all approximation blocks, in a few lanes, each a stream. A
lane keeps for each query the k best least scores and every vector whose largest score reaches
the k-th of them. What is kept leaves in portions, so a lane's memory is bounded.

Read. Rounds read exact vectors in the order of their largest possible score, first k per query,
then four times as many each round, and stop reading for a query when its k-th exact score is
above all largest scores left. The result is exact: no candidate is cut.

Scale. Only cells, not vectors, are repeated for query blocks: 40 bytes a vector of 64
components. The work is queries times vectors, as the contract's query set is. Of equal vectors
only the k + 1 with the smallest ids can be in a result; others are not entered, and this limit
is applied before the shuffle, so a hot vector is no hot key. The driver sees counts only. Written
files are in the folder all executors share, so a lost executor costs its tasks alone.

Defined results. Rows with a null id or vector, or with null or non-finite components (also
after scaling), take no part; zero and empty vectors do. Vectors of different lengths have no
inner product and are not each other's candidates. Rows that share a vec_id count once, with the
smallest of their vectors. Equal scores: smaller vec_id. Fewer candidates than k: all of them. A
score beyond 64 bits is the nearest long. An empty table gives an empty result. Extra columns are
not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import parts, saved, table
from maskloom.llm.whole_vectors import dots, first_copies, matrix, row_dots, whole

K, EVERY, SCALE = 20, 20, 64
BITS = 5
VECTOR_BLOCK, QUERY_BLOCK, STRIP = 8192, 2048, 128
#: Kept candidates of a lane that leave as output when they are more.
PORTION = 1 << 20
_FILE = "dim int, block long, ids binary, cells binary, least binary, largest binary"
_CANDIDATES = "query_id long, vec_id long, upper double"


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed cell numbers of each vector; least and largest value of each dimension's cells."""
    n, dim = vectors.shape
    count = 1 << BITS
    ordered = np.sort(vectors, axis=0)
    starts = ordered[(np.arange(count) * n) // count]
    cells = np.empty((n, dim), np.uint8)
    least, largest = np.zeros((count, dim)), np.zeros((count, dim))
    for d in range(dim):
        edges = np.unique(starts[:, d])
        cells[:, d] = np.searchsorted(edges, vectors[:, d], "right") - 1
        least[: len(edges), d] = edges
        largest[: len(edges), d] = ordered[np.append(np.searchsorted(ordered[:, d], edges[1:]), n) - 1, d]
    planes = (cells[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(n, dim * BITS), axis=1), least, largest


def cells_of(packed: np.ndarray, dim: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1, count=dim * BITS).reshape(len(packed), dim, BITS)
    return (planes << np.arange(BITS, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def score_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of each query with vectors between low and high.

    With whole numbers below 2**51 in all, both are exact; beyond, they are widened by what rounding can do.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(queries)
        middle, half = queries @ (low + high).T, size @ (high - low).T
        reach = size @ np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0.0)
        slack = np.where(reach < 2.0**50, 0.0, reach * 2.0**-30)[:, None]
        lower, upper = (middle - half) / 2 - slack, (middle + half) / 2 + slack
    return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)


class Scan:
    """One block of queries against a stream of approximation blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = np.full((len(ids), k), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for first in range(0, len(self.ids), STRIP):
            strip = slice(first, first + STRIP)
            lower, upper = score_bounds(self.queries[strip], low, high)
            own = self.ids[strip][:, None] == ids[None, :]
            lower[own] = -np.inf
            both = np.concatenate([self.best[strip], lower], axis=1)
            self.best[strip] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            at, vector = np.nonzero((upper >= self.best[strip].min(axis=1)[:, None]) & ~own)
            self.kept.append((at + first, ids[vector], upper[at, vector]))
            self.size += len(at)

    def candidates(self) -> pa.RecordBatch:
        """What still reaches the k-th least score; the lane goes on with its thresholds alone."""
        at, ids, upper = (np.concatenate(x) for x in zip(*self.kept)) if self.kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        reach = upper >= self.best.min(axis=1)[at] if len(at) else np.zeros(0, bool)
        self.kept, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at[reach]]), pa.array(ids[reach]), pa.array(upper[reach])], ["query_id", "vec_id", "upper"])


def _file(rows: pa.Table) -> pa.Table:
    ids = rows.column("vec_id").to_numpy().astype(np.int64)
    dim = rows.column("dim")[0].as_py()
    packed, least, largest = approximate(matrix(rows.column("v"), dim))
    head = [pa.array([dim], pa.int32()), pa.array([rows.column("block")[0].as_py()], pa.int64())]
    return pa.table([*head, *[pa.array([x.tobytes()], pa.binary()) for x in (ids, packed, least, largest)]], names=["dim", "block", "ids", "cells", "least", "largest"])


def _queries(rows: pa.Table) -> pa.Table:
    ids = rows.column("vec_id").to_numpy().astype(np.int64)
    dim = rows.column("dim")[0].as_py()
    none = pa.array([None], pa.binary())
    head = [pa.array([dim], pa.int32()), pa.array([rows.column("block")[0].as_py()], pa.int64())]
    return pa.table([*head, *[pa.array([x.tobytes()], pa.binary()) for x in (ids, matrix(rows.column("v"), dim))], none, none], names=["dim", "block", "ids", "cells", "least", "largest"])


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q, lane, block, ids, cells, least, largest = (batch.column(c)[i] for c in range(8))
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                dim = dim.as_py()
                if block.as_py() < 0:
                    if scan is not None:
                        yield scan.candidates()
                    key = (dim, q.as_py(), lane.as_py())
                    scan = Scan(ids, np.frombuffer(cells.as_buffer(), np.float64).reshape(len(ids), dim), k)
                    continue
                if scan is None or key != (dim, q.as_py(), lane.as_py()):
                    continue  # no query of this length
                number = cells_of(np.frombuffer(cells.as_buffer(), np.uint8).reshape(len(ids), -1), dim)
                low, high = (np.take_along_axis(np.frombuffer(x.as_buffer(), np.float64).reshape(1 << BITS, dim), number, axis=0) for x in (least, largest))
                scan.meet(ids, low, high)
                if scan.size > PORTION:
                    yield scan.candidates()
        if scan is not None:
            yield scan.candidates()

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = pc.list_value_length(batch.column("q")).to_numpy(zero_copy_only=False)
        score = np.zeros(batch.num_rows, np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            score[at] = row_dots(*(matrix(batch.column(c).take(pa.array(at)), int(dim)) for c in ("q", "v")))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])


def candidates(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, upper): all that can be among a query's k best, by the approximation files."""
    spark = vectors.sparkSession

    def blocks(frame: DataFrame, size: int, build) -> tuple[DataFrame, int]:
        n = max(1, -(-frame.count() // size))
        dealt = frame.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "v")
        return saved(dealt.groupBy("dim", "block").applyInArrow(build, _FILE)), n

    index, _ = blocks(vectors, VECTOR_BLOCK, _file)
    asked, n = blocks(queries, QUERY_BLOCK, _queries)
    lanes = max(1, -(-parts(spark) // n))
    rest = ["ids", "cells", "least", "largest"]
    left = asked.select("dim", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("block"), *rest)
    right = index.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("q"), F.pmod(F.col("block"), F.lit(lanes)).cast("int").alias("lane"), "block", *rest)
    stream = left.unionByName(right).repartition(n * lanes, "dim", "q", "lane").sortWithinPartitions("dim", "q", "lane", "block")
    return saved(stream.mapInArrow(_scan(k), _CANDIDATES))


def search(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best; queries are the rows whose vec_id is divisible by ``every``."""
    vectors = saved(whole(rows.select("vec_id", "embedding"), scale))
    queries = vectors.where(F.col("vec_id") % every == 0)
    entered = saved(first_copies(vectors, ["v"], k + 1))
    left = candidates(entered, queries, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found, state, portion = None, None, k
    while True:
        near = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
        if state is not None:
            after = (F.col("upper") < F.col("last")) | ((F.col("upper") == F.col("last")) & (F.col("vec_id") > F.col("last_id")))
            reach = (F.col("n") < k) | (F.col("upper") >= F.col("kth"))
            left = left.join(state, "query_id").where(after & reach).select("query_id", "vec_id", "upper")
        now = left.withColumn("place", F.row_number().over(near)).where(F.col("place") <= portion)
        now = saved(now.select("query_id", "vec_id", "upper"))
        if now.isEmpty():
            break
        pairs = now.join(entered, "vec_id").join(asked, "query_id").select("query_id", "vec_id", "q", "v")
        fresh = pairs.mapInArrow(_scores, "query_id long, vec_id long, score long")
        pool = fresh if found is None else found.select("query_id", "vec_id", "score").unionByName(fresh)
        found = saved(pool.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k))
        last = now.groupBy("query_id").agg(F.min("upper").alias("last"), F.max_by("vec_id", F.struct(-F.col("upper"), F.col("vec_id"))).alias("last_id"))
        kth = found.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n"))
        state = last.join(kth, "query_id")
        portion *= 4
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


def op11_approximation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = f"""
with fine as (
    select vec_id, min(list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    group by vec_id
), scored as (
    select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
    from fine q join fine c on q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
