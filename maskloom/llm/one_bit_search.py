"""Nearest neighbours by inner product over randomly rotated one-bit codes, reranked exactly.

Index. Vectors are taken relative to the mean of all, rotated by a fixed random rotation, and
each coordinate's sign is kept: one packed bit per dimension. Two scalars per vector correct the
estimate: the length of the centred vector, and the inner product of its direction with its own
code. Query coordinates are rounded to eight bits, so an estimate is eight ANDs and bit counts.

Search. The estimate errs by at most ``EPSILON`` standard deviations of the random rotation
(plus the rounding of the query) but for a chance of about one in 30 000. A task finds each
query's k best estimates, takes their exact inner products, and reranks every vector of its
block whose upper bound reaches the k-th of them. No cap is set on how many those are.

Scale. Vectors and queries are packed into blocks of bounded size; each pair of a vector block
and a query block is one row, found by an equi-join on both block numbers. Blocks are the same
size whatever the vectors are, so there is no hot list. The work is queries times vectors, as
the contract's query set is; nothing is broadcast but the mean, the driver sees counts and it.

Defined results. Rows with a null id, and vectors that are null, zero, hold null or non-finite
components or have another length than most, take no part. Rows with one vec_id count once,
with the smallest of their vectors. Equal scores: smaller vec_id first. Fewer candidates than k:
all of them. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import saved, table

K, EVERY = 20, 20
EPSILON = 4.0
VECTOR_BLOCK, QUERY_BLOCK, STRIP = 8192, 2048, 128
SEED = 7
_BLOCK = "block long, ids binary, vectors binary, codes binary, scalars binary"


def rotation(dim: int) -> np.ndarray:
    """dim columns of a random rotation in the next multiple of 64 dimensions."""
    padded = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((padded, padded)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, and per vector: length when centred, inner product of direction and code."""
    turned = (vectors - mean) @ turn
    length = np.sqrt((turned * turned).sum(axis=1))
    codes = np.packbits(turned > 0, axis=1).view(np.uint64)
    own = np.abs(turned).sum(axis=1) / (np.maximum(length, 1e-300) * np.sqrt(turned.shape[1]))
    return codes, np.stack([length, np.where(length > 0, own, 1.0)], axis=1)


def bounds(queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors), and how far they may be off."""
    turned = queries @ turn
    dim = turned.shape[1]
    low, high = turned.min(axis=1), turned.max(axis=1)
    unit = np.maximum(high - low, 1e-300) / 255
    whole = np.rint((turned - low[:, None]) / unit[:, None]).clip(0, 255).astype(np.uint8)
    set_bits = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    dots = np.zeros((len(queries), len(codes)), np.int32)
    for plane in range(8):
        packed = np.packbits((whole >> plane) & 1, axis=1).view(np.uint64)
        for word in range(codes.shape[1]):
            dots += np.bitwise_count(packed[:, word, None] & codes[None, :, word]).astype(np.int32) << plane
    # Sum over dimensions of (2 bit - 1) * (low + unit * whole), by the code's length.
    total = 2 * unit[:, None] * dots + 2 * low[:, None] * set_bits - (unit * whole.sum(axis=1, dtype=np.int64) + dim * low)[:, None]
    length, own = scalars[:, 0], scalars[:, 1]
    estimate = (queries @ mean)[:, None] + total * (length / (own * np.sqrt(dim)))
    size = np.sqrt((turned * turned).sum(axis=1))
    spread = length * np.sqrt(np.maximum(1 - own * own, 0)) / (own * np.sqrt(max(dim - 1, 1)))
    rounding = length * np.sqrt(dim) / own
    return estimate, EPSILON * size[:, None] * spread + 0.5 * unit[:, None] * rounding + 1e-9 * (1 + np.abs(estimate))


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(axis=1)


def search_block(query_ids, queries, ids, vectors, codes, scalars, mean, turn, k: int):
    """Of one block: (query, vector, score) of each query's k best, all exact."""
    out: tuple[list, list, list] = ([], [], [])
    for first in range(0, len(queries), STRIP):
        strip = queries[first : first + STRIP]
        estimate, off = bounds(strip, mean, turn, codes, scalars)
        for i, query in enumerate(strip):
            query_id = query_ids[first + i]
            other = ids != query_id
            guess = np.where(other, estimate[i], -np.inf)
            if len(ids) > k:
                start = np.argpartition(-guess, k)[:k]
                least = np.min(np.where(other[start], exact(query, vectors[start]), -np.inf))
                near = np.flatnonzero((guess + off[i] >= least) & other)
            else:
                near = np.flatnonzero(other)
            scores = exact(query, vectors[near])
            best = np.lexsort((ids[near], -scores))[:k]
            out[0].append(np.full(len(best), query_id))
            out[1].append(ids[near][best])
            out[2].append(scores[best])
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def _blocks(dim: int, mean: list[float]):
    """One row of a block's vectors and their codes; blocks are hashed and so hold about as many rows each."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy().astype(np.int64)
        vectors = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        codes, scalars = encode(vectors, np.array(mean), rotation(dim))
        block = pa.array([rows.column("block")[0].as_py()], pa.int64())
        return pa.table([block, *[pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, scalars)]], names=["block", "ids", "vectors", "codes", "scalars"])

    return run


def _searched(dim: int, mean: list[float], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = np.array(mean), rotation(dim)
        for batch in batches:
            for row in range(batch.num_rows):
                query_ids, queries, ids, vectors, codes, scalars = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.float64, np.int64, np.float64, np.uint64, np.float64)))
                found = search_block(query_ids, queries.reshape(-1, dim), ids, vectors.reshape(-1, dim), codes.reshape(len(ids), -1), scalars.reshape(-1, 2), centre, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(found, (np.int64, np.int64, np.float64))], ["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): one row per id, finite components only, not zero, the commonest length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v.cast("array<double>")).alias("v"))
    return rows


def nearest(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score); queries are the rows whose vec_id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = saved(usable(rows))
    lengths = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    vectors = vectors.where(F.size("v") == dim)
    mean = list(vectors.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(dim)]).first())

    def packed(frame: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-frame.count() // size))
        dealt = frame.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "v")
        return saved(dealt.groupBy("block").applyInArrow(_blocks(dim, mean), _BLOCK)), n

    index, n_index = packed(vectors, VECTOR_BLOCK)
    queries, n_queries = packed(vectors.where(F.col("vec_id") % every == 0), QUERY_BLOCK)
    left = queries.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("b"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    right = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), F.col("block").alias("b"), "ids", "vectors", "codes", "scalars")
    pairs = left.join(right.hint("shuffle_merge"), ["q", "b"]).select("query_ids", "queries", "ids", "vectors", "codes", "scalars")
    found = pairs.mapInArrow(_searched(dim, mean, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
