"""Hard negatives by coordinate pruning over length buckets.

Index. Vectors are put in order of label and falling length and cut into buckets of bounded size.
A bucket holds its vectors as whole numbers, its greatest length and, per coordinate, the list of
its vectors sorted by that coordinate of their direction.

Search. An anchor needs, in a bucket, only vectors whose score reaches its threshold. Divided by
the anchor's and the bucket's greatest length the threshold is a least cosine: above 1 the bucket
is passed over. Else the anchor's ``FOCUS`` largest coordinates each allow a range of values for a
direction within that cosine. The shortest of the sorted lists' ranges gives the candidates, the
other ranges intersect them, and exact scores of what is left decide. Thresholds rise as
better vectors are found.

Two passes. The first finds each anchor's best vectors of its own label (only blocks and buckets
that share a label meet). The second finds, for each positive, the best vectors of other labels
within the band of its score: the threshold is the lowest band's lower end, or the last place of
a full list.

Scale. Anchors go in blocks and meet buckets in a few lanes, each a stream with thresholds as its
only state; a hot label is just more buckets. Of equal vectors with one label only as many as a
list has places (and one more) are entered, by smallest id; that limit is applied before the
shuffle. The work is anchors times vectors at worst, as the contract's anchor set is. Buckets are
made of ranks in a range-partitioned order; the driver sees one count a partition.

Defined results. Rows with a null id, label or vector, or with null or non-finite components (also
after scaling), take no part; zero vectors do. Vectors of different lengths do not meet. Rows
that share a vec_id count once, with the smallest (label, vector). Equal scores: smaller vec_id.
A negative positive_score has an empty band. Scores beyond 64 bits are the nearest long. An empty
table gives an empty result. Extra columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import parts, saved, table
from maskloom.llm.whole_vectors import dots, first_copies, matrix, whole
from maskloom.runtime import global_rank

EVERY, SCALE = 100, 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100
BUCKET, ANCHOR_BLOCK, FOCUS = 8192, 512, 4
_BLOCK = "dim int, block long, ids binary, labels binary, kind string, vectors binary, more binary"
_NO_SCORE = -(2**63)


def narrow(vectors: np.ndarray) -> tuple[str, bytes]:
    """The vectors in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0.0)
    kind = "int8" if most < 2**7 else "int16" if most < 2**15 else "int32" if most < 2**31 else "float64"
    return kind, vectors.astype(kind).tobytes()


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    largest = np.maximum(np.abs(vectors).max(axis=1, initial=0.0), 1.0)
    scaled = vectors / largest[:, None]
    size = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(size > 0, size, 1.0)[:, None], size * largest


class Bucket:
    """Vectors with, per coordinate, their order by that coordinate of their direction."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray):
        self.ids, self.labels, self.vectors, self.order = ids, labels, vectors, order
        self.units, lengths = directions(vectors)
        self.longest = float(lengths.max(initial=0.0))
        self.sorted = np.take_along_axis(self.units.T, order, axis=1) if len(ids) else self.units.T

    def candidates(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more with the anchor; None: all may."""
        if least <= 0:
            return None
        reach = length * self.longest
        cosine = least / reach * (1 - 1e-9) if reach > 0 else np.inf
        if cosine > 1:
            return np.zeros(0, np.int64)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        angle, own = np.arccos(cosine), np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(own + angle, np.pi)) - 1e-9
        high = np.cos(np.maximum(own - angle, 0.0)) + 1e-9
        lists = [(np.searchsorted(self.sorted[f], a, "left"), np.searchsorted(self.sorted[f], b, "right")) for f, a, b in zip(focus, low, high)]
        if not lists:
            return None
        first = int(np.argmin([b - a for a, b in lists]))
        rows = self.order[focus[first], lists[first][0] : lists[first][1]].astype(np.int64)
        for i, f in enumerate(focus):
            if i != first and lists[i][1] - lists[i][0] < len(self.ids):
                value = self.units[rows, f]
                rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their exact scores."""
        if rows is None:
            rows = np.arange(len(self.ids))
            return rows, dots(anchor[None], self.vectors)[0]
        return rows, dots(anchor[None], self.vectors[rows])[0]


class Best:
    """The places of one list: best score first, then smaller id."""

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def enter(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > 4 * self.size:
            reach = scores >= np.partition(scores, len(scores) - self.size)[-self.size]
            scores, ids = scores[reach], ids[reach]
        first = np.lexsort((ids, ~scores))[: self.size]  # ~ turns the order without overflow
        self.scores, self.ids = scores[first], ids[first]

    def least(self, otherwise: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.size else otherwise


class Positives:
    """A block of anchors that looks for the best vectors of each anchor's own label."""

    columns = ["anchor_id", "score", "vec_id"]

    def __init__(self, ids, labels, vectors, more, places: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.units, self.lengths = directions(vectors)
        self.lists = [Best(places) for _ in ids]

    def meet(self, bucket: Bucket) -> None:
        for i in np.flatnonzero(np.isin(self.labels, np.unique(bucket.labels))):
            least = self.lists[i].least(_NO_SCORE)
            rows, scores = bucket.scores(self.vectors[i], bucket.candidates(self.units[i], self.lengths[i], least))
            fit = (bucket.labels[rows] == self.labels[i]) & (bucket.ids[rows] != self.ids[i]) & (scores >= least)
            if fit.any():
                self.lists[i].enter(scores[fit], bucket.ids[rows[fit]])

    def found(self) -> pa.RecordBatch:
        sizes = [len(x.ids) for x in self.lists]
        each = [np.repeat(self.ids, sizes), *(np.concatenate([getattr(x, c) for x in self.lists]) for c in ("scores", "ids"))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in each], self.columns)


class Negatives:
    """A block of anchors with their positives' scores that looks for other labels' vectors within each band."""

    columns = ["anchor_id", "positive_score", "score", "vec_id"]

    def __init__(self, ids, labels, vectors, more, places: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.units, self.lengths = directions(vectors)
        self.bands: list[list[tuple[int, int, int, Best]]] = []
        for row in np.frombuffer(more, np.int64).reshape(len(ids), -1) if len(ids) else []:
            ends = [(p, -(-LOW * p // 100), HIGH * p // 100) for p in sorted({int(x) for x in row if x >= 0})]
            self.bands.append([(p, max(low, _NO_SCORE), min(high, 2**63 - 1), Best(places)) for p, low, high in ends])

    def meet(self, bucket: Bucket) -> None:
        there = np.unique(bucket.labels)
        for i, bands in enumerate(self.bands):
            if not bands or (len(there) == 1 and there[0] == self.labels[i]):
                continue
            least = min(best.least(low) for _, low, _, best in bands)
            rows, scores = bucket.scores(self.vectors[i], bucket.candidates(self.units[i], self.lengths[i], least))
            fit = (bucket.labels[rows] != self.labels[i]) & (scores >= least)
            scores, ids = scores[fit], bucket.ids[rows[fit]]
            for _, low, high, best in bands:
                inside = (scores >= best.least(low)) & (scores <= high)
                if inside.any():
                    best.enter(scores[inside], ids[inside])

    def found(self) -> pa.RecordBatch:
        each: list[list[np.ndarray]] = [[], [], [], []]
        for i, bands in enumerate(self.bands):
            for p, _, _, best in bands:
                for column, x in zip(each, (np.full(len(best.ids), self.ids[i]), np.full(len(best.ids), p), best.scores, best.ids)):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in each], self.columns)


def _packed(rows: pa.Table, dim: int, vectors: np.ndarray, more: bytes | None) -> pa.Table:
    ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    kind, data = narrow(vectors)
    values = [pa.array([dim], pa.int32()), pa.array([rows.column("block")[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels)), pa.array([kind]), pa.array([data], pa.binary()), pa.array([more], pa.binary())]
    return pa.table(values, names=["dim", "block", "ids", "labels", "kind", "vectors", "more"])


def _bucket(rows: pa.Table) -> pa.Table:
    dim = rows.column("dim")[0].as_py()
    vectors = matrix(rows.column("v"), dim)
    order = np.argsort(directions(vectors)[0].T, axis=1, kind="stable")
    return _packed(rows, dim, vectors, order.astype(np.uint16).tobytes())


def _anchors(rows: pa.Table) -> pa.Table:
    dim = rows.column("dim")[0].as_py()
    more = rows.column("positives").combine_chunks().flatten().to_numpy().astype(np.int64).tobytes() if "positives" in rows.column_names else None
    return _packed(rows, dim, matrix(rows.column("v"), dim), more)


def _searched(kind: type, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q, lane, block = (batch.column(c)[i].as_py() for c in range(4))
                ids, labels = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (4, 5))
                vectors = np.frombuffer(batch.column(7)[i].as_buffer(), batch.column(6)[i].as_py()).reshape(len(ids), dim).astype(np.float64)
                more = batch.column(8)[i].as_buffer() if batch.column(8)[i].is_valid else None
                if block < 0:
                    if anchors is not None:
                        yield anchors.found()
                    anchors, key = kind(ids, labels, vectors, more, places), (dim, q, lane)
                elif key == (dim, q, lane):
                    anchors.meet(Bucket(ids, labels, vectors, np.frombuffer(more, np.uint16).reshape(dim, len(ids))))
        if anchors is not None:
            yield anchors.found()

    return run


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows with the number of their block, in order of component count, label and falling length; a block has one component count."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    ranked = global_rank(rows.withColumn("dim", F.size("v")).withColumn("square", -length), [F.col("dim"), F.col("label"), F.col("square"), F.col("vec_id")])
    return ranked.withColumn("block", F.floor(F.col("rank") / size)).drop("rank", "square")


def _lanes(asked: DataFrame, buckets: DataFrame, pairs: DataFrame | None, kind: type, places: int) -> DataFrame:
    """Anchor blocks against the buckets they are paired with (None: all of their dimension)."""
    n = max(1, asked.count())
    lanes = max(1, -(-parts(asked.sparkSession) // n))
    rest = ["ids", "labels", "kind", "vectors", "more"]
    left = asked.select("dim", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("block"), *rest)
    if pairs is None:
        pairs = buckets.select("dim", "block").join(F.broadcast(asked.select("dim", F.col("block").alias("q"))) if n <= 10_000 else asked.select("dim", F.col("block").alias("q")), "dim")
    right = pairs.join(buckets, ["dim", "block"]).select("dim", "q", F.pmod(F.col("block"), F.lit(lanes)).cast("int").alias("lane"), "block", *rest)
    stream = left.unionByName(right).repartition(n * lanes, "dim", "q", "lane").sortWithinPartitions("dim", "q", "lane", "block")
    schema = ", ".join(f"{c} long" for c in kind.columns)
    return saved(stream.mapInArrow(_searched(kind, places), schema))


def mine(rows: DataFrame, every: int = EVERY, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose vec_id is divisible by ``every``."""
    given = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    vectors = saved(whole(given, scale, ("label",)))
    entered = saved(_dealt(first_copies(vectors, ["label", "v"], max(positives + 1, negatives)), BUCKET))
    anchors = saved(_dealt(vectors.where(F.col("vec_id") % every == 0), ANCHOR_BLOCK))
    buckets = saved(entered.groupBy("dim", "block").applyInArrow(_bucket, _BLOCK))
    asked = saved(anchors.groupBy("dim", "block").applyInArrow(_anchors, _BLOCK))

    alike = entered.select("dim", "block", "label").distinct()
    meets = anchors.select("dim", F.col("block").alias("q"), "label").distinct().join(alike, ["dim", "label"]).select("dim", "q", "block").distinct()
    nearest = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = _lanes(asked, buckets, meets, Positives, positives)
    best = saved(best.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives))
    best = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    scores = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("found"))
    padded = F.slice(F.concat("found", F.array_repeat(F.lit(-1).cast("long"), positives)), 1, positives)
    again = anchors.join(scores, "vec_id").select("dim", "block", "vec_id", "label", "v", padded.alias("positives"))
    asked = saved(again.groupBy("dim", "block").applyInArrow(_anchors, _BLOCK))
    hard = _lanes(asked, buckets, None, Negatives, negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = best.join(hard, ["anchor_id", "positive_score"]).withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")))


SQL = f"""
with fine as (
    select vec_id, min({{'label': (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint, 'v': list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint)}}) as r
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    group by vec_id
), scored as (
    select a.vec_id as anchor_id, c.vec_id, a.r.label = c.r.label as alike,
           coalesce(list_sum(list_transform(list_zip(a.r.v, c.r.v), lambda p: p[1] * p[2])), 0)::bigint as score
    from fine a join fine c on a.vec_id % {EVERY} = 0 and a.vec_id <> c.vec_id and len(a.r.v) = len(c.r.v)
), positive as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}
), banded as (
    select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
           row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
    from positive p join scored s on p.anchor_id = s.anchor_id and not s.alike
      and {LOW} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from banded where rank <= {NEGATIVES}
"""
