"""Pipeline over the documents table: quality, line dedup, near dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. ``ORACLE_SQL`` is None: the linear scorer, the keyed
permutations and the tokenizer are not SQL; tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import line_dedup, mixing, near_dedup, packing, quality
from maskloom.llm.common import measured, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are."""
    return quality.classify(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, but for one holder. Rows all of whose lines went stay, with an empty text."""
    docs = docs.select(*COLUMNS)
    done = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    return _documents(done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))))


def row_keys(docs: DataFrame) -> DataFrame:
    """Rows with a ``row_key`` of their own: the doc_id where one row has it, a number no doc_id has for rows
    that share an id or have none."""
    seen = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = measured(saved(seen.where("doc_id is not null and n > 1").select("doc_id")))
    least, most = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    own = docs.where("doc_id is not null").join(shared, "doc_id", "left_anti").withColumn("row_key", F.col("doc_id").cast("long"))
    others = docs.where("doc_id is null").unionByName(docs.join(shared, "doc_id", "left_semi"))
    place = F.monotonically_increasing_id()
    key = F.lit(most) + 1 + place if most < 1 << 61 else F.lit(least) - 1 - place
    return own.unionByName(saved(others.withColumn("row_key", key)))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays (five-word shingles, similarity 0.8), decided for every row.

    Rows that share a doc_id are judged by their own texts, rows without an id take part, of equal
    rows one stays. Rows without words are in no group and stay.
    """
    rows = row_keys(docs.select(*COLUMNS))
    gone = near_dedup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text")).where(~F.col("kept"))
    gone = measured(saved(gone.select(F.col("doc_id").alias("row_key"))))
    return rows.join(gone, "row_key", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each run of words: sources meet their target weights. Rows lie in shards,
    shuffled inside each."""
    return _documents(mixing.shuffled(mixing.mixed_texts(mixing.mix(docs.select(*COLUMNS)))))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("packing", curve_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
