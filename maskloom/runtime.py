"""Session settings, checkpoints and the size-checked join helpers.

Everything that moves big tables goes through three helpers: ``checked_broadcast``
(broadcast only after the side was measured), ``spread_join`` (equi join that salts
the keys found to be hot) and ``materialize`` (reliable checkpoint in the folder the
cluster names in ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_FRACTION = 200  # a key is hot when it holds more than 1/200 of the rows
SALTS = 64
ROW_OVERHEAD = 24


def session(app: str = "maskloom", cores: str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="maskloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep on shared storage, cut the lineage."""
    if getattr(df, "_materialized", False):
        return df
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    done._materialized = True
    return done


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer does not copy what names the partition across filters and projections, while
    plain projections of costly expressions would be repeated in each of them above.
    """
    here = F.spark_partition_id() >= 0  # always
    return df.select("*", *[F.when(here, c).alias(name) for name, c in columns.items()])


SMALL_SCAN = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work on a small table at least one split per core.

    The size is the optimizer's estimate, nothing is run for it. A table above 1 GiB has
    enough splits and is left as it is, so no large table is shuffled here.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if df.isStreaming or size > SMALL_SCAN:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def is_spread(df: DataFrame) -> bool:
    """A checkpointed table, or rows taken from one, with a split per core already."""
    kept = getattr(df, "_rows_of", df)
    if not getattr(kept, "_materialized", False):
        return False
    return kept._jdf.rdd().getNumPartitions() >= kept.sparkSession.sparkContext.defaultParallelism


def rebalanced(df: DataFrame) -> DataFrame:
    """Even partitions for narrow rows that need much CPU each (ciphers, HMACs).

    Adaptive execution would merge them into few partitions because they are few bytes.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism))


def _width(df: DataFrame) -> Column:
    width = F.lit(ROW_OVERHEAD + 8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(F.col(f"`{field.name}`")) * 16, F.lit(0))
    return width


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure the table; true when both its rows and its bytes are under the bound."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df).cast("long")), F.lit(0))).first()
    return n <= rows and total <= size


def checked_broadcast(df: DataFrame, **bound: int) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when measured small, else ``(df, False)``.

    The table is computed once, before it is measured.
    """
    df = materialize(df)
    return (F.broadcast(df), True) if fits_broadcast(df, **bound) else (df, False)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    salt_by: Column | None = None,
) -> DataFrame:
    """Equi join whose left side may have keys holding a large share of its rows.

    ``right`` is broadcast when it is measured small. Beyond the bound the hot keys
    of ``left`` are counted with map-side combine; there can be at most
    ``HOT_FRACTION`` of them, so the hot list itself is always broadcastable. Hot rows
    get a salt, the matching right rows are repeated once per salt, the others keep
    salt 0. No row is dropped on either side. ``how``: inner, left, left_semi, left_anti.
    """
    right = materialize(right)
    small, fits = checked_broadcast(right)
    if fits:
        return left.join(small, keys, how)
    left = materialize(left)
    total = left.count()
    hot = (
        left.groupBy(*keys)
        .count()
        .where(F.col("count") > max(10_000, total // HOT_FRACTION))
        .select(*keys, F.lit(True).alias("__hot"))
    )
    hot = F.broadcast(materialize(hot))
    salt = F.pmod(F.xxhash64(salt_by) if salt_by is not None else F.xxhash64(*left.columns), F.lit(SALTS))
    tagged = left.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), salt.cast("int")).otherwise(F.lit(0))
    ).drop("__hot")
    repeated = right.join(hot, keys, "left").withColumn(
        "__salt",
        F.explode(
            F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ),
    ).drop("__hot")
    return tagged.join(repeated, [*keys, "__salt"], how).drop("__salt")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """0-based rank over the whole table without one big sort partition.

    Range-partition, number inside each partition, add the sizes of the partitions
    before it. Only one count per partition passes through the driver.
    """
    spark = df.sparkSession
    ranged = materialize(
        df.repartitionByRange(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__key", F.struct(*order))
    )
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("__pid").count().collect())
    offsets, total = [], 0
    for pid, n in sizes:
        offsets.append((pid, total))
        total += n
    base = spark.createDataFrame(offsets, "__pid int, __base long")
    inside = Window.partitionBy("__pid").orderBy("__key")
    return (
        ranged.join(F.broadcast(base), "__pid")
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("__base"))
        .drop("__pid", "__key", "__base")
    )
