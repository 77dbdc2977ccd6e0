"""The vault on shared storage: append-only segments, one per batch.

``<path>/segments/generation=G/batch_id=N`` holds the rows batch N added. A batch
overwrites only its own segment, so running it again changes nothing; it reads the
segments before its own, so a replay sees the vault it saw the first time. Clearing
starts a new generation. Nothing is ever rewritten in place.

With a key, real values and surrogates are stored as AES-256-GCM (nonce, ciphertext,
tag) and an HMAC index of each lets joins work on the encrypted table: lookups join the
indexes of the values asked for and decrypt the rows they hit, no others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions.surrogates import hmac_hex
from maskloom.operators.vault import VAULT, empty_vault, find_real, find_surrogate, forward
from maskloom.policy import hmac_pads
from maskloom.runtime import materialize

SEALED = (
    "entity_type string, real_sealed binary, surrogate_sealed binary, real_index string, surrogate_index string, "
    "seq long, derived boolean"
)


def _key_table(spark: SparkSession, types: list[str], key: str) -> DataFrame:
    inner, outer = hmac_pads(key)
    n = len(types)
    columns = {
        "entity_type": pa.array(types, pa.string()),
        "seal_key": pa.array([bytes.fromhex(key)] * n, pa.binary()),
        "inner_pad": pa.array([inner] * n, pa.binary()),
        "outer_pad": pa.array([outer] * n, pa.binary()),
    }
    return F.broadcast(spark.createDataFrame(pa.table(columns)))


def _types(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select("entity_type").distinct().collect()]


def seal(rows: DataFrame, key: str) -> DataFrame:
    """Encrypt the value columns of vault rows. ``key``: 32 bytes as hex."""
    keyed = rows.join(_key_table(rows.sparkSession, _types(rows), key), "entity_type")

    def sealed(name):
        return F.aes_encrypt(F.encode(F.col(name), "UTF-8"), F.col("seal_key"), F.lit("GCM"))

    return keyed.select(
        "entity_type",
        sealed("real_value").alias("real_sealed"),
        sealed("surrogate").alias("surrogate_sealed"),
        hmac_hex(F.lower("real_value")).alias("real_index"),
        hmac_hex(F.lower("surrogate")).alias("surrogate_index"),
        "seq",
        "derived",
    )


def unseal(rows: DataFrame, key: str) -> DataFrame:
    """Decrypt; a wrong key or a changed byte fails the job."""
    keyed = rows.join(_key_table(rows.sparkSession, _types(rows), key), "entity_type")

    def opened(name):
        return F.decode(F.aes_decrypt(F.col(name), F.col("seal_key"), F.lit("GCM")), "UTF-8")

    return keyed.select(
        "entity_type", opened("real_sealed").alias("real_value"), opened("surrogate_sealed").alias("surrogate"), "seq", "derived"
    )


def blind_index(values: DataFrame, column: str, name: str, key: str) -> DataFrame:
    """The indexes, as stored with sealed rows, of the distinct values of a column in any letter case."""
    asked = values.select(F.lit("").alias("entity_type"), F.lower(column).alias("value")).where("value is not null").distinct()
    return asked.join(_key_table(values.sparkSession, [""], key), "entity_type").select(hmac_hex(F.col("value")).alias(name))


class VaultStore:
    """A vault in segments, one a writer and batch, so that writers never touch each other's files."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, writer: str = "main"):
        self.spark, self.path, self.key, self.writer = spark, path.rstrip("/"), key, writer

    def _generation(self) -> int:
        try:
            marks = self.spark.read.schema("generation int").parquet(f"{self.path}/generations")
            return marks.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]
        except AnalysisException:
            return 0

    def read(self, before: int | None = None) -> DataFrame:
        """Everything committed, or of this writer only what its batches before ``before`` committed."""
        rows = self._segments()
        if rows is None:
            return empty_vault(self.spark)
        if before is not None:
            rows = rows.where((F.col("writer") != self.writer) | (F.col("batch_id") < before))
        rows = rows.drop("generation", "writer", "batch_id")
        return rows if self.key is None else unseal(rows, self.key)

    def _segments(self) -> DataFrame | None:
        layout = VAULT if self.key is None else SEALED
        try:
            rows = self.spark.read.schema(f"{layout}, generation int, writer string, batch_id long").parquet(f"{self.path}/segments")
        except AnalysisException:
            return None
        return rows.where(F.col("generation") == self._generation())

    def find_surrogate(self, rows: DataFrame, out: str = "surrogate") -> DataFrame:
        """``vault.find_surrogate`` on the store."""
        return find_surrogate(rows, self._answering(rows, "real_value", ("real_index",)), out)

    def find_real(self, rows: DataFrame, out: str = "real_value") -> DataFrame:
        """``vault.find_real`` on the store."""
        return find_real(rows, self._answering(rows, "surrogate", ("surrogate_index", "real_index")), out)

    def _answering(self, rows: DataFrame, column: str, indexes: tuple[str, ...]) -> DataFrame:
        """Vault rows that can answer for ``column`` of ``rows``; of a sealed store only these are opened.

        Found by the first index; by each further one come the rows that share it with a found
        one, as a value written again later no longer stands for its first surrogate. What is
        checkpointed here is sealed.
        """
        stored = self._segments()
        if self.key is None or stored is None:
            return self.read()
        asked = blind_index(rows, column, indexes[0], self.key)
        found = stored.join(asked, indexes[0], "left_semi")
        for index in indexes[1:]:
            found = stored.join(materialize(found.select(index).distinct()), index, "left_semi")
        return unseal(materialize(found.drop("generation", "writer", "batch_id")), self.key)

    def conflicts(self) -> DataFrame:
        """Surrogates that writers gave to different values: (surrogate, real_values)."""
        held = self.read().groupBy(F.lower("surrogate").alias("surrogate")).agg(F.collect_set(F.lower("real_value")).alias("real_values"))
        return held.where(F.size("real_values") > 1)

    def write(self, batch_id: int, rows: DataFrame) -> None:
        out = rows.select("entity_type", "real_value", "surrogate", "seq", "derived")
        if self.key is not None:
            out = seal(out, self.key)
        target = f"{self.path}/segments/generation={self._generation()}/writer={self.writer}/batch_id={batch_id}"
        out.write.mode("overwrite").parquet(target)

    def clear(self) -> None:
        self._start(self._generation() + 1)

    def compact(self) -> None:
        """Rewrite the last-writer view as batch -1 of a new generation."""
        view = forward(self.read())
        fresh = self._generation() + 1
        out = view if self.key is None else seal(view, self.key)
        out.write.mode("overwrite").parquet(f"{self.path}/segments/generation={fresh}/writer={self.writer}/batch_id=-1")
        self._start(fresh)

    def _start(self, generation: int) -> None:
        mark = self.spark.createDataFrame(pa.table({"generation": pa.array([generation], pa.int32())}))
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
