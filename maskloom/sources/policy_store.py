"""The policy as a versioned table, so that a running stream takes up changes between batches.

Each row is a whole policy and the first micro-batch it holds for. A batch that runs again
finds the version it ran under before, whatever was published since.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from maskloom.policy import Policy, policy_from_text, policy_text

VERSIONS = "version long, from_batch long, body string"


class PolicyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self):
        """All versions: (version, from_batch, body)."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], VERSIONS)

    def publish(self, policy: Policy, from_batch: int = 0) -> int:
        """Add a version that holds from micro-batch ``from_batch`` on; returns its number."""
        last = self.versions().agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        row = {"version": [last + 1], "from_batch": [from_batch], "body": [policy_text(policy)]}
        self.spark.createDataFrame(pa.table(row)).coalesce(1).write.mode("append").parquet(self.path)
        return last + 1

    def at(self, batch_id: int) -> Policy:
        """The newest version published for this batch or an earlier one."""
        held = self.versions().where(F.col("from_batch") <= batch_id)
        row = held.agg(F.max_by("body", F.struct("from_batch", "version"))).first()
        if row[0] is None:
            raise LookupError(f"no policy is published for batch {batch_id}")
        return policy_from_text(row[0])
