"""Structured Streaming: masking, demasking, audit.

The vault is the only state. Each micro-batch reads the segments of the batches before
it, masks with the batch plan and writes its own segment and its own output folder, both
named by ``batch_id``; a batch that runs again overwrites exactly what it wrote before.
The policy is read anew for each batch; from a ``PolicyStore`` a batch gets its own version, also
when it runs again. Rows that other writers of the vault have committed are seen from the next batch on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskloom.operators import audit, demask
from maskloom.plans.mask import mask
from maskloom.policy import Policy
from maskloom.runtime import materialize
from maskloom.sources.policy_store import PolicyStore
from maskloom.sources.vault_store import VaultStore


def policy_of(policy: Callable[[], Policy] | PolicyStore, batch_id: int) -> Policy:
    """The policy of a batch: what the versioned table has for it, or what the function gives now."""
    return policy.at(batch_id) if isinstance(policy, PolicyStore) else policy()


def mask_batch(store: VaultStore, policy: Callable[[], Policy] | PolicyStore, key: str, keys: list[str], out: str, **options):
    """The ``foreachBatch`` function of ``mask_stream``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        docs = materialize(batch)
        done = mask(docs, keys, policy_of(policy, batch_id), key, store.read(before=batch_id), **options)
        store.write(batch_id, done.added)
        done.documents.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return run


def mask_stream(
    stream: DataFrame, store: VaultStore, policy: Callable[[], Policy] | PolicyStore, key: str, keys: list[str], out: str, checkpoint: str, **options
) -> DataStreamWriter:
    """Mask a stream of ``(keys, text)``. Each writer of a vault has a store with a name of its own."""
    run = mask_batch(store, policy, key, keys, out, **options)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def demask_stream(
    stream: DataFrame, store: VaultStore, policy: Callable[[], Policy] | PolicyStore, keys: list[str], out: str, checkpoint: str
) -> DataStreamWriter:
    """Demap a stream of arguments against the vault as it is at each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        docs = materialize(batch)
        done = demask.demap(docs, keys, policy_of(policy, batch_id), store.read())
        done.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def audit_events(stream: DataFrame, body: str = "body") -> DataFrame:
    return audit.ingest(stream, body)


def running_counts(events: DataFrame) -> DataFrame:
    """Events so far per entity type, tool and server, as ``(kind, name, n)``."""
    named = F.concat(
        F.transform("entity_types", lambda e: F.struct(F.lit("entity_type").alias("kind"), e.alias("name"))),
        F.array(
            F.struct(F.lit("tool_name").alias("kind"), F.col("tool_name").alias("name")),
            F.struct(F.lit("server").alias("kind"), F.col("server").alias("name")),
        ),
    )
    rows = events.select(F.explode(named).alias("x")).select("x.*").where(F.col("name") != "")
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
