"""Compaction: which batches are dead under tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.read import incarnations


def states(wal: DataFrame) -> DataFrame:
    """aggregate_id, state, floor, delete_seq of each aggregate with a row.

    A delete that no batch follows: deleted. One that a batch follows: recreated (after delete_seq; the floors of trims are forgotten, as
    they are of other versions). No delete, but a trim: trimmed (to the floor of the last one). Otherwise alive.
    """
    batch, trim = F.col("kind") == "event_batch", F.col("kind") == "soft_trim"
    rows = wal.groupBy("aggregate_id").agg(
        F.max(F.when(F.col("kind") == "soft_delete", F.col("wal_seq"))).alias("delete_seq"),
        F.max(F.when(batch, F.col("wal_seq"))).alias("last_batch"),
        F.max_by("keep_from", F.when(trim, F.col("wal_seq"))).alias("floor"),
    )
    deleted = F.col("delete_seq").isNotNull()
    state = F.when(deleted & (F.coalesce("last_batch", F.lit(0)) < F.col("delete_seq")), "deleted").when(deleted, "recreated").when(F.col("floor").isNotNull(), "trimmed").otherwise("alive")
    return rows.select("aggregate_id", state.alias("state"), F.when(~deleted, F.col("floor")).alias("floor"), "delete_seq").withColumn("floor", F.coalesce("floor", F.lit(0)))


def marked(wal: DataFrame, continued: bool = False) -> DataFrame:
    """wal with `keep`. Tombstones stay. A batch goes if its aggregate is deleted, if it was written before the delete after which its aggregate was made
    anew, or if its version is below the floor of a trimmed aggregate.

    continued: batches before a delete with continuation, which are readable again, stay as well.
    Only aggregates with a tombstone are joined: their states are few rows against the log's.
    """
    tombs = wal.where("kind <> 'event_batch'").select("aggregate_id").distinct()
    of = states(wal.join(tombs, "aggregate_id", "left_semi")).withColumnsRenamed({"floor": "__floor", "delete_seq": "__delete", "state": "__state"})
    if continued:
        of = of.join(incarnations(wal).select("aggregate_id", F.col("start").alias("__start")), "aggregate_id", "left").withColumn("__delete", F.col("__start")).drop("__start")
    rows = wal.join(of, "aggregate_id", "left")
    dead = (F.col("__state") == "deleted") | (F.col("__state") == "recreated") & (F.col("wal_seq") < F.col("__delete")) | (F.col("aggregate_version") < F.col("__floor"))
    keep = (F.col("kind") != "event_batch") | ~F.coalesce(dead, F.lit(False))
    return rows.withColumn("keep", keep).drop("__floor", "__delete", "__state")


def candidates(wal: DataFrame) -> DataFrame:
    """Segments that hold batches of an aggregate with a tombstone."""
    tombs = wal.where("kind <> 'event_batch'").select("aggregate_id").distinct()
    return wal.where("kind = 'event_batch'").join(tombs, "aggregate_id", "left_semi").groupBy("shard_id", "log_id").agg(F.count(F.lit(1)).alias("batches"))


def reclaimable(wal: DataFrame, percent: int = 20) -> DataFrame:
    """Kept rows and bytes of each segment, and whether at least `percent` of its bytes can go."""
    rows = marked(wal).groupBy("shard_id", "log_id").agg(
        F.count(F.when(F.col("keep"), 1)).alias("kept_rows"), F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("keep"), F.col("size"))), F.lit(0)).alias("kept_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )
    return rows.withColumn("worth", 100 * (F.col("bytes") - F.col("kept_bytes")) >= percent * F.col("bytes"))
