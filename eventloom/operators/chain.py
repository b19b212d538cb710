"""Hash chains of the log: made in order within a shard, verified in parallel.

A row's tip is SHA-256 of the previous tip and the row's content; the first row follows 32 zero bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64


def content() -> Column:
    return F.concat_ws("|", "kind", F.col("aggregate_id").cast("string"), F.col("aggregate_version").cast("string"), F.col("server_timestamp").cast("string"))


def made(wal: DataFrame) -> DataFrame:
    """shard_id, wal_seq, content, previous_tip, tip. Each tip needs the one before, so a shard is one ordered stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tips: dict[int, str] = {}
        for frame in frames:
            before, after = [], []
            for shard, text in zip(frame["shard_id"], frame["content"], strict=True):
                previous = tips.get(shard, GENESIS)
                tips[shard] = hashlib.sha256((previous + text).encode()).hexdigest()
                before.append(previous)
                after.append(tips[shard])
            yield frame.assign(previous_tip=before, tip=after)

    rows = wal.select("shard_id", "wal_seq", content().alias("content")).repartition("shard_id").sortWithinPartitions("shard_id", "wal_seq")
    return rows.mapInPandas(run, "shard_id bigint, wal_seq bigint, content string, previous_tip string, tip string")


def breaks(chain: DataFrame, genesis: dict[int, tuple[int, str]] | None = None) -> DataFrame:
    """Rows whose previous_tip isn't the tip of the row just before them, which have no such row, or whose tip isn't that of their content.

    A shard's first row must be row 1 after GENESIS, or what `genesis` says of the shard (a chain that begins later: its first sequence, and the tip before it).
    Any task can check any row: its neighbour is found by an equality join.
    """
    before = chain.select("shard_id", (F.col("wal_seq") + 1).alias("wal_seq"), F.col("tip").alias("before"))
    rows = chain.join(before, ["shard_id", "wal_seq"], "left")
    first, tip = F.lit(1).cast("long"), F.lit(GENESIS)
    for shard, (seq, value) in (genesis or {}).items():
        first, tip = F.when(F.col("shard_id") == shard, F.lit(seq)).otherwise(first), F.when(F.col("shard_id") == shard, F.lit(value)).otherwise(tip)
    follows = F.when(F.col("wal_seq") == first, F.col("previous_tip") == tip).otherwise(F.coalesce(F.col("before") == F.col("previous_tip"), F.lit(False)))
    own = F.col("tip") == F.sha2(F.concat("previous_tip", "content"), 256)
    return rows.where(~(follows & own)).select("shard_id", "wal_seq")


def common_ancestor(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """shard_id, ancestor: the last sequence with equal tips in both."""
    return ours.select("shard_id", "wal_seq", "tip").join(theirs.select("shard_id", "wal_seq", "tip"), ["shard_id", "wal_seq", "tip"]).groupBy("shard_id").agg(F.max("wal_seq").alias("ancestor"))


def truncated(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our rows up to the last one that both chains have: what stays when we follow theirs. A shard without a common row keeps nothing; one that they don't have keeps all."""
    known = theirs.select("shard_id").distinct().join(common_ancestor(ours, theirs), "shard_id", "left").select("shard_id", F.coalesce("ancestor", F.lit(0)).alias("__upto"))
    return ours.join(known, "shard_id", "left").where(F.col("__upto").isNull() | (F.col("wal_seq") <= F.col("__upto"))).drop("__upto")


def reconciled(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our chain after catching up with theirs: cut back to the common ancestor, then their rows after it, as far as they follow without a gap or a break."""
    kept = truncated(ours, theirs)
    tips = kept.groupBy("shard_id").agg(F.max("wal_seq").alias("__seq"), F.max_by("tip", "wal_seq").alias("__tip"))
    new = theirs.select(ours.columns).join(tips, "shard_id", "left").where(F.col("wal_seq") > F.coalesce("__seq", F.lit(0)))
    before = theirs.select("shard_id", (F.col("wal_seq") + 1).alias("wal_seq"), F.col("tip").alias("__before"))
    previous = F.when(F.col("wal_seq") == F.coalesce("__seq", F.lit(0)) + 1, F.coalesce("__tip", F.lit(GENESIS))).otherwise(F.col("__before"))
    checked = new.join(before, ["shard_id", "wal_seq"], "left").withColumn("__good", F.coalesce((previous == F.col("previous_tip")) & (F.col("tip") == F.sha2(F.concat("previous_tip", "content"), 256)), F.lit(False)))
    # nothing from the first bad row on; the first row that should follow may be missing, too
    bad = checked.where("NOT __good").groupBy("shard_id").agg(F.min("wal_seq").alias("__stop"))
    return kept.unionByName(checked.join(bad, "shard_id", "left").where(F.col("__stop").isNull() | (F.col("wal_seq") < F.col("__stop"))).select(ours.columns))
