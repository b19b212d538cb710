"""Read models: folds of events into balances and projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalars import signed
from eventloom.plans.model import SIGNS


def balances(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_id").agg(F.sum(signed(F.col("event_type_major"), F.col("amount"), SIGNS)).alias("balance"))


def projection(events: DataFrame, own_client: int, upto: int | None = None) -> DataFrame:
    """Balance, last version and the highest sequence of the projection's own client; as of a version if given."""
    rows = events if upto is None else events.where(F.col("aggregate_version") <= upto)
    return rows.groupBy("aggregate_id").agg(
        F.sum(signed(F.col("event_type_major"), F.col("amount"), SIGNS)).alias("balance"), F.max("aggregate_version").alias("last_version"),
        F.coalesce(F.max(F.when(F.col("client_id") == own_client, F.col("client_seq"))), F.lit(0)).alias("last_client_seq"),
    )


def running(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("aggregate_id").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("balance", F.sum(signed(F.col("event_type_major"), F.col("amount"), SIGNS)).over(order))


def advance(stored: DataFrame, events: DataFrame) -> DataFrame:
    """stored (aggregate_id, balance, last_version) moved on by the events after its version."""
    new = events.join(stored.select("aggregate_id", F.col("last_version").alias("__seen")), "aggregate_id", "left").where(F.col("aggregate_version") > F.coalesce("__seen", F.lit(0)))
    change = new.groupBy("aggregate_id").agg(F.sum(signed(F.col("event_type_major"), F.col("amount"), SIGNS)).alias("change"), F.max("aggregate_version").alias("version"))
    return stored.join(change, "aggregate_id", "full").select("aggregate_id", (F.coalesce("balance", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("balance"), F.coalesce("version", "last_version").alias("last_version"))


def fold(events: DataFrame, schema: str, step: Callable[[dict | None, dict], dict], order: str = "event_seq") -> DataFrame:
    """A fold of each aggregate's events in order by a Python function of (state, event); the last state is the row.

    Aggregates are streamed through sorted partitions, so an aggregate of any length is folded in constant memory.
    """
    import pandas as pd

    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        key, state = None, None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if key is not None and row["aggregate_id"] != key:
                    out.append(state)
                    state = None
                key = row["aggregate_id"]
                state = step(state, row)
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame([state], columns=names)

    return events.repartition("aggregate_id").sortWithinPartitions("aggregate_id", order).mapInPandas(run, schema)
