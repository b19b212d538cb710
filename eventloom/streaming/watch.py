"""Watch: a live feed of changes, merged for each aggregate and operation, and streaming projections."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import errors

MAX_LATENCY_MS = 2000
#: Subscribers at a time, changes that wait for one of them, seconds without a change after which it gets a heartbeat.
MOST_SUBSCRIBERS, MOST_WAITING, IDLE_SECONDS = 16_384, 10_000, 5.0
RANKS = {"create": 0, "write": 1, "delete": 2, "trim": 3}


def changes(wal: DataFrame) -> DataFrame:
    """One row a change: key, op, from_version, to_version, keep_from, wal_seq. A first version is also a creation."""
    batch = F.col("kind") == "event_batch"
    ops = F.array_compact(F.array(F.when(batch & (F.col("aggregate_version") == 1), "create"), F.when(batch, "write"), F.when(F.col("kind") == "soft_delete", "delete"), F.when(F.col("kind") == "soft_trim", "trim")))
    return wal.select("shard_id", "org_id", "aggregate_type_id", "aggregate_id", "wal_seq", F.explode(ops).alias("op"), F.col("aggregate_version").alias("from_version"), F.col("aggregate_version").alias("to_version"), "keep_from")


def filtered(rows: DataFrame, orgs: Sequence[int] | None = None, types: Sequence[int] | None = None, aggregates: Sequence[int] | None = None, ops: Sequence[str] | None = None) -> DataFrame:
    """Conditions of different kinds must all hold; None lets all pass."""
    for column, values in (("org_id", orgs), ("aggregate_type_id", types), ("aggregate_id", aggregates), ("op", ops)):
        if values is not None:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def merged(rows: DataFrame, *more: str, last_trim: bool = True) -> DataFrame:
    """Changes of an aggregate and operation (and value of `more`) as one, with the range of versions and the last (or first) trim."""
    trim = F.max_by if last_trim else F.min_by
    return rows.groupBy(*more, "org_id", "aggregate_type_id", "aggregate_id", "op").agg(
        F.min("from_version").alias("from_version"), F.max("to_version").alias("to_version"), trim("keep_from", "wal_seq").alias("keep_from"), F.max("wal_seq").alias("last_seq"),
    )


def commit_order(rows: DataFrame) -> DataFrame:
    """merged rows in the order in which a commit announces them."""
    rank = F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in RANKS.items()])
    return rows.withColumn("rank", rank).orderBy("aggregate_id", "rank")


def feed(spark: SparkSession, path: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, visible: dict[int, int] | None = None, latency_ms: int | None = None, files: int | None = None, **conditions):
    """Starts a stream of merged changes below `path`; sink(rows, batch number) gets each micro-batch.

    visible: what was there when the subscription began, which isn't replayed. Without latency_ms all that is there is
    handled once. The sink may see a batch again after a failure; (aggregate, op, from, to) tells doubles.
    """
    if latency_ms is not None and latency_ms > MAX_LATENCY_MS:
        raise errors.LogError(errors.LATENCY_TOO_LONG, f"{latency_ms} ms")
    source = spark.readStream.schema(schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    rows = source.parquet(path)
    if visible:
        seen = F.coalesce(*[F.when(F.col("shard_id") == k, F.lit(v)) for k, v in visible.items()], F.lit(0))
        rows = rows.where(F.col("wal_seq") > seen)
    wanted = filtered(changes(rows), **conditions)
    writer = wanted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(merged(df), n))
    return (writer.trigger(availableNow=True) if latency_ms is None else writer.trigger(processingTime=f"{latency_ms} milliseconds")).start()


def collected(spark: SparkSession, path: str, schema, out: str, **more) -> DataFrame:
    """Runs a feed to the end of what is there into `out`, and gives the merge of all its batches."""
    query = feed(spark, path, schema, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/changes"), f"{out}/checkpoint-{uuid.uuid4().hex}", **more)
    query.awaitTermination()
    columns = "org_id bigint, aggregate_type_id bigint, aggregate_id bigint, op string, from_version bigint, to_version bigint, keep_from bigint, last_seq bigint"
    rows = spark.read.schema(columns).parquet(f"{out}/changes")
    return merged(rows.withColumnRenamed("last_seq", "wal_seq"))


def projected(spark: SparkSession, path: str, schema, out: str, files: int | None = None) -> DataFrame:
    """A balance for each aggregate kept up by a stream of batches: each micro-batch adds its change with its number, so a repeated one replaces itself."""
    from eventloom.functions.scalars import signed
    from eventloom.plans.model import SIGNS

    source = spark.readStream.schema(schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    events = source.parquet(path).where("kind = 'event_batch'").select("aggregate_id", "aggregate_version", F.inline("events"))

    def sink(df: DataFrame, n: int) -> None:
        change = df.groupBy("aggregate_id").agg(F.sum(signed(F.col("event_type_major"), F.col("amount"), SIGNS)).alias("change"), F.max("aggregate_version").alias("version"))
        change.write.mode("overwrite").parquet(f"{out}/change/batch={n}")

    events.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("aggregate_id bigint, change bigint, version bigint").parquet(f"{out}/change/*")
    return rows.groupBy("aggregate_id").agg(F.sum("change").alias("balance"), F.max("version").alias("last_version"))


def deduplicated(rows: DataFrame, window: str = "90 seconds", time: str = "server_time", key: str = "event_id") -> DataFrame:
    """A stream without repeats of a key inside the window of server time."""
    return rows.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


class Subscribers:
    """Fans a feed's merged changes out to subscribers on the driver: each has its conditions and a queue of bounded length.

    publish() suits the sink of feed(). One that doesn't take its changes until MOST_WAITING wait for it is removed (its take() gives None from then on); one that has
    had nothing for IDLE_SECONDS gets an empty list, the heartbeat. More than MOST_SUBSCRIBERS are refused.
    """

    def __init__(self, most: int = MOST_SUBSCRIBERS, waiting: int = MOST_WAITING, idle: float = IDLE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.most, self.waiting, self.idle, self.clock = most, waiting, idle, clock
        self._next = 0
        self._of: dict[int, dict] = {}

    def __len__(self) -> int:
        return len(self._of)

    def add(self, **conditions: Sequence | None) -> int:
        """The subscriber's number. Conditions as in filtered()."""
        if len(self._of) >= self.most:
            raise errors.LogError(errors.TOO_MANY_SUBSCRIBERS, f"{self.most} subscribers")
        self._next += 1
        columns = {"orgs": "org_id", "types": "aggregate_type_id", "aggregates": "aggregate_id", "ops": "op"}
        wanted = {columns[k]: frozenset(v) for k, v in conditions.items() if v is not None}
        self._of[self._next] = {"wanted": wanted, "queue": deque(), "last": self.clock()}
        return self._next

    def remove(self, number: int) -> None:
        self._of.pop(number, None)

    def publish(self, rows: DataFrame | Iterable, batch: int = 0) -> None:
        """Hands merged changes to all whose conditions they meet; they are streamed to the driver, a partition at a time."""
        for row in rows.toLocalIterator() if isinstance(rows, DataFrame) else rows:
            for number, subscriber in list(self._of.items()):
                if all(row[c] in values for c, values in subscriber["wanted"].items()):
                    if len(subscriber["queue"]) >= self.waiting:
                        self.remove(number)
                    else:
                        subscriber["queue"].append(row)

    def take(self, number: int) -> list | None:
        """What waits for a subscriber, an empty list as a heartbeat, or None: nothing yet, or no longer subscribed (number not in)."""
        subscriber = self._of.get(number)
        if subscriber is None:
            return None
        now = self.clock()
        if not subscriber["queue"] and now - subscriber["last"] < self.idle:
            return None
        out = list(subscriber["queue"])
        subscriber["queue"].clear()
        subscriber["last"] = now
        return out

    def __contains__(self, number: int) -> bool:
        return number in self._of
