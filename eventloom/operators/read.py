"""Filtered, ordered, paginated reads of the log.

A filter has two parts: a condition on a batch's columns that Parquet statistics can prune by (it holds wherever
an event may qualify), and a condition on each event of the nested array. Batches left without events go.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import errors
from eventloom.plans.model import KEY, SHARDS

BATCH_COLUMNS = (*KEY, "aggregate_version", "wal_seq", "server_timestamp", "client_id", "user_id", "size")


@dataclass(frozen=True)
class ReadFilters:
    """Bounds are inclusive; None doesn't filter, nor does an empty list of event types. A version of 0 is 1."""

    from_version: int = 1
    to_version: int | None = None
    min_server_timestamp: int | None = None
    max_server_timestamp: int | None = None
    include_client: int | None = None
    exclude_client: int | None = None
    include_user: int | None = None
    exclude_user: int | None = None
    min_client_seq: int | None = None
    max_client_seq: int | None = None
    min_event_timestamp: int | None = None
    max_event_timestamp: int | None = None
    min_event_seq: int | None = None
    max_event_seq: int | None = None
    event_types: Sequence[int] = field(default_factory=tuple)

    def versions(self, low: int, high: int | None = None) -> ReadFilters:
        return replace(self, from_version=low, to_version=high)

    def server_time(self, low: int | None, high: int | None) -> ReadFilters:
        return replace(self, min_server_timestamp=low, max_server_timestamp=high)

    def client_seq(self, low: int | None, high: int | None) -> ReadFilters:
        return replace(self, min_client_seq=low, max_client_seq=high)

    def event_time(self, low: int | None, high: int | None) -> ReadFilters:
        return replace(self, min_event_timestamp=low, max_event_timestamp=high)

    def event_seq(self, low: int | None, high: int | None) -> ReadFilters:
        return replace(self, min_event_seq=low, max_event_seq=high)

    def types(self, types: Sequence[int]) -> ReadFilters:
        return replace(self, event_types=tuple(types))

    def on_batch(self) -> Column:
        """What a batch must satisfy for any of its events to qualify."""
        c, out = F.col, [F.col("aggregate_version") >= max(1, self.from_version)]
        add = lambda value, make: out.append(make(value)) if value is not None else None
        add(self.to_version, lambda v: c("aggregate_version") <= v)
        add(self.min_server_timestamp, lambda v: c("server_timestamp") >= v)
        add(self.max_server_timestamp, lambda v: c("server_timestamp") <= v)
        add(self.include_client, lambda v: c("client_id") == v)
        add(self.exclude_client, lambda v: c("client_id") != v)
        add(self.include_user, lambda v: c("user_id").eqNullSafe(v))
        add(self.exclude_user, lambda v: ~c("user_id").eqNullSafe(v))
        for name in ("client_seq", "event_timestamp", "event_seq"):
            add(getattr(self, f"min_{name}"), lambda v, n=name: c(f"max_{n}") >= v)
            add(getattr(self, f"max_{name}"), lambda v, n=name: c(f"min_{n}") <= v)
        if self.event_types:
            out.append(F.arrays_overlap("event_types", F.array(*[F.lit(int(t)).cast("long") for t in self.event_types])))
        return reduce(lambda a, b: a & b, out)

    def on_event(self, event: Column) -> Column | None:
        out = []
        for name in ("client_seq", "event_timestamp", "event_seq"):
            low, high = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if low is not None:
                out.append(event[name] >= low)
            if high is not None:
                out.append(event[name] <= high)
        if self.event_types:
            out.append(event["event_type_major"].isin(*[int(t) for t in self.event_types]))
        return reduce(lambda a, b: a & b, out) if out else None


def visible(wal: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows up to each shard's read cursor; manifest: shard_id, visible_seq (one row a shard)."""
    return wal.join(F.broadcast(manifest.select("shard_id", "visible_seq")), "shard_id").where("wal_seq <= visible_seq").drop("visible_seq")


def of_aggregate(wal: DataFrame, aggregate_id: int, shards: int = SHARDS) -> DataFrame:
    """Rows of one aggregate; the shard's predicate follows from the key, so partitions are pruned."""
    return wal.where((F.col("shard_id") == aggregate_id % shards) & (F.col("aggregate_id") == aggregate_id))


def incarnations(wal: DataFrame) -> DataFrame:
    """aggregate_id, delete_seq (the last), deleted (no batch since), start: where the last incarnation begins (the last delete without continuation that a batch follows, or 0). One row for each aggregate with a delete: few against the log's."""
    deletes = wal.where("kind = 'soft_delete'").select("aggregate_id", "wal_seq", "allow_continuation")
    last = wal.where("kind = 'event_batch'").join(deletes.select("aggregate_id").distinct(), "aggregate_id", "left_semi").groupBy("aggregate_id").agg(F.max("wal_seq").alias("last_batch"))
    fresh = F.when(~F.coalesce("allow_continuation", F.lit(False)) & (F.col("wal_seq") < F.col("last_batch")), F.col("wal_seq"))
    return deletes.join(last, "aggregate_id", "left").groupBy("aggregate_id").agg(
        F.max("wal_seq").alias("delete_seq"), (F.coalesce(F.max("last_batch"), F.lit(0)) < F.max("wal_seq")).alias("deleted"), F.coalesce(F.max(fresh), F.lit(0)).alias("start"),
    )


def _since_start(wal: DataFrame) -> DataFrame:
    """wal without rows of earlier incarnations, and __deleted."""
    known = incarnations(wal).select("aggregate_id", F.col("start").alias("__start"), F.col("deleted").alias("__deleted"))
    return wal.join(known, "aggregate_id", "left").where(F.col("wal_seq") > F.coalesce("__start", F.lit(0))).drop("__start")


def live(wal: DataFrame) -> DataFrame:
    """Batches that can be read: none of a deleted aggregate; of one that was made anew, those after the delete; with continuation, those before it too."""
    return _since_start(wal).where((F.col("kind") == "event_batch") & ~F.coalesce("__deleted", F.lit(False))).select(wal.columns)


def read(wal: DataFrame, filters: ReadFilters = ReadFilters()) -> DataFrame:
    """Readable event batches with the events that qualify; the filter on batches is applied before the few deletes are joined."""
    return _kept(live(wal), filters)


def batches(wal: DataFrame, filters: ReadFilters = ReadFilters()) -> DataFrame:
    """All event batches of the log, dead ones too, with the events that qualify."""
    return _kept(wal, filters)


def _kept(wal: DataFrame, filters: ReadFilters) -> DataFrame:
    rows = wal.where((F.col("kind") == "event_batch") & filters.on_batch())
    if filters.on_event(F.struct(F.lit(0).alias("x"), *[F.lit(0).alias(n) for n in ("client_seq", "event_timestamp", "event_seq", "event_type_major")])) is not None:
        rows = rows.withColumn("events", F.filter("events", filters.on_event)).where(F.size("events") > 0)
    return rows.select(*BATCH_COLUMNS, "events")


def flatten(batches: DataFrame, keep: Sequence[str] = (*KEY, "aggregate_version")) -> DataFrame:
    """One row an event, in array order within its batch."""
    return batches.select(*keep, F.inline("events"))


def page(batches: DataFrame, budget: int) -> DataFrame:
    """Batches of each aggregate up to `budget` bytes in order of version, and next_version to go on from (null at the end)."""
    order = Window.partitionBy("aggregate_id").orderBy("aggregate_version")
    sized = batches.withColumn("running", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cursor = F.min(F.when(F.col("running") > budget, F.col("aggregate_version"))).over(Window.partitionBy("aggregate_id"))
    return sized.withColumn("next_version", cursor).where(F.col("running") <= budget).drop("running")


def floors(wal: DataFrame) -> DataFrame:
    """aggregate_id, floor: the highest trim of each aggregate's last incarnation."""
    start = incarnations(wal).select("aggregate_id", "start")
    trims = wal.where("kind = 'soft_trim'").join(start, "aggregate_id", "left").where(F.col("wal_seq") > F.coalesce("start", F.lit(0)))
    return trims.groupBy("aggregate_id").agg(F.max("keep_from").alias("floor"))


def above_floor(batches: DataFrame, floor: DataFrame) -> DataFrame:
    """batches without what is below the floor (aggregate_id, floor) of their aggregate."""
    return batches.join(floor.select("aggregate_id", F.col("floor").alias("__floor")), "aggregate_id", "left").where(F.col("aggregate_version") >= F.coalesce("__floor", F.lit(0))).select(batches.columns)


def latest_trim(wal: DataFrame) -> DataFrame:
    """aggregate_id, keep_from, wal_seq of the last trim of each aggregate."""
    return wal.where("kind = 'soft_trim'").groupBy("aggregate_id").agg(F.max_by("keep_from", "wal_seq").alias("keep_from"), F.max("wal_seq").alias("wal_seq"))


def recreated(wal: DataFrame, continued: bool) -> DataFrame:
    """Readable batches of aggregates that were written again after a delete with (or without) continuation."""
    last = wal.where("kind = 'soft_delete'").groupBy("aggregate_id").agg(F.max_by(F.coalesce("allow_continuation", F.lit(False)), "wal_seq").alias("__continued"))
    return live(wal).join(last.where(F.col("__continued") == continued).select("aggregate_id"), "aggregate_id", "left_semi")


def deletion(wal: DataFrame) -> DataFrame:
    """aggregate_id, is_deleted, was_deleted of each aggregate with a batch or a delete."""
    rows = wal.where("kind <> 'soft_trim'")
    return rows.groupBy("aggregate_id").agg((F.max_by("kind", "wal_seq") == "soft_delete").alias("is_deleted"), F.bool_or(F.col("kind") == "soft_delete").alias("was_deleted"))


def state(wal: DataFrame) -> DataFrame:
    """Latest state of each aggregate, of its last incarnation: versions, sequences, deletion, floor, last writer."""
    wal = _since_start(wal)
    batch, delete = F.col("kind") == "event_batch", F.col("kind") == "soft_delete"
    newest = F.max_by(F.struct("client_id", "user_id", "server_timestamp"), F.when(batch, F.col("wal_seq")))
    last = F.max_by(F.struct("kind", "allow_recreate", "allow_continuation"), F.when(batch | delete, F.col("wal_seq")))
    return wal.groupBy(*KEY).agg(
        F.min(F.when(batch, F.col("aggregate_version"))).alias("first_version"),
        F.max(F.when(batch, F.col("aggregate_version"))).alias("max_version"),
        F.max("max_event_seq").alias("max_event_seq"),
        F.coalesce(F.max("keep_from"), F.lit(0)).alias("floor"),
        last.alias("last"), newest.alias("newest"), F.max("wal_seq").alias("last_wal_seq"),
    ).select(
        *KEY, F.greatest("first_version", "floor").alias("min_version"), "max_version", "max_event_seq", (F.col("last")["kind"] == "soft_delete").alias("is_deleted"),
        F.coalesce(F.col("last")["allow_recreate"], F.lit(False)).alias("allow_recreate"), F.coalesce(F.col("last")["allow_continuation"], F.lit(False)).alias("allow_continuation"),
        F.col("newest")["client_id"].alias("last_client_id"), F.col("newest")["user_id"].alias("last_user_id"), F.col("newest")["server_timestamp"].alias("last_timestamp"), "last_wal_seq",
    )


def guarded(wal: DataFrame, aggregate_id: int, filters: ReadFilters = ReadFilters()) -> DataFrame:
    """read() of one aggregate; raises for what is missing, deleted or below the floor."""
    own = of_aggregate(wal, aggregate_id)
    details = state(own).first()
    if details is None or details["is_deleted"]:
        raise errors.LogError(errors.NOT_READABLE, f"aggregate {aggregate_id} isn't readable")
    floor = (floors(own).first() or {"floor": 0})["floor"]
    if max(1, filters.from_version) < floor:
        raise errors.UnavailableVersion(filters.from_version, floor)
    return read(own, filters).orderBy("aggregate_version")


def answers(wal: DataFrame, from_version: int = 1) -> DataFrame:
    """aggregate_id, code, floor: what a read of each aggregate from a version answers, as guarded() does for one: 0, or the code of the error."""
    known = wal.select("aggregate_id").distinct().join(incarnations(wal).select("aggregate_id", "deleted"), "aggregate_id", "left").join(floors(wal), "aggregate_id", "left")
    floor = F.coalesce("floor", F.lit(0))
    code = F.when(F.coalesce("deleted", F.lit(False)), errors.NOT_READABLE).when(floor > max(1, from_version), errors.UNAVAILABLE_VERSION).otherwise(0)
    return known.select("aggregate_id", code.alias("code"), floor.alias("floor"))


def details(wal: DataFrame, aggregate_id: int) -> DataFrame:
    """state() of one aggregate, also a deleted one; raises for one that never was."""
    out = state(of_aggregate(wal, aggregate_id))
    if out.isEmpty():
        raise errors.LogError(errors.UNKNOWN_AGGREGATE, f"aggregate {aggregate_id} is unknown")
    return out


def read_all(wal: DataFrame, aggregate_id: int, budget: int):
    """Pages of one aggregate, one DataFrame each, until the cursor ends; a batch over the budget makes a page of its own."""
    start = 1
    own = of_aggregate(wal, aggregate_id)
    while start is not None:
        rest = read(own, ReadFilters(from_version=start))
        got = page(rest, budget)
        cursor = got.agg(F.max("aggregate_version"), F.max("next_version"), F.count(F.lit(1))).first()
        if cursor[2] == 0:
            first = rest.agg(F.min("aggregate_version")).first()[0]
            if first is None:
                return
            yield rest.where(F.col("aggregate_version") == first)
            start = first + 1
        else:
            yield got.orderBy("aggregate_version")
            start = cursor[1]


def with_payloads(wal: DataFrame, filters: ReadFilters = ReadFilters()) -> DataFrame:
    """read() in two steps: batches are picked by their metadata alone, then the payloads of those picked are fetched by position. Worth it where few batches of a log with large payloads are wanted."""
    picked = live(wal.select([c for c in wal.columns if c != "events"])).where(filters.on_batch()).select("shard_id", "log_id", "wal_seq")
    return _kept(wal.join(picked, ["shard_id", "log_id", "wal_seq"], "left_semi"), filters)


def fetched(wal: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at the given positions (shard_id, wal_seq), each once."""
    return wal.join(positions.select("shard_id", "wal_seq").distinct(), ["shard_id", "wal_seq"], "left_semi")


def union_recent(recent: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches of recent writes (in memory) and of the store, one of each aggregate and version; of two, the recent one. Both hold few or equal rows of a version, so they meet by one aggregation."""
    columns = recent.columns
    both = recent.withColumn("__old", F.lit(0)).unionByName(stored.select(columns).withColumn("__old", F.lit(1)))
    rest = [c for c in columns if c not in (*KEY, "aggregate_version")]
    return both.groupBy(*KEY, "aggregate_version").agg(F.min_by(F.struct(*rest), "__old").alias("__x")).select(*KEY, "aggregate_version", "__x.*").select(columns)
