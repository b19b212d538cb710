"""Write decisions: a sequential fold of requests over the state of a shard, and the log rows that follow.

A request has one item or more, each on another aggregate, and is accepted or rejected as a whole: if one item fails, none changes anything,
and all carry the code of the first that fails (by aggregate). Requests with items on several shards are rejected before (9001).

Requests are decided in order, as each may depend on those before it (versions, idempotency floors, tombstones). Aggregates that only
requests with a single item touch don't depend on one another, and each is a stream of its own; those that requests with several items touch are one
stream for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import errors
from eventloom.plans import model
from eventloom.plans.model import SHARDS
from eventloom.sources.shipping import ship

SCHEMA = "shard_id bigint, request_id bigint, aggregate_id bigint, op string, accepted boolean, code int, aggregate_version bigint, event_seq bigint"
#: An item: write, trim or delete. valid: its payloads fit their schemas. idempotent: the client's sequence is enforced. durable_upto: requests up to this are known to be durable (null: all before).
#: Items `state` and `client` (request -1) carry what a log holds already.
ITEM_SCHEMA = (
    "request_id bigint, op string, aggregate_id bigint, client_id bigint, first_client_seq bigint, n_events bigint, min_type bigint, valid boolean, idempotent boolean, allow_create boolean, "
    "expected_version bigint, keep_from bigint, allow_recreate boolean, allow_continuation boolean, durable_upto bigint"
)
_NAMES = [c.strip().split(" ")[0] for c in ITEM_SCHEMA.split(",")]


class Aggregate:
    """clients: the last sequence of each, the request that wrote it and the version that it made."""

    __slots__ = ("version", "event_seq", "exists", "deleted", "may_recreate", "continues", "floor", "clients")

    def __init__(self):
        self.version = self.event_seq = self.floor = 0
        self.exists = self.deleted = self.continues = False
        self.may_recreate = True
        self.clients: dict[int, tuple[int, int, int]] = {}


def _missing(value) -> bool:
    return value is None or pd.isna(value)


def _refused(a: Aggregate, c) -> int:
    """The code of the first condition that an item doesn't meet; 0 if it can be applied."""
    if c.op == "write":
        if c.n_events <= 0:
            return errors.EMPTY_WRITE
        if c.min_type == 0:
            return errors.ZERO_EVENT_TYPE
        if not a.exists and not c.allow_create:
            return errors.MISSING
        if a.deleted and not a.may_recreate:
            return errors.DELETED
        if not _missing(c.expected_version) and int(c.expected_version) != (0 if a.deleted and not a.continues else a.version):
            return errors.VERSION_CONFLICT
        last = a.clients.get(c.client_id)
        if c.idempotent and last and c.first_client_seq <= last[0]:
            return errors.REPLAYED if _missing(c.durable_upto) or last[1] <= c.durable_upto else errors.IN_FLIGHT
        return 0 if c.valid else errors.PAYLOAD_INVALID
    if c.op == "trim":
        if not a.exists or a.deleted:
            return errors.TRIM_MISSING
        return errors.TRIM_OUT_OF_RANGE if c.keep_from > a.version else 0
    if not a.exists or a.deleted:
        return errors.DELETE_MISSING
    return errors.DELETE_CONFLICT if not _missing(c.expected_version) and int(c.expected_version) != a.version else 0


def _apply(a: Aggregate, c) -> None:
    if c.op == "write":
        if a.deleted:
            if not a.continues:
                a.version = a.event_seq = a.floor = 0
            a.deleted = False
        a.exists = True
        # a client that comes back after a new beginning goes on past its own last version
        last = a.clients.get(c.client_id, (0, 0, 0))
        a.version = max(a.version, last[2]) + 1
        a.event_seq += int(c.n_events)
        a.clients[c.client_id] = max(last[0], int(c.first_client_seq + c.n_events - 1)), int(c.request_id), a.version
    elif c.op == "trim":
        a.floor = max(a.floor, int(c.keep_from))
    elif c.op == "delete":
        a.deleted, a.may_recreate, a.continues = True, bool(c.allow_recreate), bool(c.allow_continuation)
    elif c.op == "state":
        a.exists, a.version, a.event_seq, a.floor = True, int(c.expected_version), int(c.n_events), int(c.keep_from)
        a.deleted, a.may_recreate, a.continues = not c.valid, bool(c.allow_recreate) or bool(c.valid), bool(c.allow_continuation)
    else:  # client
        a.clients[c.client_id] = int(c.first_client_seq), -1, int(c.expected_version)


def crossing(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """request_id, shards, code of requests with items on more than one shard."""
    found = items.where("request_id >= 0").groupBy("request_id").agg(F.count_distinct(F.pmod("aggregate_id", F.lit(shards))).alias("shards"))
    return found.where("shards > 1").withColumn("code", F.lit(errors.SEVERAL_SHARDS))


def known(log: DataFrame) -> DataFrame:
    """Items that carry the state of a log into decisions(): one for each aggregate, and one for each of its clients.

    Floors of clients outlive deletes; versions of clients are those of the whole log.
    """
    from eventloom.operators.read import state

    none = {"min_type": "bigint", "idempotent": "boolean", "allow_create": "boolean", "durable_upto": "bigint"}
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in none.items()]
    of_aggregate = state(log).where("max_version IS NOT NULL").select(
        F.lit(-1).cast("long").alias("request_id"), F.lit("state").alias("op"), "aggregate_id", F.lit(-1).cast("long").alias("client_id"), F.lit(0).cast("long").alias("first_client_seq"), F.col("max_event_seq").alias("n_events"), (~F.col("is_deleted")).alias("valid"),
        F.col("max_version").alias("expected_version"), F.lit(0).cast("long").alias("keep_from"), "allow_recreate", "allow_continuation", *empty,
    )
    clients = log.where("kind = 'event_batch'").groupBy("aggregate_id", "client_id").agg(F.max("max_client_seq").alias("first_client_seq"), F.max("aggregate_version").alias("expected_version"))
    of_client = clients.select(
        F.lit(-1).cast("long").alias("request_id"), F.lit("client").alias("op"), "aggregate_id", "client_id", "first_client_seq", F.lit(0).cast("long").alias("n_events"), F.lit(True).alias("valid"),
        "expected_version", F.lit(0).cast("long").alias("keep_from"), F.lit(True).alias("allow_recreate"), F.lit(True).alias("allow_continuation"), *empty,
    )
    return of_aggregate.unionByName(of_client).select(*_NAMES)


def decisions(items: DataFrame, state: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """SCHEMA for each item (ITEM_SCHEMA); state: what known() gives of the log that the requests are made to. A stream's requests go through one task in order, a batch at a time."""
    ship(items.sparkSession)
    shard = F.pmod("aggregate_id", F.lit(shards)).cast("long")
    # requests with several items are few; they are joined to the items, which are aggregated before that shuffle
    several = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n"), (F.min(shard) != F.max(shard)).alias("__across")).where("__n > 1")
    marked = items.select(*_NAMES).join(several, "request_id", "left")
    out = marked.where("__across").select(
        shard.alias("shard_id"), "request_id", "aggregate_id", "op", F.lit(False).alias("accepted"), F.lit(errors.SEVERAL_SHARDS).alias("code"), F.lit(None).cast("long").alias("aggregate_version"), F.lit(None).cast("long").alias("event_seq"),
    )
    within = marked.where("NOT coalesce(__across, false)")
    tied = within.where("__n IS NOT NULL").select("aggregate_id").distinct().withColumn("tied", F.lit(True))
    within = within.select(*_NAMES)
    if state is not None:
        within = within.unionByName(state.select(*_NAMES))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aggregates: dict[int, Aggregate] = {}
        lane, request, held = None, None, []

        def decided() -> list[tuple]:
            every = [aggregates.get(c.aggregate_id) or Aggregate() for c in held]
            if held[0].request_id < 0:
                for a, c in zip(every, held, strict=True):
                    _apply(aggregates.setdefault(c.aggregate_id, a), c)
                return []
            code = next((x for x in map(_refused, every, held) if x), 0)
            if not code:
                for a, c in zip(every, held, strict=True):
                    _apply(a, c)
                    aggregates[c.aggregate_id] = a
            return [(c.shard_id, c.request_id, c.aggregate_id, c.op, code == 0, code, a.version, a.event_seq) for a, c in zip(every, held, strict=True)]

        for frame in frames:
            rows = []
            for c in frame.itertuples(index=False):
                if held and ((c.shard_id, c.lane) != lane or c.request_id != request or c.request_id < 0):
                    rows += decided()
                    held = []
                if (c.shard_id, c.lane) != lane:
                    aggregates = {}
                lane, request = (c.shard_id, c.lane), c.request_id
                held.append(c)
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])
        if held:
            yield pd.DataFrame(decided(), columns=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])

    lane = F.when(F.coalesce("tied", F.lit(False)), F.lit(-1).cast("long")).otherwise(F.col("aggregate_id"))
    placed = within.join(tied, "aggregate_id", "left").select(shard.alias("shard_id"), lane.alias("lane"), *_NAMES)
    ordered = placed.repartition("shard_id", "lane").sortWithinPartitions("shard_id", "lane", "request_id", "aggregate_id", F.desc("op"))  # state before client
    return ordered.mapInPandas(fold, SCHEMA).unionByName(out)


def log_rows(decided: DataFrame, content: DataFrame, after: DataFrame | None = None, segment: int = model.SEGMENT, bucket: int = 100_000) -> DataFrame:
    """The rows that accepted items add to the log, in the order of their requests, numbered on from `after` (shard_id, wal_seq: the last of each shard; none: from 1).

    content: request_id, aggregate_id and what a row of the log has besides (org_id, aggregate_type_id, client_id, user_id, server_timestamp, lease_epoch, node_id, keep_from, allow_recreate, allow_continuation, size,
    events without sequences of their own: event_seq is set here).
    """
    rows = decided.where("accepted").select("shard_id", "request_id", "aggregate_id", "op", "aggregate_version", "event_seq").join(content.drop("op", "shard_id"), ["request_id", "aggregate_id"])
    kind = F.when(F.col("op") == "write", "event_batch").when(F.col("op") == "delete", "soft_delete").otherwise("soft_trim")
    first = F.col("event_seq") - F.size("events") + 1
    events = F.when(F.col("op") == "write", F.transform("events", lambda e, i: e.withField("event_seq", (first + i).cast("long"))))
    numbered = model.numbered(rows.withColumn("kind", kind).withColumn("events", events), "wal_seq", ["shard_id"], F.floor(F.col("request_id") / bucket), [F.col("request_id"), F.col("aggregate_id")])
    if after is not None:
        numbered = numbered.join(after.select("shard_id", F.col("wal_seq").alias("__last")), "shard_id", "left").withColumn("wal_seq", F.col("wal_seq") + F.coalesce("__last", F.lit(0))).drop("__last")
    done = numbered.withColumn("log_id", F.floor((F.col("wal_seq") - 1) / segment).cast("long") + 1).drop("request_id", "op", "event_seq")
    return model.batch_metadata(done.where("kind = 'event_batch'")).unionByName(done.where("kind <> 'event_batch'"), allowMissingColumns=True)


def upsert(current: DataFrame, changes: DataFrame, key: str = "aggregate_id", version: str = "last_version") -> DataFrame:
    """The rows of both with the highest version of each key; of equal versions, the current one; an empty name keeps the old."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    columns = [c for c in current.columns if c not in (key, "name", "expires_at")]
    best = F.max_by(F.struct(*columns), F.struct(F.col(version), -F.col("__new")))
    named = F.max_by("name", F.when(F.col("name") != "", F.struct(F.col(version), -F.col("__new"))))
    out = both.groupBy(key).agg(best.alias("__best"), named.alias("name"), F.max("expires_at").alias("expires_at"))
    return out.select(key, "__best.*", F.coalesce("name", F.lit("")).alias("name"), "expires_at")
