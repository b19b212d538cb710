"""The log model as DataFrames, derived from the `events` table.

    wal(shard_id, log_id, wal_seq, server_timestamp, lease_epoch, node_id, kind, org_id, aggregate_type_id,
        aggregate_id, aggregate_version, client_id, user_id, min/max of client_seq, event_seq and
        event_timestamp, event_types, keep_from, allow_recreate, allow_continuation, size, events)

One row is an event batch, a soft delete or a soft trim. Rows of a shard are numbered by wal_seq without
gaps, batches of an aggregate by aggregate_version, events of an aggregate by event_seq, and events of an
aggregate and client by client_seq.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, SEGMENT = 4, 500
EPOCH_MS, WEEK_MS, DAY_MS = 1_704_067_200_000, 604_800_000, 86_400_000
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: The sign of an event's amount in a balance, by event_type_major; others count nothing.
SIGNS = {3: 1, 4: 1, 2: -1}

KEY = ("org_id", "aggregate_type_id", "aggregate_id")


def numbered(df: DataFrame, name: str, within: Sequence[str], bucket: Column, order: Sequence[Column]) -> DataFrame:
    """df with a number from 1 in `order` within `within`, without bringing a whole group to one task.

    Rows are numbered inside (within, bucket), and what the earlier buckets of the group hold is added;
    bucket must not decrease along the order. The counts are one row a bucket.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*within, "__bucket", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(*order))
    return df.withColumn("__own", own).join(counts, [*within, "__bucket"]).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__bucket")


def log_events(events: DataFrame) -> DataFrame:
    """One row an event, with the keys of its aggregate, client and batch."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    major = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(i)) for i, name in enumerate(EVENT_TYPES, 1)], F.lit(9))
    return events.select(
        "event_id",
        (F.col("user_id") % 4).alias("org_id"),
        (F.col("user_id") % 3).alias("aggregate_type_id"),
        F.col("user_id").alias("aggregate_id"),
        (F.col("event_id") % 5).alias("client_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        major.cast("long").alias("event_type_major"),
        (F.col("event_id") % 2).alias("event_type_minor"),
        ms.alias("event_timestamp"),
        F.floor((ms - EPOCH_MS) / WEEK_MS).cast("long").alias("bucket"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("amount"),
        "props",
    )


def batches(events: DataFrame) -> DataFrame:
    """One row a batch with its events as an array; versions are numbered, and `last` is the aggregate's largest.

    Events are shuffled once, by aggregate and bucket, so that a large aggregate is many tasks: a batch lies within a bucket, and what the
    earlier buckets of an aggregate and of its clients hold is added from a small table of counts.
    """
    e = log_events(events)
    counts = e.groupBy("aggregate_id", "client_id", "bucket", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("aggregate_id", "client_id", "bucket").agg(F.count(F.lit(1)).alias("b"), F.sum("n").alias("n"))
    earlier = lambda value, *within: F.coalesce(F.sum(value).over(Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_client = F.map_from_entries(F.collect_list(F.struct("client_id", "before")))
    before = (
        counts.withColumn("before", earlier("n", "aggregate_id", "client_id"))
        .groupBy("aggregate_id", "bucket").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), by_client.alias("__clients"))
        .select("aggregate_id", "bucket", earlier("b", "aggregate_id").alias("__batches"), earlier("n", "aggregate_id").alias("__events"), "__clients", F.sum("b").over(Window.partitionBy("aggregate_id")).alias("last"))
    )
    event = F.struct("event_id", "event_timestamp", "event_type_major", "event_type_minor", "amount", "props")
    rows = e.repartition("aggregate_id", "bucket").groupBy(*KEY, "client_id", "user_id", "bucket").agg(F.min("event_timestamp").alias("first_ts"), F.min("event_id").alias("first_id"), F.array_sort(F.collect_list(event)).alias("events"))
    in_order = Window.partitionBy("aggregate_id", "bucket").orderBy("first_ts", "first_id")
    of_client = Window.partitionBy("aggregate_id", "bucket", "client_id").orderBy("first_ts", "first_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier_size = lambda window: F.coalesce(F.sum(F.size("events")).over(window), F.lit(0))
    rows = rows.withColumns({"__own": F.row_number().over(in_order), "__sum": earlier_size(in_order.rowsBetween(Window.unboundedPreceding, -1)), "__client": earlier_size(of_client)}).join(before, ["aggregate_id", "bucket"])
    numbered_event = lambda x, i: F.struct(
        (F.col("__events") + F.col("__sum") + i + 1).alias("event_seq"), (F.element_at("__clients", F.col("client_id")) + F.col("__client") + i + 1).alias("client_seq"),
        x["event_id"].alias("event_id"), x["event_timestamp"].alias("event_timestamp"), x["event_type_major"].alias("event_type_major"), x["event_type_minor"].alias("event_type_minor"), x["amount"].alias("amount"), x["props"].alias("props"),
    )
    return rows.select(*KEY, (F.col("__batches") + F.col("__own")).cast("long").alias("aggregate_version"), "client_id", "user_id", "first_ts", "first_id", "last", F.transform("events", numbered_event).alias("events"))


def batch_metadata(rows: DataFrame) -> DataFrame:
    """rows with the smallest and largest of three columns of `events` (0 for no events), and the distinct types."""
    for column in ("client_seq", "event_seq", "event_timestamp"):
        values = F.transform("events", lambda e: e[column])  # noqa: B023
        rows = rows.withColumn(f"min_{column}", F.coalesce(F.array_min(values), F.lit(0))).withColumn(f"max_{column}", F.coalesce(F.array_max(values), F.lit(0)))
    return rows.withColumn("event_types", F.array_distinct(F.transform("events", lambda e: e["event_type_major"])))


def build_wal(events: DataFrame, shards: int = SHARDS, segment: int = SEGMENT) -> DataFrame:
    """The log of `shards` shards in segments of `segment` rows."""
    b = batch_metadata(batches(events))
    a = F.col("aggregate_id")
    is_delete = (a % 11 == 0) & (F.col("aggregate_version") == F.floor((F.col("last") + 1) / 2)) | (a % 17 == 0) & (F.col("aggregate_version") == F.col("last"))
    version, last = F.col("aggregate_version"), F.col("last")
    half = F.floor((last + 1) / 2)
    # at the end of some; before the delete of those deleted half-way; after it of those that may start anew
    is_trim = (a % 13 == 0) & (version == last) | (a % 11 == 0) & (version == F.floor((last + 3) / 4)) | (a % 22 == 11) & (version == last)
    keep_from = F.when((a % 22 == 11) & (version == last), F.least(last, half + 2)).when(version == last, F.floor(last / 2)).otherwise(version)
    # a batch and what follows it at once: exploded from one row, so the batches aren't read again for tombstones
    kinds = F.array_compact(F.array(F.lit("event_batch"), F.when(is_delete, "soft_delete"), F.when(is_trim, "soft_trim")))
    rows = b.select("*", F.explode(kinds).alias("kind"))
    batch, trim, delete = (F.col("kind") == k for k in ("event_batch", "soft_trim", "soft_delete"))
    only = lambda c: F.when(batch, F.col(c)).alias(c)
    rank = F.when(batch, 0).when(delete, 1).otherwise(2)
    rows = rows.select(
        F.pmod("aggregate_id", F.lit(shards)).alias("shard_id"),
        F.col("first_ts").alias("server_timestamp"), "first_id", rank.alias("kind_rank"), "kind", *KEY, "aggregate_version", "client_id", "user_id",
        *(only(c) for c in ("min_client_seq", "max_client_seq", "min_event_seq", "max_event_seq", "min_event_timestamp", "max_event_timestamp", "event_types")),
        F.when(trim, keep_from).cast("long").alias("keep_from"),
        F.when(delete, F.lit(True)).alias("allow_recreate"),
        F.when(delete, a % 2 == 0).alias("allow_continuation"),
        F.when(batch, F.size("events") * 100 + F.col("max_event_seq") % 50).cast("long").alias("size"),
        only("events"),
    )
    order = [F.col("server_timestamp"), F.col("first_id"), F.col("kind_rank")]
    rows = numbered(rows, "wal_seq", ["shard_id"], F.floor((F.col("server_timestamp") - EPOCH_MS) / DAY_MS), order)
    log_id = F.floor((F.col("wal_seq") - 1) / segment).cast("long") + 1
    return rows.withColumn("log_id", log_id).withColumn("lease_epoch", F.floor(F.col("log_id") / 3).cast("long") + 1).withColumn("node_id", F.concat(F.lit("node-"), (F.col("log_id") % 3).cast("string")))


def running(df: DataFrame, name: str, value: Column, within: Sequence[str], bucket: Column, order: Sequence[Column]) -> DataFrame:
    """df with the sum of value up to each row in `order` within `within`, as numbered() does it: inside buckets, with the sums of earlier ones added."""
    df = df.withColumn("__value", value).withColumn("__bucket", bucket)
    sums = df.groupBy(*within, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*within, "__bucket", before.alias("__before"))
    own = F.sum("__value").over(Window.partitionBy(*within, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__own", own).join(sums, [*within, "__bucket"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__bucket", "__value")


def rotated(wal: DataFrame, most_bytes: int, name: str = "log_id", bucket_rows: int = 100_000) -> DataFrame:
    """wal with segments by size: a row goes to the segment in which the bytes before it in its shard fall, so that none has more than most_bytes and one row."""
    size = F.coalesce("size", F.lit(0))
    rows = running(wal, "__bytes", size, ["shard_id"], F.floor(F.col("wal_seq") / bucket_rows), [F.col("wal_seq")])
    return rows.withColumn(name, F.floor((F.col("__bytes") - size) / most_bytes).cast("long") + 1).drop("__bytes")


def restarted(wal: DataFrame) -> DataFrame:
    """The log as writers that count anew would have left it: after the first delete without continuation, versions and event sequences of an aggregate begin at 1 again.

    Only the few aggregates with such a delete are joined.
    """
    cuts = wal.where("kind = 'soft_delete' AND NOT allow_continuation").groupBy("aggregate_id").agg(F.min(F.struct("wal_seq", "aggregate_version")).alias("__cut"))
    before = wal.where("kind = 'event_batch'").join(cuts, "aggregate_id").where("wal_seq < __cut.wal_seq").groupBy("aggregate_id").agg(F.max("max_event_seq").alias("__events"))
    cuts = cuts.join(before, "aggregate_id", "left").select("aggregate_id", F.col("__cut.wal_seq").alias("__from"), F.col("__cut.aggregate_version").alias("__versions"), F.coalesce("__events", F.lit(0)).alias("__events"))
    rows = wal.join(cuts, "aggregate_id", "left")
    after = F.coalesce(F.col("wal_seq") > F.col("__from"), F.lit(False))
    versions, events = F.when(after, F.col("__versions")).otherwise(0), F.when(after, F.col("__events")).otherwise(0)
    moved = {c: F.col(c) - events for c in ("min_event_seq", "max_event_seq")} | {"aggregate_version": F.col("aggregate_version") - versions}
    moved["keep_from"] = F.when(after & F.col("keep_from").isNotNull(), F.greatest(F.col("keep_from") - versions, F.lit(1))).otherwise(F.col("keep_from"))
    moved["events"] = F.transform("events", lambda e: e.withField("event_seq", e["event_seq"] - events))
    return rows.withColumns(moved).select(wal.columns)


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_wal(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same model in DuckDB SQL: log_event, batch, event, wal.
SQL = f"""
WITH log_event AS (
  SELECT event_id, user_id % 4 AS org_id, user_id % 3 AS aggregate_type_id, user_id AS aggregate_id, event_id % 5 AS client_id,
    CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 9 END AS BIGINT) AS event_type_major,
    event_id % 2 AS event_type_minor, epoch_us(ts) // 1000 AS event_timestamp, CAST(floor(((epoch_us(ts) // 1000) - {EPOCH_MS}) / {WEEK_MS}.0) AS BIGINT) AS bucket,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, props
  FROM events
), head AS (
  SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY first_ts, first_id) AS aggregate_version FROM (
    SELECT org_id, aggregate_type_id, aggregate_id, client_id, user_id, bucket, min(event_timestamp) AS first_ts, min(event_id) AS first_id
    FROM log_event GROUP BY ALL)
), event AS (
  SELECT e.*, h.first_ts, h.first_id, h.aggregate_version,
    row_number() OVER (PARTITION BY e.aggregate_id ORDER BY h.aggregate_version, e.event_id) AS event_seq,
    row_number() OVER (PARTITION BY e.aggregate_id, e.client_id ORDER BY h.aggregate_version, e.event_id) AS client_seq
  FROM log_event e JOIN head h ON e.aggregate_id = h.aggregate_id AND e.client_id = h.client_id AND e.user_id IS NOT DISTINCT FROM h.user_id AND e.bucket = h.bucket
), batch AS (
  SELECT org_id, aggregate_type_id, aggregate_id, aggregate_version, client_id, user_id, first_ts, first_id, count(*) AS n_events,
    min(client_seq) AS min_client_seq, max(client_seq) AS max_client_seq, min(event_seq) AS min_event_seq, max(event_seq) AS max_event_seq,
    min(event_timestamp) AS min_event_timestamp, max(event_timestamp) AS max_event_timestamp,
    count(*) * 100 + max(event_seq) % 50 AS size, max(aggregate_version) OVER (PARTITION BY aggregate_id) AS last
  FROM event GROUP BY org_id, aggregate_type_id, aggregate_id, aggregate_version, client_id, user_id, first_ts, first_id
), row_ AS (
  SELECT 'event_batch' AS kind, 0 AS kind_rank, * FROM batch
  UNION ALL SELECT 'soft_delete', 1, * FROM batch WHERE aggregate_id % 11 = 0 AND aggregate_version = (last + 1) // 2 OR aggregate_id % 17 = 0 AND aggregate_version = last
  UNION ALL SELECT 'soft_trim', 2, * FROM batch WHERE aggregate_id % 13 = 0 AND aggregate_version = last OR aggregate_id % 11 = 0 AND aggregate_version = (last + 3) // 4 OR aggregate_id % 22 = 11 AND aggregate_version = last
), wal AS (
  SELECT *, (wal_seq - 1) // {SEGMENT} + 1 AS log_id, ((wal_seq - 1) // {SEGMENT} + 1) // 3 + 1 AS lease_epoch, 'node-' || (((wal_seq - 1) // {SEGMENT} + 1) % 3) AS node_id FROM (
    SELECT kind, org_id, aggregate_type_id, aggregate_id, aggregate_id % {SHARDS} AS shard_id, aggregate_version, client_id, user_id, first_ts AS server_timestamp, first_id, n_events,
      min_client_seq, max_client_seq, min_event_seq, max_event_seq, min_event_timestamp, max_event_timestamp,
      CASE WHEN kind = 'event_batch' THEN size END AS size, CASE WHEN kind = 'soft_trim' THEN CASE WHEN aggregate_id % 22 = 11 AND aggregate_version = last THEN least(last, (last + 1) // 2 + 2) WHEN aggregate_version = last THEN last // 2 ELSE aggregate_version END END AS keep_from,
      CASE WHEN kind = 'soft_delete' THEN true END AS allow_recreate, CASE WHEN kind = 'soft_delete' THEN aggregate_id % 2 = 0 END AS allow_continuation,
      row_number() OVER (PARTITION BY aggregate_id % {SHARDS} ORDER BY first_ts, first_id, kind_rank) AS wal_seq
    FROM row_)
)
"""

#: To follow SQL: `log`, the log with versions that restart, and `live`, its readable batches; `old_version` and `old_events` lead back to `event`.
RESTARTED = """
, restart AS (SELECT aggregate_id, min(wal_seq) AS cut_seq, arg_min(aggregate_version, wal_seq) AS cut_version FROM wal WHERE kind = 'soft_delete' AND NOT allow_continuation GROUP BY 1
), restart_events AS (SELECT aggregate_id, coalesce(max(max_event_seq), 0) AS cut_events FROM wal JOIN restart USING (aggregate_id) WHERE kind = 'event_batch' AND wal_seq < cut_seq GROUP BY 1
), moved AS (
  SELECT w.*, CASE WHEN wal_seq > cut_seq THEN cut_version ELSE 0 END AS dead_versions, CASE WHEN wal_seq > cut_seq THEN coalesce(cut_events, 0) ELSE 0 END AS old_events
  FROM wal w LEFT JOIN restart USING (aggregate_id) LEFT JOIN restart_events USING (aggregate_id)
), log AS (
  SELECT * REPLACE (aggregate_version - dead_versions AS aggregate_version, min_event_seq - old_events AS min_event_seq, max_event_seq - old_events AS max_event_seq,
    CASE WHEN dead_versions > 0 AND keep_from IS NOT NULL THEN greatest(keep_from - dead_versions, 1) ELSE keep_from END AS keep_from), aggregate_version AS old_version FROM moved
), incarnation AS (
  SELECT aggregate_id, coalesce(max(CASE WHEN NOT allow_continuation AND wal_seq < last_batch THEN wal_seq END), 0) AS start, max(wal_seq) AS delete_seq, coalesce(max(last_batch), 0) < max(wal_seq) AS deleted,
    max(CASE WHEN NOT allow_continuation THEN wal_seq END) AS fresh_seq
  FROM log LEFT JOIN (SELECT aggregate_id, max(wal_seq) AS last_batch FROM log WHERE kind = 'event_batch' GROUP BY 1) USING (aggregate_id) WHERE kind = 'soft_delete' GROUP BY 1
), live AS (SELECT l.* FROM log l LEFT JOIN incarnation i USING (aggregate_id) WHERE kind = 'event_batch' AND (i.aggregate_id IS NULL OR NOT deleted AND wal_seq > start)
), floors AS (SELECT aggregate_id, max(keep_from) AS floor FROM log LEFT JOIN incarnation USING (aggregate_id) WHERE kind = 'soft_trim' AND wal_seq > coalesce(start, 0) GROUP BY 1
), live_event AS (SELECT e.* REPLACE (l.aggregate_version AS aggregate_version, e.event_seq - l.old_events AS event_seq) FROM event e JOIN live l ON e.aggregate_id = l.aggregate_id AND e.aggregate_version = l.old_version)
"""
