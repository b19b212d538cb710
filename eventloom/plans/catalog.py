"""Every query of the log, by name, as a DataFrame; and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import scalars, schemas
from eventloom.operators import chain, checkers, compact, listing, project, read, write
from eventloom.operators.read import ReadFilters
from eventloom.plans import history, model
from eventloom.sources.shared import shared_dir
from eventloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
M, H, L = model.SQL, model.SQL + history.SQL, model.SQL + model.RESTARTED

EVENT = "org_id, aggregate_type_id, aggregate_id, aggregate_version, event_id, event_seq, client_seq, event_timestamp, event_type_major, amount"
_EVENT = [c.strip() for c in EVENT.split(",")]
BATCH = "org_id, aggregate_type_id, aggregate_id, aggregate_version, wal_seq, server_timestamp, client_id, user_id, size"
_BATCH = [c.strip() for c in BATCH.split(",")]
T0 = model.EPOCH_MS


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


_LOGS: dict[tuple[str, str], tuple[str, object]] = {}


def wal(spark: SparkSession, d: str) -> DataFrame:
    """The stored log of an events table: numbered and written once in an application, sorted so that statistics prune, then read by every query."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOGS:
        path = f"{shared(spark)}/wal"
        made = model.wal(spark, d)
        made.repartitionByRange("shard_id", "log_id").sortWithinPartitions("shard_id", "log_id", "aggregate_id", "wal_seq").write.option("compression", "zstd").parquet(path)
        _LOGS[key] = path, made.schema
    path, schema = _LOGS[key]
    return spark.read.schema(schema).parquet(path)


def log(spark: SparkSession, d: str) -> DataFrame:
    """The stored log with versions that begin anew after a delete without continuation."""
    return model.restarted(wal(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read.flatten(read.batches(wal(spark, d)), (*model.KEY, "aggregate_version", "client_id", "user_id", "wal_seq", "server_timestamp"))


def ops(spark: SparkSession, d: str) -> DataFrame:
    return history.operations(wal(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return history.samples(spark.read.parquet(f"{d}/events.parquet"))


def shared(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"


# scans and inspection

SCAN = f"{M} SELECT shard_id, log_id, wal_seq, kind, aggregate_id, aggregate_version, server_timestamp, lease_epoch, node_id FROM wal"
_SCAN = ["shard_id", "log_id", "wal_seq", "kind", "aggregate_id", "aggregate_version", "server_timestamp", "lease_epoch", "node_id"]


@query(f"{SCAN} ORDER BY wal_seq DESC, shard_id LIMIT 500")
def scan_reverse(s, d):
    return wal(s, d).orderBy(F.desc("wal_seq"), "shard_id").limit(500).select(*_SCAN)


@query(f"{SCAN} WHERE wal_seq <= (SELECT max(m) // 2 FROM (SELECT max(wal_seq) AS m FROM wal GROUP BY shard_id))")
def scan_visible(s, d):
    w = wal(s, d)
    top = w.agg(F.floor(F.max("wal_seq") / 2).cast("long").alias("visible_seq"))
    manifest = s.range(model.SHARDS).select(F.col("id").alias("shard_id")).crossJoin(top)  # one row a shard
    return read.visible(w, manifest).select(*_SCAN)


@query(f"{SCAN} WHERE aggregate_id = 7")
def scan_aggregate(s, d):
    return read.of_aggregate(wal(s, d), 7).select(*_SCAN)


@query(f"{M} SELECT aggregate_id, max(wal_seq) AS wal_seq, arg_max(kind, wal_seq) AS kind, arg_max(aggregate_version, wal_seq) AS aggregate_version FROM wal GROUP BY 1")
def latest_per_aggregate(s, d):
    newest = F.max_by(F.struct("kind", "aggregate_version"), "wal_seq")
    return wal(s, d).groupBy("aggregate_id").agg(F.max("wal_seq").alias("wal_seq"), newest.alias("x")).select("aggregate_id", "wal_seq", "x.kind", "x.aggregate_version")


@query(f"{SCAN} WHERE log_id BETWEEN 2 AND 3")
def scan_segment_range(s, d):
    return wal(s, d).where("log_id BETWEEN 2 AND 3").select(*_SCAN)


@query(f"{SCAN} WHERE wal_seq > 400 AND shard_id = 1")
def catchup_range(s, d):
    return wal(s, d).where("wal_seq > 400 AND shard_id = 1").select(*_SCAN)


@query(f"{M} SELECT shard_id, max(wal_seq) AS write_seq, max(CASE WHEN kind = 'event_batch' THEN wal_seq END) AS last_batch_seq FROM wal GROUP BY 1")
def inspect_header(s, d):
    return wal(s, d).groupBy("shard_id").agg(F.max("wal_seq").alias("write_seq"), F.max(F.when(F.col("kind") == "event_batch", F.col("wal_seq"))).alias("last_batch_seq"))


@query(f"{SCAN} WHERE wal_seq = 100")
def inspect_wal(s, d):
    return wal(s, d).where("wal_seq = 100").select(*_SCAN)


@query(f"{SCAN} WHERE wal_seq BETWEEN 90 AND 120")
def inspect_range(s, d):
    return wal(s, d).where("wal_seq BETWEEN 90 AND 120").select(*_SCAN)


@query(f"{M} SELECT shard_id, min(wal_seq) AS first_seq, max(wal_seq) AS last_seq, count(*) AS n FROM wal GROUP BY 1")
def inspect_bounds(s, d):
    return wal(s, d).groupBy("shard_id").agg(F.min("wal_seq").alias("first_seq"), F.max("wal_seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


@query(f"""{M}, b AS (SELECT * FROM wal WHERE kind = 'event_batch' AND aggregate_id = 7 AND client_id = 2)
SELECT count(*) AS batches, CAST(sum(n_events) AS BIGINT) AS events, (SELECT count(DISTINCT s) FROM (SELECT unnest(range(min_client_seq, max_client_seq + 1)) AS s FROM b)) AS distinct_seqs FROM b""")
def inspect_client(s, d):
    b = read.of_aggregate(wal(s, d), 7).where("kind = 'event_batch' AND client_id = 2")
    per = b.select("wal_seq", F.size("events").alias("n"), F.explode(F.sequence("min_client_seq", "max_client_seq")).alias("seq"))
    return per.groupBy().agg(F.count_distinct("wal_seq").alias("batches"), F.count_distinct("seq").alias("distinct_seqs")).crossJoin(b.agg(F.sum(F.size("events")).alias("events")))  # single rows


# reads


@query(f"{L} SELECT {BATCH}, n_events FROM live")
def read_batches(s, d):
    """All that can be read: nothing of deleted aggregates or of earlier incarnations."""
    return read.read(log(s, d)).select(*_BATCH, F.size("events").cast("long").alias("n_events"))


@query(f"{M} SELECT {EVENT} FROM event")
def flatten_events(s, d):
    return events(s, d).select(*_EVENT)


@query(f"{M} SELECT aggregate_id, aggregate_version, min_client_seq, max_client_seq, min_event_seq, max_event_seq, min_event_timestamp, max_event_timestamp FROM batch")
def batch_metadata(s, d):
    return model.batch_metadata(model.batches(s.read.parquet(f"{d}/events.parquet"))).select("aggregate_id", "aggregate_version", *(f"{m}_{c}" for c in ("client_seq", "event_seq", "event_timestamp") for m in ("min", "max")))


@query(f"{M} SELECT aggregate_id, aggregate_version, string_agg(t, ',' ORDER BY first_seq) AS event_types FROM (SELECT aggregate_id, aggregate_version, CAST(event_type_major AS VARCHAR) AS t, min(event_seq) AS first_seq FROM event GROUP BY 1, 2, 3) GROUP BY 1, 2")
def batch_event_types(s, d):
    return wal(s, d).where("kind = 'event_batch'").select("aggregate_id", "aggregate_version", F.array_join(F.col("event_types").cast("array<string>"), ",").alias("event_types"))


@query(f"""{M} SELECT event_id, aggregate_id, CASE event_type_major WHEN 3 THEN 'Deposited' WHEN 4 THEN 'TransferredIn' WHEN 2 THEN 'Withdrawn' ELSE 'Unknown' END AS label,
CASE WHEN event_type_major = 4 THEN aggregate_id END AS account, amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM event""")
def format_history(s, d):
    t = F.col("event_type_major")
    label = F.when(t == 3, "Deposited").when(t == 4, "TransferredIn").when(t == 2, "Withdrawn").otherwise("Unknown")
    return events(s, d).select("event_id", "aggregate_id", label.alias("label"), F.when(t == 4, F.col("aggregate_id")).alias("account"), "amount", F.get_json_object("props", "$.k").cast("long").alias("k"))


_CODES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in scalars.OPERATIONS.items())
_CHANGES = f"""{M}, change AS (
  SELECT shard_id, org_id, aggregate_type_id, aggregate_id, wal_seq, 'create' AS op, aggregate_version AS from_version, aggregate_version AS to_version, keep_from FROM wal WHERE kind = 'event_batch' AND aggregate_version = 1
  UNION ALL SELECT shard_id, org_id, aggregate_type_id, aggregate_id, wal_seq, CASE kind WHEN 'event_batch' THEN 'write' WHEN 'soft_delete' THEN 'delete' ELSE 'trim' END, aggregate_version, aggregate_version, keep_from FROM wal
)"""


@query(f"{_CHANGES} SELECT op, CASE op {_CODES} END AS code, count(*) AS n FROM change GROUP BY 1, 2")
def watch_op_codes(s, d):
    return watch.changes(wal(s, d)).groupBy("op", scalars.operation_code(F.col("op")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{H} SELECT coalesce(error, 0) AS code, CASE WHEN outcome = 'info' THEN 'info' WHEN error IS NULL THEN 'ok' ELSE 'fail' END AS outcome, count(*) AS n FROM op GROUP BY 1, 2")
def classify_outcome(s, d):
    code = F.when(F.col("outcome") == "info", 9999).otherwise(F.col("error"))
    return ops(s, d).groupBy(F.coalesce("error", F.lit(0)).alias("code"), scalars.outcome(code).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _reads(name: str, filters: ReadFilters, on_batch: str, on_event: str = "true") -> None:
    @query(f"""{L} SELECT {", ".join("e." + c.strip() for c in EVENT.split(","))} FROM live_event e JOIN live w ON w.aggregate_id = e.aggregate_id AND w.aggregate_version = e.aggregate_version
WHERE ({on_batch}) AND ({on_event})""", name)
    def run(s, d):
        return read.flatten(read.read(log(s, d), filters)).select(*_EVENT)


F0 = ReadFilters()
_reads("read_from_version", ReadFilters(from_version=5), "w.aggregate_version >= 5")
_reads("read_version_range", F0.versions(0, 6), "w.aggregate_version BETWEEN 1 AND 6")
_reads("read_server_time", F0.server_time(T0 + 5 * 86_400_000, T0 + 12 * 86_400_000), f"w.server_timestamp BETWEEN {T0 + 5 * 86_400_000} AND {T0 + 12 * 86_400_000}")
_reads("read_exclude_client", ReadFilters(exclude_client=2), "w.client_id <> 2")
_reads("read_include_client", ReadFilters(include_client=2), "w.client_id = 2")
_reads("read_exclude_user", ReadFilters(exclude_user=7), "w.user_id IS DISTINCT FROM 7")
_reads("read_include_user", ReadFilters(include_user=7), "w.user_id = 7")
_reads("read_client_seq", F0.client_seq(3, 9), "w.max_client_seq >= 3 AND w.min_client_seq <= 9", "e.client_seq BETWEEN 3 AND 9")
_reads("read_event_time", F0.event_time(T0 + 3 * 86_400_000, T0 + 9 * 86_400_000), "true", f"e.event_timestamp BETWEEN {T0 + 3 * 86_400_000} AND {T0 + 9 * 86_400_000}")
_reads("read_event_seq", F0.event_seq(10, 30), "true", "e.event_seq BETWEEN 10 AND 30")
_reads("read_event_types", F0.versions(2).types([2, 5]), "w.aggregate_version >= 2", "e.event_type_major IN (2, 5)")


@query(f"{L} SELECT {BATCH} FROM live LEFT JOIN floors USING (aggregate_id) WHERE aggregate_version >= coalesce(floor, 0)")
def read_after_trim(s, d):
    w = log(s, d)
    return read.above_floor(read.read(w), read.floors(w)).select(*_BATCH)


@query(f"""{L}, f AS (SELECT l.aggregate_id, bool_or(coalesce(deleted, false)) AS deleted, coalesce(max(floor), 0) AS floor FROM log l LEFT JOIN incarnation USING (aggregate_id) LEFT JOIN floors f ON f.aggregate_id = l.aggregate_id GROUP BY 1)
SELECT aggregate_id, CASE WHEN deleted THEN 1001 WHEN floor > 1 THEN 1000 ELSE 0 END AS code, floor FROM f""")
def read_guards(s, d):
    """What a read from version 1 of each aggregate answers: its batches (0), or an error."""
    return read.answers(log(s, d))


@query(f"""{L}, sized AS (SELECT *, sum(size) OVER (PARTITION BY aggregate_id ORDER BY aggregate_version) AS running FROM live),
cut AS (SELECT aggregate_id, min(aggregate_version) AS next_version FROM sized WHERE running > 2000 GROUP BY 1)
SELECT aggregate_id, aggregate_version, size, next_version FROM sized LEFT JOIN cut USING (aggregate_id) WHERE running <= 2000""")
def read_page_bytes(s, d):
    return read.page(read.read(log(s, d)), 2000).select("aggregate_id", "aggregate_version", "size", "next_version")


@query(f"{L} SELECT aggregate_version, size FROM live WHERE aggregate_id = 7")
def read_all(s, d):
    """All pages of one aggregate, each read by itself from the stored log."""
    out = None
    for got in read.read_all(log(s, d), 7, 20_000):
        part = got.select("aggregate_version", "size")
        out = part if out is None else out.unionByName(part)
    return out


# watch


@query(f"{_CHANGES} SELECT shard_id, aggregate_id, wal_seq, op, from_version, to_version, keep_from FROM change WHERE org_id IN (1, 2) AND op IN ('write', 'trim', 'delete')")
def watch_filtered(s, d):
    return watch.filtered(watch.changes(wal(s, d)), orgs=[1, 2], ops=["write", "trim", "delete"]).select("shard_id", "aggregate_id", "wal_seq", "op", "from_version", "to_version", "keep_from")


_MERGED = "aggregate_id, op, min(from_version) AS from_version, max(to_version) AS to_version, {trim}(keep_from, wal_seq) AS keep_from, max(wal_seq) AS last_seq FROM change"
_MERGED_COLUMNS = ["aggregate_id", "op", "from_version", "to_version", "keep_from", "last_seq"]


@query(f"{_CHANGES} SELECT {_MERGED.format(trim='arg_max')} GROUP BY 1, 2")
def watch_merge(s, d):
    return watch.merged(watch.changes(wal(s, d))).select(*_MERGED_COLUMNS)


@query(f"{_CHANGES} SELECT (wal_seq - 1) // 50 AS commit_id, {_MERGED.format(trim='arg_min')} GROUP BY 1, 2, 3")
def watch_commit_merge(s, d):
    rows = watch.changes(wal(s, d)).withColumn("commit_id", F.floor((F.col("wal_seq") - 1) / 50).cast("long"))
    return watch.merged(rows, "commit_id", last_trim=False).select("commit_id", *_MERGED_COLUMNS)


@query(f"{_CHANGES} SELECT aggregate_id, wal_seq FROM change WHERE op = 'create'")
def watch_create(s, d):
    return watch.filtered(watch.changes(wal(s, d)), ops=["create"]).select("aggregate_id", "wal_seq")


@query(f"{_CHANGES} SELECT {_MERGED.format(trim='arg_max')} WHERE wal_seq > 100 AND op <> 'create' GROUP BY 1, 2")
def watch_feed(s, d):
    """The log as a stream of files, from the sequence that was visible at the start."""
    out = shared(s)
    rows = wal(s, d).select("shard_id", *model.KEY, "kind", "wal_seq", "aggregate_version", "keep_from")
    rows.write.parquet(f"{out}/wal")
    got = watch.collected(s, f"{out}/wal", rows.schema, out, visible={i: 100 for i in range(model.SHARDS)}, ops=["write", "delete", "trim"])
    return got.select(*_MERGED_COLUMNS)


# listings

_LAST_DELETE = "dead AS (SELECT aggregate_id, max(wal_seq) AS delete_seq, max(CASE WHEN NOT allow_continuation THEN wal_seq END) AS fresh_seq FROM log WHERE kind = 'soft_delete' GROUP BY 1), born AS (SELECT aggregate_id, min(wal_seq) AS born FROM log WHERE kind <> 'soft_trim' GROUP BY 1)"
_SUMMARY = """SELECT w.org_id, w.aggregate_type_id, w.aggregate_id{more},
  count(CASE WHEN w.kind = 'event_batch' AND w.wal_seq > coalesce(delete_seq, 0) THEN 1 END) AS batch_count,
  CAST(coalesce(sum(CASE WHEN w.kind = 'event_batch' AND w.wal_seq > coalesce(delete_seq, 0) THEN w.size END), 0) AS BIGINT) AS total_size,
  coalesce(max(CASE WHEN w.kind = 'event_batch' THEN w.aggregate_version END), 0) AS max_version, coalesce(max(CASE WHEN w.kind <> 'soft_trim' THEN w.server_timestamp END), 0) AS max_timestamp,
  coalesce(max(CASE WHEN w.kind = 'soft_trim' AND w.wal_seq > greatest(born, coalesce(fresh_seq, 0)) THEN w.keep_from END), 0) AS floor,
  coalesce(max(delete_seq), 0) > coalesce(max(CASE WHEN w.kind = 'event_batch' THEN w.wal_seq END), 0) AS is_deleted"""
_LISTED = f"{L}, {_LAST_DELETE}, listed AS ({_SUMMARY.format(more='')} FROM log w JOIN born USING (aggregate_id) LEFT JOIN dead USING (aggregate_id) GROUP BY ALL)"
_LIST = ["org_id", "aggregate_type_id", "aggregate_id", "batch_count", "total_size", "max_version", "max_timestamp", "floor", "is_deleted"]


@query(f"{_LISTED} SELECT * FROM listed WHERE NOT is_deleted")
def list_aggregates(s, d):
    return listing.aggregates(log(s, d)).select(*_LIST)


@query(f"{_LISTED} SELECT * FROM listed")
def list_aggregates_all(s, d):
    return listing.aggregates(log(s, d), include_deleted=True).select(*_LIST)


@query(f"{_LISTED} SELECT * FROM listed WHERE NOT is_deleted AND org_id = 1 AND aggregate_type_id = 2")
def list_aggregates_filtered(s, d):
    return listing.aggregates(log(s, d), org_id=1, type_id=2).select(*_LIST)


@query(f"{_LISTED} SELECT * FROM listed WHERE NOT is_deleted AND aggregate_id IN (SELECT aggregate_id FROM dead)")
def list_recreated(s, d):
    w = log(s, d)
    return listing.aggregates(w.join(listing.last_deletes(w).select("aggregate_id"), "aggregate_id", "left_semi")).select(*_LIST)


_SEGMENTS = f"""{L}, dead AS (SELECT aggregate_id, log_id, max(wal_seq) AS delete_seq, max(CASE WHEN NOT allow_continuation THEN wal_seq END) AS fresh_seq FROM log WHERE kind = 'soft_delete' GROUP BY 1, 2), born AS (SELECT aggregate_id, log_id, min(wal_seq) AS born FROM log WHERE kind <> 'soft_trim' GROUP BY 1, 2),
listed AS ({_SUMMARY.format(more=', w.shard_id, w.log_id')} FROM log w JOIN born USING (aggregate_id, log_id) LEFT JOIN dead USING (aggregate_id, log_id) GROUP BY ALL)"""


@query(f"{_SEGMENTS} SELECT * FROM listed")
def segment_summary(s, d):
    return listing.summary(log(s, d), "shard_id", "log_id").select("shard_id", "log_id", *_LIST)


@query(f"{_LISTED} SELECT * FROM listed")
def merge_segments(s, d):
    """Partial summaries of segments, merged: as the summary of the whole log."""
    return listing.merge(listing.partials(log(s, d), "shard_id", "log_id")).select(*_LIST)


@query(f"""{_SEGMENTS}, e AS (SELECT aggregate_id, log_id, min(min_event_timestamp) AS t FROM log LEFT JOIN dead USING (aggregate_id, log_id) WHERE kind = 'event_batch' AND wal_seq > coalesce(delete_seq, 0) GROUP BY 1, 2)
SELECT org_id, aggregate_type_id, aggregate_id, CAST(sum(batch_count) AS BIGINT) AS batch_count, CAST(sum(total_size) AS BIGINT) AS total_size, max(max_version) AS max_version, coalesce(min(t), 0) AS min_event_timestamp, bool_or(is_deleted) AS is_deleted FROM listed LEFT JOIN e USING (aggregate_id, log_id) GROUP BY 1, 2, 3""")
def list_stats_merge(s, d):
    return listing.merge_pages(listing.summary(log(s, d), "shard_id", "log_id"))


@query("SELECT DISTINCT user_id % 4 AS org_id FROM events")
def list_orgs(s, d):
    return listing.orgs(model.log_events(s.read.parquet(f"{d}/events.parquet")))


@query("SELECT DISTINCT user_id % 4 AS org_id, user_id % 3 AS aggregate_type_id FROM events WHERE user_id % 4 = 1")
def list_types(s, d):
    return listing.types(model.log_events(s.read.parquet(f"{d}/events.parquet")), 1)


@query("SELECT DISTINCT user_id % 4 AS org_id FROM events WHERE user_id % 4 < 3")
def union_orgs(s, d):
    rows = listing.orgs(model.log_events(s.read.parquet(f"{d}/events.parquet")))
    return rows.where("org_id < 2").unionByName(rows.where("org_id BETWEEN 1 AND 2")).distinct()


@query(f"""{L}, own AS (SELECT l.* FROM log l LEFT JOIN incarnation USING (aggregate_id) WHERE wal_seq > coalesce(start, 0)), b AS (SELECT * FROM own WHERE kind = 'event_batch'),
l AS (SELECT aggregate_id, arg_max(kind, wal_seq) AS kind, arg_max(coalesce(allow_recreate, false), wal_seq) AS r, arg_max(coalesce(allow_continuation, false), wal_seq) AS c FROM own WHERE kind <> 'soft_trim' GROUP BY 1),
t AS (SELECT aggregate_id, max(keep_from) AS floor, max(wal_seq) AS last_wal_seq FROM own GROUP BY 1)
SELECT b.org_id, b.aggregate_type_id, b.aggregate_id, greatest(min(b.aggregate_version), coalesce(any_value(floor), 0)) AS min_version, max(b.aggregate_version) AS max_version, max(max_event_seq) AS max_event_seq,
 any_value(l.kind) = 'soft_delete' AS is_deleted, any_value(r) AS allow_recreate, any_value(c) AS allow_continuation, arg_max(b.client_id, b.wal_seq) AS last_client_id, any_value(x.user_id) AS last_user_id, max(b.server_timestamp) AS last_timestamp, any_value(last_wal_seq) AS last_wal_seq
FROM b JOIN l USING (aggregate_id) JOIN t USING (aggregate_id) LEFT JOIN (SELECT aggregate_id, user_id FROM b QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY wal_seq DESC) = 1) x USING (aggregate_id) GROUP BY 1, 2, 3""")
def aggregate_details(s, d):
    return read.state(log(s, d))


@query(f"{L} SELECT aggregate_id, floor FROM floors")
def trim_floor(s, d):
    return read.floors(log(s, d))


@query(f"{M} SELECT org_id, aggregate_type_id, aggregate_id, client_id, max(max_client_seq) AS floor FROM wal WHERE kind = 'event_batch' GROUP BY 1, 2, 3, 4")
def client_floors(s, d):
    return listing.client_floors(wal(s, d).where("kind = 'event_batch'"))


@query(f"{M} SELECT aggregate_id, count(DISTINCT client_id) AS clients, string_agg(DISTINCT CAST(client_id AS VARCHAR), ',' ORDER BY CAST(client_id AS VARCHAR)) AS ids FROM wal WHERE kind = 'event_batch' GROUP BY 1")
def clients_per_aggregate(s, d):
    rows = wal(s, d).where("kind = 'event_batch'").groupBy("aggregate_id").agg(F.collect_set(F.col("client_id").cast("string")).alias("ids"))
    return rows.select("aggregate_id", F.size("ids").cast("long").alias("clients"), F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query(f"{M} SELECT w.shard_id, w.log_id, count(DISTINCT (e.org_id, e.aggregate_type_id, e.event_type_major, e.event_type_minor)) AS schemas FROM event e JOIN wal w ON w.kind = 'event_batch' AND w.aggregate_id = e.aggregate_id AND w.aggregate_version = e.aggregate_version GROUP BY 1, 2")
def schemas_per_segment(s, d):
    rows = wal(s, d).where("kind = 'event_batch'").select("shard_id", "log_id", "org_id", "aggregate_type_id", F.inline("events"))
    return rows.groupBy("shard_id", "log_id").agg(F.count_distinct("org_id", "aggregate_type_id", "event_type_major", "event_type_minor").alias("schemas"))


@query(f"{M} SELECT shard_id, log_id, wal_seq, aggregate_id FROM wal WHERE wal_seq < 300 ORDER BY wal_seq DESC, shard_id LIMIT 100")
def list_page(s, d):
    return listing.page(wal(s, d), 300, 100).select("shard_id", "log_id", "wal_seq", "aggregate_id")


@query(f"{M} SELECT aggregate_id, count(*) AS batches FROM batch GROUP BY 1 ORDER BY 1 LIMIT 24")
def topn_aggregates(s, d):
    return wal(s, d).where("kind = 'event_batch'").groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("batches")).orderBy("aggregate_id").limit(24)


@query(f"{M} SELECT aggregate_id FROM (SELECT DISTINCT aggregate_id FROM wal) ORDER BY md5(aggregate_id || '-42'), aggregate_id LIMIT 24")
def sample_aggregates(s, d):
    """A seeded sample of 24 aggregates: those with the smallest hash."""
    return listing.sampled(wal(s, d), 24, 42)


# projections

_SIGN = "CASE event_type_major " + " ".join(f"WHEN {k} THEN {v}" for k, v in model.SIGNS.items()) + " ELSE 0 END * amount"


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance FROM event GROUP BY 1")
def account_balance(s, d):
    return project.balances(model.log_events(s.read.parquet(f"{d}/events.parquet")))


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance, max(aggregate_version) AS last_version, coalesce(max(CASE WHEN client_id = 3 THEN client_seq END), 0) AS last_client_seq FROM event GROUP BY 1")
def account_projection(s, d):
    return project.projection(events(s, d), 3)


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance, max(aggregate_version) AS last_version, coalesce(max(CASE WHEN client_id = 3 THEN client_seq END), 0) AS last_client_seq FROM event WHERE aggregate_version <= 10 GROUP BY 1")
def asof_version(s, d):
    return project.projection(events(s, d), 3, upto=10)


@query(f"{M} SELECT aggregate_id, event_seq, CAST(sum({_SIGN}) OVER (PARTITION BY aggregate_id ORDER BY event_seq) AS BIGINT) AS balance FROM event")
def running_balance(s, d):
    return project.running(events(s, d)).select("aggregate_id", "event_seq", "balance")


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance, max(aggregate_version) AS last_version FROM event GROUP BY 1", "projection_advance")
def projection_advance(s, d):
    """The projection as of version 10 moved on by later events."""
    e = events(s, d)
    stored = project.projection(e, 3, upto=10).select("aggregate_id", "balance", "last_version")
    return project.advance(stored, e)


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance, max(aggregate_version) AS last_version FROM event GROUP BY 1", "stream_projection")
def stream_projection(s, d):
    out = shared(s)
    rows = wal(s, d).select("aggregate_id", "kind", "aggregate_version", "events")
    rows.write.parquet(f"{out}/wal")
    return watch.projected(s, f"{out}/wal", rows.schema, out)


@query(f"{M} SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance, max(event_seq) AS last_seq FROM event GROUP BY 1", "python_fold")
def python_fold(s, d):
    """The same balance by a fold in Python, the way for folds that columns can't express."""
    signs = dict(model.SIGNS)

    def step(state, row):
        before = state["balance"] if state else 0
        return {"aggregate_id": row["aggregate_id"], "balance": before + signs.get(row["event_type_major"], 0) * row["amount"], "last_seq": row["event_seq"]}

    return project.fold(events(s, d).select("aggregate_id", "event_seq", "event_type_major", "amount"), "aggregate_id bigint, balance bigint, last_seq bigint", step)


@query(f"{M}, p AS (SELECT aggregate_id, CAST(sum({_SIGN}) AS BIGINT) AS balance FROM event GROUP BY 1), c AS (SELECT aggregate_id, event_id, event_timestamp + 86400000 AS expires_at FROM event) SELECT p.aggregate_id, balance, event_id, expires_at FROM p LEFT JOIN c ON p.aggregate_id = c.aggregate_id AND c.expires_at > {T0 + 25 * 86_400_000}")
def projection_left_join(s, d):
    e = events(s, d)
    cache = e.select(F.col("aggregate_id").alias("of"), "event_id", (F.col("event_timestamp") + 86_400_000).alias("expires_at"))
    p = project.balances(e)
    return p.join(cache, (F.col("aggregate_id") == F.col("of")) & (F.col("expires_at") > T0 + 25 * 86_400_000), "left").drop("of")


@query(f"{M}, e AS (SELECT aggregate_id, event_id, w.server_timestamp FROM event JOIN wal w USING (aggregate_id, aggregate_version) WHERE w.kind = 'event_batch'), a AS (SELECT *, max(server_timestamp) OVER (PARTITION BY aggregate_id) - server_timestamp AS age FROM e) SELECT aggregate_id, event_id, age FROM a WHERE age <= 90000000")
def dedup_window(s, d):
    e = events(s, d)
    tip = e.groupBy("aggregate_id").agg(F.max("server_timestamp").alias("tip"))
    return e.join(tip, "aggregate_id").select("aggregate_id", "event_id", (F.col("tip") - F.col("server_timestamp")).alias("age")).where("age <= 90000000")


_CURRENT = "SELECT aggregate_id, 'n' || (aggregate_id % 5) AS name, count(*) AS balance, max(aggregate_version) AS last_version, max(event_timestamp) AS expires_at FROM event WHERE aggregate_version <= 10 GROUP BY 1"
_CHANGED = "SELECT aggregate_id, CASE WHEN aggregate_id % 2 = 0 THEN '' ELSE 'm' || (aggregate_id % 7) END AS name, -count(*) AS balance, max(aggregate_version) - aggregate_id % 3 * 20 AS last_version, min(event_timestamp) AS expires_at FROM event WHERE aggregate_id % 3 <> 2 OR aggregate_version > 2 GROUP BY 1"


@query(f"""{M}, b AS (SELECT *, 0 AS n FROM ({_CURRENT}) UNION ALL SELECT *, 1 FROM ({_CHANGED}))
SELECT aggregate_id, first(balance ORDER BY last_version DESC, n) AS balance, first(last_version ORDER BY last_version DESC, n) AS last_version,
coalesce(first(name ORDER BY last_version DESC, n) FILTER (WHERE name <> ''), '') AS name, max(expires_at) AS expires_at FROM b GROUP BY 1""")
def upsert_projection(s, d):
    e = events(s, d)
    a = F.col("aggregate_id")
    old = e.where("aggregate_version <= 10").groupBy("aggregate_id").agg(F.concat(F.lit("n"), (F.first("aggregate_id") % 5).cast("string")).alias("name"), F.count(F.lit(1)).alias("balance"), F.max("aggregate_version").alias("last_version"), F.max("event_timestamp").alias("expires_at"))
    new = e.where("aggregate_id % 3 <> 2 OR aggregate_version > 2").groupBy("aggregate_id").agg((-F.count(F.lit(1))).alias("balance"), F.max("aggregate_version").alias("v"), F.min("event_timestamp").alias("expires_at"))
    new = new.select("aggregate_id", F.when(a % 2 == 0, "").otherwise(F.concat(F.lit("m"), (a % 7).cast("string"))).alias("name"), "balance", (F.col("v") - a % 3 * 20).alias("last_version"), "expires_at")
    return write.upsert(old, new)


@query(f"{M} SELECT aggregate_id, event_id, event_timestamp + 86400000 AS expires_at FROM event WHERE event_timestamp + 86400000 >= {T0 + 20 * 86_400_000}")
def ttl_purge(s, d):
    return events(s, d).select("aggregate_id", "event_id", (F.col("event_timestamp") + 86_400_000).alias("expires_at")).where(F.col("expires_at") >= T0 + 20 * 86_400_000)


@query(f"{M} SELECT aggregate_id, client_seq, arg_min(event_id, event_seq) AS owner, CASE WHEN count(*) > 1 THEN 'contested' ELSE 'owned' END AS state, arg_min(client_id, event_seq) AS client_id FROM event GROUP BY 1, 2")
def who_owns_seq(s, d):
    """Which event owns a client sequence of an aggregate: the first; others of it are contested."""
    first = F.min_by(F.struct("event_id", "client_id"), "event_seq")
    rows = events(s, d).groupBy("aggregate_id", "client_seq").agg(first.alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("aggregate_id", "client_seq", F.col("x.event_id").alias("owner"), F.when(F.col("n") > 1, "contested").otherwise("owned").alias("state"), "x.client_id")


# numbering


@query(f"{M} SELECT aggregate_id, client_id, user_id, first_ts, first_id, aggregate_version FROM head")
def assign_versions(s, d):
    return model.batches(s.read.parquet(f"{d}/events.parquet")).select("aggregate_id", "client_id", "user_id", "first_ts", "first_id", "aggregate_version")


@query(f"{M} SELECT event_id, event_seq, client_seq FROM event")
def assign_event_seq(s, d):
    return events(s, d).select("event_id", "event_seq", "client_seq")


@query(f"{M} SELECT shard_id, wal_seq, kind, aggregate_id, aggregate_version, log_id FROM wal")
def assign_wal_seq(s, d):
    return wal(s, d).select("shard_id", "wal_seq", "kind", "aggregate_id", "aggregate_version", "log_id")


# chains and logs


def _tampered(made: DataFrame) -> DataFrame:
    return made.withColumn("tip", F.when(F.col("wal_seq") % 97 == 0, F.sha2("tip", 256)).otherwise(F.col("tip")))


@query(f"{M} SELECT DISTINCT shard_id, wal_seq FROM wal WHERE wal_seq % 97 = 0 OR wal_seq > 1 AND (wal_seq - 1) % 97 = 0")
def check_hash_chain(s, d):
    """A chain in which every 97th tip was changed: it and the row after it are found."""
    return chain.breaks(_tampered(chain.made(wal(s, d))))


@query(f"{M} SELECT shard_id, least(max(wal_seq), 96) AS ancestor FROM wal GROUP BY 1")
def common_ancestor(s, d):
    ours = chain.made(wal(s, d))
    theirs = ours.withColumn("tip", F.when(F.col("wal_seq") >= 97, F.sha2("tip", 256)).otherwise(F.col("tip")))
    return chain.common_ancestor(ours, theirs)


@query(f"{M}, t AS (SELECT shard_id, max(wal_seq) AS ours FROM wal GROUP BY 1) SELECT shard_id, ours, CASE WHEN shard_id % 2 = 0 THEN least(ours, 96) ELSE ours END AS theirs, shard_id = 3 OR shard_id = 2 AND ours > 96 AS fork FROM t")
def check_tip_fork(s, d):
    """A second node that ends earlier in even shards; with another last tip in shards 2 and 3."""
    ours = chain.made(wal(s, d))
    last = ours.groupBy("shard_id").agg(F.max("wal_seq").alias("last")).withColumn("upto", F.when(F.col("shard_id") % 2 == 0, F.least("last", F.lit(96))).otherwise(F.col("last")))
    theirs = ours.join(last, "shard_id").where("wal_seq <= upto").withColumn("tip", F.when((F.col("wal_seq") == F.col("upto")) & F.col("shard_id").isin(2, 3), F.sha2("tip", 256)).otherwise(F.col("tip")))
    return checkers.tip_fork(ours, theirs.drop("last", "upto"))


@query(f"{M} SELECT shard_id, wal_seq FROM wal WHERE wal_seq % 41 <> 0 AND wal_seq > 1 AND (wal_seq - 1) % 41 = 0")
def check_wal_contiguous(s, d):
    return checkers.contiguous(wal(s, d).where("wal_seq % 41 <> 0"))


@query(f"{M}, e AS (SELECT shard_id, wal_seq, CASE WHEN wal_seq % 53 = 0 THEN lease_epoch - 1 ELSE lease_epoch END AS lease_epoch FROM wal), l AS (SELECT *, lag(lease_epoch) OVER (PARTITION BY shard_id ORDER BY wal_seq) AS before FROM e) SELECT * FROM l WHERE lease_epoch < before")
def check_epoch_monotonic(s, d):
    return checkers.epoch_monotonic(wal(s, d).withColumn("lease_epoch", F.col("lease_epoch") - (F.col("wal_seq") % 53 == 0).cast("long")))


@query(f"{M} SELECT shard_id, wal_seq, lease_epoch AS low, lease_epoch + 1 AS high FROM wal WHERE wal_seq % 61 = 0")
def check_epoch_unique(s, d):
    w = wal(s, d).select("shard_id", "wal_seq", "lease_epoch")
    return checkers.epoch_unique(w.unionByName(w.withColumn("lease_epoch", F.col("lease_epoch") + (F.col("wal_seq") % 61 == 0).cast("long"))))


_UPLOADS = "SELECT shard_id, log_id, lease_epoch + u AS lease_epoch, (wal_seq * 7 + u * 3) % 11 AS upload, min(wal_seq) AS first_seq, max(wal_seq) AS last_seq FROM wal, (VALUES (0), (1)) AS x(u) GROUP BY ALL"


def _uploads(s, d) -> DataFrame:
    w = wal(s, d).select("shard_id", "log_id", "lease_epoch", "wal_seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("u"))
    return w.groupBy("shard_id", "log_id", (F.col("lease_epoch") + F.col("u")).alias("lease_epoch"), ((F.col("wal_seq") * 7 + F.col("u") * 3) % 11).alias("upload")).agg(F.min("wal_seq").alias("first_seq"), F.max("wal_seq").alias("last_seq"))


@query(f"{M}, up AS ({_UPLOADS}) SELECT shard_id, log_id, lease_epoch, upload, first_seq, last_seq FROM up QUALIFY row_number() OVER (PARTITION BY shard_id, log_id ORDER BY lease_epoch DESC, upload DESC) = 1")
def authoritative_batches(s, d):
    return listing.authoritative(_uploads(s, d))


@query(f"{M}, r AS (SELECT shard_id, log_id, min(wal_seq) AS low, max(wal_seq) AS high FROM wal GROUP BY 1, 2) SELECT a.shard_id, a.log_id, b.log_id AS other FROM r a JOIN (SELECT shard_id, log_id, low - 20 AS low, high + 20 AS high FROM r) b ON a.shard_id = b.shard_id AND a.low <= b.high AND b.low <= a.high")
def batch_overlap(s, d):
    """Segments whose sequence ranges meet another's, widened by 20."""
    r = wal(s, d).groupBy("shard_id", "log_id").agg(F.min("wal_seq").alias("low"), F.max("wal_seq").alias("high"))
    return listing.overlaps(r, r.select("shard_id", F.col("log_id").alias("other"), (F.col("low") - 20).alias("low"), (F.col("high") + 20).alias("high")), "shard_id", model.SEGMENT).select("shard_id", "log_id", "other")


@query(f"{M}, r AS (SELECT shard_id, log_id, min(wal_seq) AS first, max(wal_seq) - CASE WHEN log_id % 2 = 0 THEN 5 ELSE 0 END AS last FROM wal GROUP BY 1, 2), l AS (SELECT shard_id, first, last, lag(last) OVER (PARTITION BY shard_id ORDER BY first, last) AS before FROM r) SELECT * FROM l WHERE first > last OR before + 1 < first")
def check_s3_gaps(s, d):
    r = wal(s, d).groupBy("shard_id", "log_id").agg(F.min("wal_seq").alias("first"), (F.max("wal_seq") - F.when(F.col("log_id") % 2 == 0, 5).otherwise(0)).alias("last"))
    return checkers.range_gaps(r)


# compaction

_STATES = """st AS (SELECT aggregate_id, max(CASE WHEN kind = 'soft_delete' THEN wal_seq END) AS delete_seq, max(CASE WHEN kind = 'event_batch' THEN wal_seq END) AS last_batch, arg_max(keep_from, wal_seq) FILTER (WHERE kind = 'soft_trim') AS floor FROM log GROUP BY 1),
state AS (SELECT aggregate_id, CASE WHEN delete_seq IS NOT NULL AND coalesce(last_batch, 0) < delete_seq THEN 'deleted' WHEN delete_seq IS NOT NULL THEN 'recreated' WHEN floor IS NOT NULL THEN 'trimmed' ELSE 'alive' END AS state, CASE WHEN delete_seq IS NULL THEN coalesce(floor, 0) ELSE 0 END AS floor, delete_seq FROM st),
kept AS (SELECT w.*, CASE WHEN kind <> 'event_batch' THEN true WHEN state = 'deleted' THEN false WHEN state = 'recreated' THEN wal_seq > delete_seq ELSE aggregate_version >= s.floor END AS keep FROM log w JOIN state s USING (aggregate_id))"""


@query(f"{L}, {_STATES} SELECT * FROM state")
def compaction_state(s, d):
    return compact.states(log(s, d))


@query(f"{L}, {_STATES} SELECT shard_id, wal_seq, kind, aggregate_id, aggregate_version FROM kept WHERE keep")
def compact_keep(s, d):
    return compact.marked(log(s, d)).where("keep").select("shard_id", "wal_seq", "kind", "aggregate_id", "aggregate_version")


@query(f"{M} SELECT shard_id, log_id, count(*) AS batches FROM wal WHERE kind = 'event_batch' AND aggregate_id IN (SELECT aggregate_id FROM wal WHERE kind <> 'event_batch') GROUP BY 1, 2")
def compact_candidates(s, d):
    return compact.candidates(wal(s, d))


@query(f"""{L}, {_STATES}, r AS (SELECT shard_id, log_id, count(CASE WHEN keep THEN 1 END) AS kept_rows, count(*) AS rows, CAST(coalesce(sum(CASE WHEN keep THEN size END), 0) AS BIGINT) AS kept_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM kept GROUP BY 1, 2)
SELECT *, 100 * (bytes - kept_bytes) >= 20 * bytes AS worth FROM r""")
def reclaimable_ratio(s, d):
    return compact.reclaimable(log(s, d))


@query(f"{L} SELECT aggregate_id, arg_max(keep_from, wal_seq) AS keep_from, max(wal_seq) AS wal_seq FROM log WHERE kind = 'soft_trim' GROUP BY 1")
def latest_trim(s, d):
    return read.latest_trim(log(s, d))


# mutations


@query(f"{L} SELECT aggregate_id, arg_max(kind, wal_seq) = 'soft_delete' AS is_deleted, bool_or(kind = 'soft_delete') AS was_deleted FROM log WHERE kind <> 'soft_trim' GROUP BY 1")
def delete_state(s, d):
    return read.deletion(log(s, d))


_RECREATED = f"{L}, again AS (SELECT aggregate_id, arg_max(allow_continuation, wal_seq) AS continues FROM log WHERE kind = 'soft_delete' GROUP BY 1) SELECT aggregate_id, aggregate_version, wal_seq FROM live JOIN again USING (aggregate_id) WHERE "


@query(f"{_RECREATED} continues")
def recreate_continue(s, d):
    """With continuation, versions go on and the batches before the delete are readable again."""
    return read.recreated(log(s, d), True).select("aggregate_id", "aggregate_version", "wal_seq")


@query(f"{_RECREATED} NOT continues")
def recreate_fresh(s, d):
    """Without continuation, only what came after the delete is readable, with versions from 1."""
    return read.recreated(log(s, d), False).select("aggregate_id", "aggregate_version", "wal_seq")


_SEVERAL = "wal_seq % 9 = 1 AND kind = 'event_batch' AND before_kind = 'event_batch' AND before_aggregate <> aggregate_id"
_ITEMS = f"""{M}, item AS (
  SELECT shard_id, CASE WHEN wal_seq % 97 = 0 THEN wal_seq * 4 WHEN {_SEVERAL} THEN (wal_seq - 1) * 4 + shard_id ELSE wal_seq * 4 + shard_id END AS request_id,
    CASE kind WHEN 'event_batch' THEN 'write' WHEN 'soft_delete' THEN 'delete' ELSE 'trim' END AS op, aggregate_id, client_id, coalesce(min_client_seq, 0) - CASE WHEN wal_seq % 13 = 0 THEN 3 ELSE 0 END AS first_client_seq,
    CASE WHEN wal_seq % 59 = 0 OR kind <> 'event_batch' THEN 0 ELSE n_events END AS n_events, CASE WHEN wal_seq % 71 = 0 THEN 0 ELSE 1 END AS min_type, wal_seq % 37 <> 0 AS valid, wal_seq % 6 <> 0 AS idempotent, wal_seq % 5 <> 0 AS allow_create,
    CASE WHEN wal_seq % 31 = 0 THEN 999999 END AS expected_version, coalesce(keep_from, 0) AS keep_from, coalesce(allow_recreate, false) AS allow_recreate, coalesce(allow_continuation, false) AS allow_continuation,
    CASE WHEN wal_seq % 3 = 0 THEN wal_seq * 4 - 400 END AS durable_upto
  FROM (SELECT *, lag(kind) OVER w AS before_kind, lag(aggregate_id) OVER w AS before_aggregate FROM wal WINDOW w AS (PARTITION BY shard_id ORDER BY wal_seq))
), crossing AS (SELECT request_id FROM item GROUP BY 1 HAVING count(DISTINCT shard_id) > 1
), turn AS (SELECT *, dense_rank() OVER (PARTITION BY shard_id ORDER BY request_id) AS n FROM item WHERE request_id NOT IN (SELECT request_id FROM crossing))"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """The log as requests, some with two items, with faults: stale versions, replays, missing permission to create, empty writes, a zero type, payloads that don't fit, items on several shards."""
    w = wal(spark, d)
    seq, kind = F.col("wal_seq"), F.col("kind")
    before = w.select("shard_id", (seq + 1).alias("wal_seq"), F.col("kind").alias("before_kind"), F.col("aggregate_id").alias("before_aggregate"))
    several = F.coalesce((seq % 9 == 1) & (kind == "event_batch") & (F.col("before_kind") == "event_batch") & (F.col("before_aggregate") != F.col("aggregate_id")), F.lit(False))
    return w.join(before, ["shard_id", "wal_seq"], "left").select(
        F.when(seq % 97 == 0, seq * 4).when(several, (seq - 1) * 4 + F.col("shard_id")).otherwise(seq * 4 + F.col("shard_id")).alias("request_id"),
        F.when(kind == "event_batch", "write").when(kind == "soft_delete", "delete").otherwise("trim").alias("op"), "aggregate_id", "client_id",
        (F.coalesce("min_client_seq", F.lit(0)) - F.when(seq % 13 == 0, 3).otherwise(0)).alias("first_client_seq"),
        F.when((seq % 59 == 0) | (kind != "event_batch"), 0).otherwise(F.size("events")).cast("long").alias("n_events"), F.when(seq % 71 == 0, 0).otherwise(1).cast("long").alias("min_type"), (seq % 37 != 0).alias("valid"), (seq % 6 != 0).alias("idempotent"), (seq % 5 != 0).alias("allow_create"),
        F.when(seq % 31 == 0, 999_999).cast("long").alias("expected_version"), F.coalesce("keep_from", F.lit(0)).alias("keep_from"), F.coalesce("allow_recreate", F.lit(False)).alias("allow_recreate"), F.coalesce("allow_continuation", F.lit(False)).alias("allow_continuation"),
        F.when(seq % 3 == 0, seq * 4 - 400).alias("durable_upto"), *model.KEY[:2], "user_id", "server_timestamp", "lease_epoch", "node_id", "size", "events",
    )


#: One turn of every shard at a time: what each item of the turn's request meets, whether all can be applied, and the state of every aggregate after it.
_DECIDED = f"""WITH RECURSIVE {_ITEMS.strip().removeprefix('WITH')}, state AS (
  SELECT DISTINCT shard_id, 0::BIGINT AS n, aggregate_id, 0::BIGINT AS version, 0::BIGINT AS event_seq, false AS there, false AS deleted, true AS may, false AS continues, [0, 0, 0, 0, 0]::BIGINT[] AS seqs, [0, 0, 0, 0, 0]::BIGINT[] AS requests, [0, 0, 0, 0, 0]::BIGINT[] AS versions,
    NULL::BIGINT AS request_id, NULL::VARCHAR AS op, NULL::INTEGER AS code FROM turn
  UNION ALL
  SELECT shard_id, n, aggregate_id,
    CASE WHEN writes THEN greatest(CASE WHEN anew THEN 0 ELSE version END, versions[c]) + 1 ELSE version END, CASE WHEN writes THEN CASE WHEN anew THEN 0 ELSE event_seq END + n_events ELSE event_seq END,
    there OR writes, CASE WHEN writes THEN false WHEN ok AND op = 'delete' THEN true ELSE deleted END, CASE WHEN ok AND op = 'delete' THEN allow_recreate ELSE may END, CASE WHEN ok AND op = 'delete' THEN allow_continuation ELSE continues END,
    CASE WHEN writes THEN list_concat(seqs[:c - 1], [greatest(seqs[c], first_client_seq + n_events - 1)], seqs[c + 1:]) ELSE seqs END,
    CASE WHEN writes THEN list_concat(requests[:c - 1], [request_id], requests[c + 1:]) ELSE requests END,
    CASE WHEN writes THEN list_concat(versions[:c - 1], [greatest(CASE WHEN anew THEN 0 ELSE version END, versions[c]) + 1], versions[c + 1:]) ELSE versions END,
    request_id, op, all_code
  FROM (
    SELECT *, ok AND op = 'write' AS writes, deleted AND NOT continues AS anew FROM (
      SELECT *, op IS NOT NULL AND all_code = 0 AS ok FROM (
        SELECT *, coalesce(arg_min(code, aggregate_id) FILTER (WHERE code <> 0) OVER (PARTITION BY shard_id), 0)::INTEGER AS all_code FROM (
          SELECT s.shard_id, s.n + 1 AS n, s.aggregate_id, s.version, s.event_seq, s.there, s.deleted, s.may, s.continues, s.seqs, s.requests, s.versions, t.request_id, t.op, t.n_events, t.first_client_seq, t.allow_recreate, t.allow_continuation, t.client_id + 1 AS c,
            CASE t.op WHEN 'write' THEN CASE WHEN t.n_events <= 0 THEN 2000 WHEN t.min_type = 0 THEN 2001 WHEN NOT there AND NOT t.allow_create THEN 2005 WHEN deleted AND NOT may THEN 2006
                WHEN t.expected_version <> CASE WHEN deleted AND NOT continues THEN 0 ELSE version END THEN 2003
                WHEN t.idempotent AND requests[t.client_id + 1] > 0 AND t.first_client_seq <= seqs[t.client_id + 1] THEN CASE WHEN requests[t.client_id + 1] > t.durable_upto THEN 2013 ELSE 2002 END WHEN NOT t.valid THEN 2022 ELSE 0 END
              WHEN 'trim' THEN CASE WHEN NOT there OR deleted THEN 3000 WHEN t.keep_from > version THEN 3004 ELSE 0 END
              WHEN 'delete' THEN CASE WHEN NOT there OR deleted THEN 4000 WHEN t.expected_version <> version THEN 4002 ELSE 0 END END AS code
          FROM state s LEFT JOIN turn t ON t.shard_id = s.shard_id AND t.n = s.n + 1 AND t.aggregate_id = s.aggregate_id
          WHERE s.n < (SELECT max(n) FROM turn)
        ))))
)"""


@query(f"""{_DECIDED} SELECT shard_id, request_id, aggregate_id, op, code = 0 AS accepted, code, version AS aggregate_version, event_seq FROM state WHERE op IS NOT NULL
UNION ALL SELECT shard_id, request_id, aggregate_id, op, false, 9001, NULL, NULL FROM item WHERE request_id IN (SELECT request_id FROM crossing)""")
def write_decisions(s, d):
    """Accepted, or the code, of each item of all requests."""
    return write.decisions(items(s, d))


@query(f"""{_DECIDED}, done AS (SELECT shard_id, request_id, aggregate_id, op, version, event_seq FROM state WHERE code = 0 AND op IS NOT NULL)
SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY request_id, aggregate_id) AS wal_seq, CASE op WHEN 'write' THEN 'event_batch' WHEN 'delete' THEN 'soft_delete' ELSE 'soft_trim' END AS kind, aggregate_id, version AS aggregate_version,
  CASE WHEN op = 'write' THEN event_seq END AS max_event_seq FROM done""")
def write_log(s, d):
    """The log that the accepted requests make."""
    made = items(s, d)
    return write.log_rows(write.decisions(made), made).select("shard_id", "wal_seq", "kind", "aggregate_id", "aggregate_version", "max_event_seq")


@query("SELECT user_id AS request_id, count(DISTINCT event_id % 4) AS shards, 9001 AS code FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 4) > 1")
def write_cross_shard(s, d):
    return write.crossing(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("aggregate_id")))


# schemas

def _registry(s, d) -> DataFrame:
    e = model.log_events(s.read.parquet(f"{d}/events.parquet"))
    keys = e.where("event_type_major <= 3 AND event_type_minor = 0").groupBy("org_id", "aggregate_type_id", "event_type_major", "event_type_minor").agg(F.min("event_id").alias("wal_seq"))
    return keys.withColumn("schema", F.concat(F.lit("schema-"), F.col("event_type_major").cast("string")))


_REGISTRY = "reg AS (SELECT org_id, aggregate_type_id, event_type_major, event_type_minor, min(event_id) AS wal_seq, 'schema-' || event_type_major AS schema FROM log_event WHERE event_type_major <= 3 AND event_type_minor = 0 GROUP BY 1, 2, 3, 4)"


@query(f"{M}, {_REGISTRY} SELECT event_id, schema FROM log_event LEFT JOIN reg USING (org_id, aggregate_type_id, event_type_major, event_type_minor)")
def schema_lookup(s, d):
    return schemas.lookup(model.log_events(s.read.parquet(f"{d}/events.parquet")), _registry(s, d)).select("event_id", "schema")


@query(f"""{M}, {_REGISTRY}, new AS (SELECT org_id, aggregate_type_id, event_type_major, event_type_minor, event_id AS wal_seq FROM log_event)
SELECT n.*, CASE WHEN r.schema IS NOT NULL OR row_number() OVER (PARTITION BY n.org_id, n.aggregate_type_id, n.event_type_major, n.event_type_minor ORDER BY n.wal_seq) > 1 THEN 2020 ELSE 0 END AS code
FROM new n LEFT JOIN reg r USING (org_id, aggregate_type_id, event_type_major, event_type_minor)""")
def register_schema(s, d):
    new = model.log_events(s.read.parquet(f"{d}/events.parquet")).select("org_id", "aggregate_type_id", "event_type_major", "event_type_minor", F.col("event_id").alias("wal_seq"))
    return schemas.register(_registry(s, d), new).select(*new.columns, "code")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS last_digit FROM events")
def json_payload(s, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", k.alias("k"), (k % 10).alias("last_digit"))


# scalars


@query(f"SELECT DISTINCT user_id, user_id % 8 AS shard, user_id % 7 + 1 AS with_coordinator, (user_id * 1000003 + 12345) % 8 AS of_hex FROM events")
def shard_routing(s, d):
    u = F.col("user_id")
    as_hex = F.lower(F.conv((u * 1_000_003 + 12_345).cast("string"), 10, 16))
    return s.read.parquet(f"{d}/events.parquet").select("user_id").distinct().select("user_id", scalars.shard_of(u, 8).alias("shard"), scalars.shard_of(u, 8, True).alias("with_coordinator"), scalars.shard_of_hex(as_hex, 8).alias("of_hex"))


@query("SELECT user_id, " + " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in range(15, -1, -1)) + " AS identity FROM (SELECT DISTINCT user_id, sha256(CAST(user_id AS VARCHAR)) AS h FROM events)")
def client_identity(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("user_id").distinct().select("user_id", scalars.client_identity(F.col("user_id").cast("string")).alias("identity"))


@query(f"{M} SELECT event_id, '[t-' || aggregate_id || '-s-' || client_seq || ']' AS payload FROM event")
def check_payload(s, d):
    return events(s, d).select("event_id", scalars.payload(F.col("aggregate_id"), F.col("client_seq")).alias("payload"))


_PATHS = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'shard_x/batch_' || event_id || '.bin' ELSE 'shard_' || (user_id % 4) || '/batch_' || event_id || '_' || (event_id + 7) || '_u' || user_id || '.bin' END AS path FROM events"


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN user_id % 4 END AS shard, CASE WHEN event_id % 9 <> 0 THEN event_id END AS first_seq, CASE WHEN event_id % 9 <> 0 THEN event_id + 7 END AS last_seq FROM events")
def parse_batch_path(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    path = F.when(i % 9 == 0, F.format_string("shard_x/batch_%d.bin", i)).otherwise(F.format_string("shard_%d/batch_%d_%d_u%d.bin", u % 4, i, i + 7, u))
    shard, first, last = scalars.batch_path(F.col("path"))
    return e.select("event_id", path.alias("path")).select("event_id", shard.alias("shard"), first.alias("first_seq"), last.alias("last_seq"))


_LINES = "'ERROR shard ' || (user_id % 4) || ' ' || event_type || ' at ' || event_id"


def _lines(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.format_string("ERROR shard %d %s at %d", F.col("user_id") % 4, F.col("event_type"), F.col("event_id")).alias("line"))


@query(f"SELECT regexp_replace({_LINES}, '[0-9]+', '#', 'g') AS line, count(*) AS n FROM events GROUP BY 1")
def normalize_log(s, d):
    return _lines(s, d).groupBy(scalars.normalised(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT regexp_replace({_LINES}, '[0-9]+', '#', 'g') AS line, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 2000")
def error_storm(s, d):
    return checkers.error_storm(_lines(s, d), 2000)


# set operations


@query(f"{H}, present AS (SELECT aggregate_id, aggregate_version FROM wal WHERE kind = 'event_batch' AND wal_seq % 17 <> 0) SELECT DISTINCT aggregate_id, acked_version FROM op WHERE outcome = 'ok' AND (aggregate_id, acked_version) NOT IN (SELECT aggregate_id, aggregate_version FROM present)")
def acked_missing(s, d):
    present = wal(s, d).where("kind = 'event_batch' AND wal_seq % 17 <> 0").select("aggregate_id", F.col("aggregate_version").alias("acked_version"))
    return ops(s, d).where("outcome = 'ok'").select("aggregate_id", "acked_version").distinct().join(present, ["aggregate_id", "acked_version"], "left_anti")


@query(f"{M} SELECT CASE WHEN wal_seq % 19 = 0 THEN 'left' ELSE 'right' END AS side, shard_id, wal_seq FROM wal WHERE (wal_seq % 19 = 0) <> (wal_seq % 23 = 0)")
def parity_diff(s, d):
    w = wal(s, d).select("shard_id", "wal_seq")
    left, right = w.where("wal_seq % 23 <> 0"), w.where("wal_seq % 19 <> 0")
    side = lambda name, df: df.select(F.lit(name).alias("side"), "shard_id", "wal_seq")
    return side("left", left.exceptAll(right)).unionByName(side("right", right.exceptAll(left)))


@query(f"{M} SELECT DISTINCT aggregate_id FROM wal WHERE log_id = 1 AND aggregate_id IN (SELECT aggregate_id FROM wal WHERE kind <> 'event_batch')")
def intersect_keys(s, d):
    w = wal(s, d)
    return w.where("log_id = 1").select("aggregate_id").intersect(w.where("kind <> 'event_batch'").select("aggregate_id"))


@query(f"{M} SELECT DISTINCT aggregate_id, client_id FROM wal WHERE kind = 'event_batch' AND wal_seq > 200 AND (aggregate_id, client_id) NOT IN (SELECT aggregate_id, client_id FROM wal WHERE kind = 'event_batch' AND wal_seq <= 200)")
def new_clients(s, d):
    pairs = wal(s, d).where("kind = 'event_batch'").select("aggregate_id", "client_id", "wal_seq")
    return pairs.groupBy("aggregate_id", "client_id").agg(F.min("wal_seq").alias("first")).where("first > 200").select("aggregate_id", "client_id")


# checkers


@query(f"{H} SELECT aggregate_id, client_id, client_seq, count(*) AS acks FROM op WHERE outcome = 'ok' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def check_duplicate_acks(s, d):
    return checkers.duplicate_acks(ops(s, d))


@query(f"{H} SELECT 'acked' AS kind, aggregate_id, acked_version AS version, count(*) AS n FROM op WHERE outcome = 'ok' GROUP BY 2, 3 HAVING count(*) > 1 UNION ALL SELECT 'expected', aggregate_id, expected_version, count(*) FROM op WHERE outcome = 'ok' GROUP BY 2, 3 HAVING count(*) > 1")
def check_occ(s, d):
    return checkers.occ(ops(s, d))


@query(f"{H}, stored AS (SELECT aggregate_id, max(aggregate_version) AS stored FROM wal WHERE kind = 'event_batch' AND wal_seq % 3 <> 0 GROUP BY 1) SELECT aggregate_id, greatest(acked - coalesce(stored, 0), 0) AS missing FROM acked LEFT JOIN stored USING (aggregate_id)")
def check_seq_gaps(s, d):
    stored = wal(s, d).where("kind = 'event_batch' AND wal_seq % 3 <> 0").groupBy("aggregate_id").agg(F.max("aggregate_version").alias("stored"))
    return checkers.seq_gaps(ops(s, d), stored)


@query(f"""{H}, f AS (SELECT op_id, aggregate_id, client_id, client_seq, outcome, error, coalesce(max(CASE WHEN outcome IN ('ok', 'info') THEN client_seq END) OVER (PARTITION BY aggregate_id, client_id ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high FROM op)
SELECT aggregate_id, client_id, client_seq, op_id FROM f WHERE error = 2002 AND client_seq > high""")
def check_idempotency(s, d):
    return checkers.idempotency(ops(s, d))


@query(f"{H} SELECT node, aggregate_id, max_version, acked FROM final JOIN acked USING (aggregate_id) WHERE max_version IS NOT NULL AND max_version NOT BETWEEN acked AND acked + 1")
def check_wal_monotonicity(s, d):
    o = ops(s, d)
    return checkers.wal_monotonicity(o, history.finals(o)).withColumn("node", F.col("node").cast("int"))


@query(f"{H} SELECT aggregate_id, min(max_version) AS low, max(max_version) AS high FROM final WHERE max_version IS NOT NULL GROUP BY 1 HAVING min(max_version) <> max(max_version)")
def check_parity(s, d):
    return checkers.parity(history.finals(ops(s, d)))


@query(f"{H} SELECT aggregate_id, coalesce(bool_and(max_version < acked), false) AS breach FROM final JOIN acked USING (aggregate_id) GROUP BY 1")
def check_trim_breach(s, d):
    o = ops(s, d)
    return checkers.trim_breach(o, history.finals(o))


@query(f"{H} SELECT probe_id, count(DISTINCT node) FILTER (WHERE observed_version IS NOT NULL) AS nodes FROM probe WHERE t_ns NOT BETWEEN {T0 + 864_000_000} AND {T0 + 1_296_000_000} GROUP BY 1 HAVING count(DISTINCT node) FILTER (WHERE observed_version IS NOT NULL) >= 2 AND bool_and(observed_version < acked_version) FILTER (WHERE observed_version IS NOT NULL)")
def check_ryw(s, d):
    excluded = s.range(1).select(F.lit(T0 + 864_000_000).alias("low"), F.lit(T0 + 1_296_000_000).alias("high"))
    return checkers.ryw(history.probes(wal(s, d)), excluded)


@query(f"{H}, l AS (SELECT delivery_id, aggregate_id, from_version, lag(to_version) OVER (PARTITION BY connection, aggregate_id ORDER BY t_ns, delivery_id) AS before FROM delivery) SELECT * FROM l WHERE from_version <= before")
def check_watch_order(s, d):
    return checkers.watch_order(history.deliveries(wal(s, d)))


@query(f"{H}, f AS (SELECT aggregate_id, max(max_version) AS final FROM final GROUP BY 1) SELECT CASE WHEN final IS NULL THEN 'unknown' WHEN to_version > final THEN 'lost' ELSE 'durable' END AS verdict, count(*) AS n FROM delivery LEFT JOIN f USING (aggregate_id) GROUP BY 1")
def check_watch_durable(s, d):
    w = wal(s, d)
    return checkers.watch_durable(history.deliveries(w), history.finals(history.operations(w)))


@query(f"{H} SELECT tick, CAST(sum(role) AS BIGINT) AS leaders FROM sample GROUP BY 1 HAVING bool_and(ok) AND sum(role) <> 1")
def check_one_leader(s, d):
    return checkers.one_leader(samples(s, d))


@query(f"{H}, l AS (SELECT host, t_ms FROM sample WHERE ok AND role = 1) SELECT arg_min(host, t_ms) AS first_leader, arg_max(host, t_ms) AS last_leader, arg_min(host, t_ms) = arg_max(host, t_ms) AS retained FROM l")
def check_leader_retained(s, d):
    return checkers.leader_retained(samples(s, d)).withColumns({c: F.col(c).cast("int") for c in ("first_leader", "last_leader")})


@query(f"{H} SELECT count(DISTINCT host) AS leaders FROM sample WHERE ok AND role = 1")
def distinct_leaders(s, d):
    return checkers.distinct_leaders(samples(s, d))


@query(f"{H}, t AS (SELECT tick, max(role) AS led, min(t_ms) AS t_ms FROM sample GROUP BY 1 HAVING bool_and(ok)), i AS (SELECT *, sum(led) OVER (ORDER BY tick) AS island FROM t), g AS (SELECT max(t_ms) - min(t_ms) AS ms FROM i WHERE led = 0 GROUP BY island) SELECT coalesce(max(ms), 0) AS longest_ms FROM g")
def longest_gap(s, d):
    return checkers.longest_gap(samples(s, d))


@query(f"""{H}, g AS (SELECT * FROM sample WHERE ok), l AS (SELECT host, arg_max(read_seq, t_ms) AS last, max(t_ms) AS t FROM g GROUP BY 1), e AS (SELECT g.host, arg_max(read_seq, t_ms) AS earlier FROM g JOIN l ON g.host = l.host AND t_ms <= t - 36000000 GROUP BY 1),
h AS (SELECT l.host, last, last > coalesce(earlier, 0) AS advanced FROM l LEFT JOIN e USING (host)) SELECT min(last) AS low, max(last) AS high, min(last) = max(last) OR arg_min(advanced, (last, host)) AS converged FROM h""")
def check_convergence(s, d):
    return checkers.convergence(samples(s, d))


@query(f"""{H}, p AS (SELECT tick, max(CASE WHEN role = 1 THEN read_seq END) AS leader, max(CASE WHEN role = 0 THEN read_seq END) AS follower FROM sample WHERE ok GROUP BY 1),
r AS (SELECT tick, follower, max(leader) OVER (ORDER BY tick) AS high FROM p), a AS (SELECT *, coalesce(follower > high, false) AS ahead, lag(coalesce(follower > high, false)) OVER (ORDER BY tick) AS before FROM r) SELECT tick, follower, high FROM a WHERE ahead AND before""")
def check_never_ahead(s, d):
    return checkers.never_ahead(samples(s, d))


@query(f"{H}, b AS (SELECT host, tick, read_seq > write_seq AS bad, lag(read_seq > write_seq) OVER (PARTITION BY host ORDER BY tick) AS before FROM sample) SELECT host, tick FROM b WHERE bad AND before")
def check_read_within_write(s, d):
    return checkers.read_within_write(samples(s, d)).withColumn("host", F.col("host").cast("int"))


@query(f"{H} SELECT host, greatest(arg_max(write_seq, t_ms) - arg_min(write_seq, t_ms), 0) AS delta FROM sample WHERE ok GROUP BY 1")
def counter_delta(s, d):
    return checkers.counter_delta(samples(s, d)).withColumn("host", F.col("host").cast("int"))


@query(f"{H}, g AS (SELECT host, t_ms - lag(t_ms) OVER (PARTITION BY host ORDER BY t_ms) AS gap FROM sample WHERE ok) SELECT host, quantile_cont(gap, 0.5) AS median_ms FROM g GROUP BY 1")
def median_tick(s, d):
    return checkers.median_tick(samples(s, d)).withColumn("host", F.col("host").cast("int"))


@query(f"{H} SELECT floor(quantile_cont(t_end - t_start, 0.5)) AS p50, floor(quantile_cont(t_end - t_start, 0.95)) AS p95, floor(quantile_cont(t_end - t_start, 0.99)) AS p99, count(*) AS n FROM op")
def latency_percentiles(s, d):
    took = F.col("t_end") - F.col("t_start")
    p = F.percentile(took, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return ops(s, d).agg(p.alias("p"), F.count(F.lit(1)).alias("n")).select(*[F.floor(F.col("p")[i]).cast("double").alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "n")


@query(f"{H}, present AS (SELECT aggregate_id, aggregate_version AS seq FROM wal WHERE kind = 'event_batch' AND wal_seq % 17 <> 0) SELECT aggregate_id, seq FROM (SELECT aggregate_id, unnest(range(1, acked + 1)) AS seq FROM acked) WHERE (aggregate_id, seq) NOT IN (SELECT aggregate_id, seq FROM present)")
def disk_truth(s, d):
    acked = ops(s, d).where("outcome = 'ok'").groupBy("aggregate_id").agg(F.max("acked_version").alias("acked"))
    batches = wal(s, d).where("kind = 'event_batch'").select("aggregate_id", F.col("aggregate_version").alias("seq"), "wal_seq")
    nodes = batches.where("wal_seq % 17 <> 0 AND wal_seq % 2 = 0").unionByName(batches.where("wal_seq % 17 <> 0"))
    return checkers.disk_truth(acked, nodes)


@query(f"{M}, p AS (SELECT aggregate_id, client_id, client_seq AS seq, aggregate_version FROM event UNION ALL SELECT aggregate_id, client_id, client_seq, aggregate_version + 1 FROM event WHERE event_id % 101 = 0) SELECT aggregate_id, client_id, seq, count(DISTINCT aggregate_version) AS versions FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT aggregate_version) > 1")
def deep_audit(s, d):
    p = events(s, d).select("aggregate_id", "client_id", F.col("client_seq").alias("seq"), "aggregate_version", "event_id")
    return checkers.several_versions(p.unionByName(p.where("event_id % 101 = 0").withColumn("aggregate_version", F.col("aggregate_version") + 1)))


# orders as aggregates, their lines as events: the model at a larger size


@query("""SELECT l_orderkey AS aggregate_id, count(*) AS n_events, max(l_linenumber) AS last_seq, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS amount, o_orderstatus AS state
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 5""", "orders_as_aggregates")
def orders_as_aggregates(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_events"), F.max("l_linenumber").alias("last_seq"), F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("amount"))
    heads = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("aggregate_id"), "n_events", "last_seq", F.col("amount").cast("long").alias("amount"), F.col("o_orderstatus").alias("state"))
