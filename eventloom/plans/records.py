"""More queries of the log: stores and files, positions and rotation, payloads, chains that were cut, reports of checkers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import binary, scalars, schemas
from eventloom.operators import chain, checkers, listing, read, write
from eventloom.operators.read import ReadFilters
from eventloom.plans import model
from eventloom.plans.catalog import _BATCH, _SCAN, BATCH, SCAN, H, L, M, T0, events, log, ops, query, samples, shared, wal
from eventloom.sources import inline, wire
from eventloom.sources.store import Store, read_history, write_history
from eventloom.streaming import watch

# scans and sources


@query(f"{SCAN} WHERE shard_id = 2 ORDER BY wal_seq LIMIT 300")
def scan_forward(s, d):
    return wal(s, d).where("shard_id = 2").orderBy("wal_seq").limit(300).select(*_SCAN)


@query(f"{M} SELECT DISTINCT shard_id FROM wal")
def list_shards(s, d):
    return wal(s, d).select("shard_id").distinct()


@query(f"{M} SELECT shard_id, wal_seq, aggregate_id, n_events FROM wal WHERE kind = 'event_batch' AND wal_seq % 50 = 7")
def fetch_positions(s, d):
    w = wal(s, d)
    wanted = w.where("wal_seq % 50 = 7 AND kind = 'event_batch'").select("shard_id", "wal_seq")
    return read.fetched(w, wanted.unionByName(wanted)).select("shard_id", "wal_seq", "aggregate_id", F.size("events").cast("long").alias("n_events"))


@query(f"{L} SELECT {BATCH}, n_events FROM live WHERE client_id = 3 AND aggregate_version >= 4")
def payload_fetch(s, d):
    """Batches picked by their metadata, with payloads fetched for these only."""
    return read.with_payloads(log(s, d), ReadFilters(from_version=4, include_client=3)).select(*_BATCH, F.size("events").cast("long").alias("n_events"))


@query(f"{M} SELECT {BATCH} FROM wal WHERE kind = 'event_batch' AND aggregate_version >= 3")
def read_recent_union(s, d):
    """Recent writes in memory and the store, which overlap: each version once."""
    w = wal(s, d).where("kind = 'event_batch' AND aggregate_version >= 3").select(*_BATCH)
    return read.union_recent(w.where("wal_seq > 150"), w.where("wal_seq <= 250"))


@query(f"{M} SELECT shard_id, wal_seq, kind, aggregate_id, CASE WHEN kind = 'event_batch' THEN n_events END AS n_events FROM wal WHERE wal_seq <= 400")
def store_round_trip(s, d):
    """The log written to a store in two appends and read as of its commit."""
    store = Store(s, f"{shared(s)}/store")
    w = wal(s, d)
    store.append(w.where("wal_seq <= 200"))
    store.commit()
    store.append(w.where("wal_seq > 200"))
    store.commit({i: 400 for i in range(model.SHARDS)})
    return store.wal().select("shard_id", "wal_seq", "kind", "aggregate_id", F.when(F.col("kind") == "event_batch", F.size("events")).cast("long").alias("n_events"))


@query(f"{M} SELECT shard_id, log_id, wal_seq, kind FROM wal WHERE aggregate_id = 11 AND kind <> 'soft_trim'")
def summary_pruned_read(s, d):
    """An aggregate read from the segments that their stored summaries name, and from those written later."""
    store = Store(s, f"{shared(s)}/store")
    w = wal(s, d)
    store.append(w.where("log_id < 2"))
    store.commit()
    store.write_summaries()
    store.append(w.where("log_id >= 2"))
    store.commit()
    return store.of_aggregate(11).select("shard_id", "log_id", "wal_seq", "kind")


@query(f"{M}, sized AS (SELECT *, sum(coalesce(size, 0)) OVER (PARTITION BY shard_id ORDER BY wal_seq) - coalesce(size, 0) AS bytes FROM wal) SELECT shard_id, wal_seq, CAST(bytes // 20000 AS BIGINT) + 1 AS segment FROM sized")
def rotate_by_size(s, d):
    return model.rotated(wal(s, d), 20_000, "segment", bucket_rows=100).select("shard_id", "wal_seq", "segment")


@query(f"{H} SELECT op_id, aggregate_id, client_id, client_seq, outcome, error FROM op")
def history_round_trip(s, d):
    """A history written as tagged JSON lines beside records of another kind, and read back."""
    path = f"{shared(s)}/history"
    o = ops(s, d)
    write_history(o.select(F.lit("op").alias("type"), F.col("op_id").alias("process"), F.col("aggregate_id").cast("string").alias("agg_id"), F.col("client_id").cast("string").alias("client_id"), "client_seq", "outcome", F.col("error").cast("long").alias("error")), path)
    write_history(o.select(F.lit("ryw").alias("type"), F.col("op_id").alias("probe_id")), path)
    got = read_history(s, path, "op")
    return got.select(F.col("process").alias("op_id"), F.col("agg_id").cast("long").alias("aggregate_id"), F.col("client_id").cast("long").alias("client_id"), "client_seq", "outcome", F.col("error").cast("int").alias("error"))


@query(f"{M} SELECT json_object('aggregate_id', aggregate_id, 'batches', count(*)) AS json FROM batch GROUP BY aggregate_id")
def json_output(s, d):
    rows = wal(s, d).where("kind = 'event_batch'").groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("batches"))
    return inline.as_json(rows)


@query("SELECT event_id, event_type, user_id, 3 AS version, 7 AS message_type FROM events")
def wire_frames(s, d):
    """Every event as a compressed frame, and read back from it."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "user_id")
    got = wire.decoded(wire.encoded(e, 7, compression=1))
    return got.select(F.from_json("json", "event_id bigint, event_type string, user_id bigint").alias("e"), "version", F.col("message_type").cast("int").alias("message_type")).select("e.*", "version", "message_type")


@query(f"{M}, k AS (SELECT DISTINCT aggregate_id, client_id FROM wal WHERE kind = 'event_batch') SELECT * FROM k WHERE (aggregate_id, client_id) NOT IN (SELECT aggregate_id, client_id FROM wal WHERE kind = 'event_batch' AND (log_id = 1 OR wal_seq % 3 = 0))")
def absent_clients(s, d):
    """Clients of an aggregate that none of several sources holds: not the first segment, not a cache of every third row."""
    w = wal(s, d).where("kind = 'event_batch'")
    return listing.absent(w.select("aggregate_id", "client_id").distinct(), w.where("log_id = 1"), w.where("wal_seq % 3 = 0"))


# listings


_FIRST = """a AS (SELECT shard_id, max(log_id) AS log_id, min(log_id) AS oldest FROM log GROUP BY 1), r AS (SELECT l.*, oldest FROM log l JOIN a USING (shard_id, log_id)),
c AS (SELECT shard_id, CASE WHEN any_value(oldest) < any_value(log_id) THEN min(wal_seq) END AS cursor FROM r GROUP BY 1),
dead AS (SELECT aggregate_id, max(wal_seq) AS delete_seq FROM r WHERE kind = 'soft_delete' GROUP BY 1)"""


@query(f"{L}, {_FIRST} SELECT r.shard_id, aggregate_id, any_value(cursor) AS cursor, count(CASE WHEN kind = 'event_batch' AND wal_seq > coalesce(delete_seq, 0) THEN 1 END) AS batch_count FROM r JOIN c USING (shard_id) LEFT JOIN dead USING (aggregate_id) GROUP BY 1, 2 HAVING bool_or(kind <> 'soft_trim')")
def list_first_page(s, d):
    """The uncapped first answer of a listing."""
    return listing.first_page(log(s, d)).select("shard_id", "aggregate_id", "cursor", "batch_count")


@query(f"""{M}, z AS (SELECT shard_id, log_id, aggregate_id, count(DISTINCT client_id) * 8 + 4 AS size FROM wal GROUP BY 1, 2, 3),
r AS (SELECT *, sum(size) OVER (PARTITION BY shard_id, log_id) - coalesce(sum(size - 4) OVER (PARTITION BY shard_id, log_id ORDER BY size DESC, aggregate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM z)
SELECT shard_id, log_id, aggregate_id, size, rest <= 150 AS known FROM r""")
def cap_client_sets(s, d):
    return listing.capped_client_sets(wal(s, d), 150)


@query(f"{L} SELECT aggregate_id, max(aggregate_version) AS version, max(max_event_seq) AS event_seq FROM log LEFT JOIN incarnation USING (aggregate_id) WHERE kind = 'event_batch' AND wal_seq > coalesce(start, 0) GROUP BY 1")
def write_state(s, d):
    """What a write to each aggregate begins from."""
    return write.known(log(s, d)).where("op = 'state'").select("aggregate_id", F.col("expected_version").alias("version"), F.col("n_events").alias("event_seq"))


_SCRIPT = [  # request, op, aggregate, client, first sequence, events, type, valid, idempotent, may create, expected version, keep from, may recreate, continues, durable; then code, version, event sequence
    (1, "write", 4, 1, 1, 1, 1, True, True, True, 0, 0, True, False, None, 0, 1, 1),
    (1, "write", 8, 1, 1, 1, 1, True, True, True, 0, 0, True, False, None, 0, 1, 1),
    (2, "write", 4, 1, 2, 1, 1, True, False, False, 1, 0, True, False, None, 2003, 1, 1),  # 8 is stale, so 4 doesn't change
    (2, "write", 8, 1, 2, 1, 1, True, False, False, 0, 0, True, False, None, 2003, 1, 1),
    (3, "write", 4, 2, 1, 2, 1, True, True, False, 1, 0, True, False, None, 0, 2, 3),  # another client begins at its own sequence
    (4, "write", 4, 1, 1, 1, 1, True, True, False, None, 0, True, False, None, 2002, 2, 3),
    (5, "write", 4, 1, 1, 1, 1, True, False, False, None, 0, True, False, None, 0, 3, 4),  # not enforced
    (6, "write", 4, 2, 2, 1, 1, True, True, False, None, 0, True, False, 2, 2013, 3, 4),  # request 3 isn't known to be durable
    (7, "write", 4, 2, 9, 1, 1, False, True, False, None, 0, True, False, None, 2022, 3, 4),
    (8, "delete", 4, 1, 0, 0, 0, True, True, False, 3, 0, False, False, None, 4002, 3, 4),  # of 8, the expected version is stale
    (8, "delete", 8, 1, 0, 0, 0, True, True, False, 9, 0, False, False, None, 4002, 1, 1),
    (9, "delete", 4, 1, 0, 0, 0, True, True, False, 3, 0, True, False, None, 0, 3, 4),
    (10, "write", 4, 3, 1, 1, 1, True, True, True, 0, 0, True, False, None, 0, 1, 1),  # anew
    (11, "write", 4, 1, 5, 1, 1, True, True, False, None, 0, True, False, None, 0, 4, 2),  # a client that comes back goes on past its last version
    (12, "trim", 4, 1, 0, 0, 0, True, True, False, None, 9, True, False, None, 3004, 4, 2),
    (13, "trim", 4, 1, 0, 0, 0, True, True, False, None, 2, True, False, None, 0, 4, 2),
    (14, "delete", 8, 1, 0, 0, 0, True, True, False, None, 0, False, False, None, 0, 1, 1),
    (15, "write", 8, 1, 7, 1, 1, True, True, True, None, 0, True, False, None, 2006, 1, 1),
    (16, "write", 12, 1, 1, 1, 1, True, True, False, None, 0, True, False, None, 2005, 0, 0),
    (17, "write", 12, 1, 1, 0, 1, True, True, True, None, 0, True, False, None, 2000, 0, 0),
    (18, "write", 12, 1, 1, 1, 0, True, True, True, None, 0, True, False, None, 2001, 0, 0),
    (19, "write", 5, 1, 1, 1, 1, True, True, True, None, 0, True, False, None, 9001, None, None),  # on another shard than 12
    (19, "write", 12, 1, 1, 1, 1, True, True, True, None, 0, True, False, None, 9001, None, None),
    (20, "trim", 12, 1, 0, 0, 0, True, True, False, None, 1, True, False, None, 3000, 0, 0),
    (21, "delete", 12, 1, 0, 0, 0, True, True, False, None, 0, True, False, None, 4000, 0, 0),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {r[2]}, {r[15]}, {'NULL' if r[16] is None else r[16]}, {'NULL' if r[17] is None else r[17]})" for r in _SCRIPT) + ") AS t(request_id, aggregate_id, code, aggregate_version, event_seq)")
def write_script(s, d):
    """A fixed script of requests, atomic ones among them, decided one by one."""
    made = s.createDataFrame([r[:15] for r in _SCRIPT], write.ITEM_SCHEMA)
    return write.decisions(made).select("request_id", "aggregate_id", "code", "aggregate_version", "event_seq")


# payloads


_LIMITS = {1: '{"type": "object", "properties": {"k": {"type": "integer", "maximum": 80}}, "required": ["k"]}', 2: '{"type": "object", "properties": {"k": {"type": "integer", "minimum": 20}}}', 3: '{"type": "object", "properties": {"z": {"type": "string"}}, "required": ["z"]}'}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"{M} SELECT event_id, CASE WHEN event_type_minor = 1 THEN true WHEN event_type_major = 1 THEN {_K} <= 80 WHEN event_type_major = 2 THEN {_K} >= 20 WHEN event_type_major = 3 THEN false ELSE true END AS valid FROM log_event")
def schema_valid(s, d):
    """Every payload by the schema that is registered for its key; keys without one are not validated."""
    e = model.log_events(s.read.parquet(f"{d}/events.parquet"))
    major = F.col("event_type_major")
    text = F.coalesce(*[F.when(major == k, F.lit(v)) for k, v in _LIMITS.items()])
    registry = e.where(major.isin(*_LIMITS) & (F.col("event_type_minor") == 0)).select("org_id", "aggregate_type_id", "event_type_major", "event_type_minor").distinct().withColumn("schema", text)
    return schemas.validate_all(e, registry).select("event_id", "valid")


_RECORD = '{"type": "record", "name": "E", "fields": [{"name": "k", "type": "long"}, {"name": "kind", "type": "string"}]}'
_MESSAGE = "syntax = 'proto3'; message E { string kind = 1; int64 k = 2; }"
_DAMAGED = "SELECT event_id, NOT (event_id % 7 = 0 OR event_id % 11 = 0) AS valid FROM events"


def _payload(s, d, parts, more: str) -> DataFrame:
    """Payloads built from an event, every seventh cut short and every eleventh with bytes that don't belong there."""
    e = s.read.parquet(f"{d}/events.parquet")
    whole = F.concat(*parts(F.pmod("event_id", F.lit(60)), F.encode("event_type", "utf-8"), F.char_length("event_type")))
    i = F.col("event_id")
    cut = F.substring(whole, F.lit(1), F.octet_length(whole) - 1)
    return e.select("event_id", F.when(i % 7 == 0, cut).when(i % 11 == 0, F.concat(whole, F.unhex(F.lit(more)))).otherwise(whole).alias("payload"))


def _byte(value):
    return F.unhex(F.lpad(F.hex(value), 2, "0"))


@query(_DAMAGED)
def schema_valid_avro(s, d):
    binary.ship(s)
    rows = _payload(s, d, lambda k, text, n: (_byte(2 * k), _byte(2 * n), text), "00")
    return rows.select("event_id", binary.valid_avro(F.col("payload"), _RECORD).alias("valid"))


@query(_DAMAGED)
def schema_valid_protobuf(s, d):
    binary.ship(s)
    rows = _payload(s, d, lambda k, text, n: (F.unhex(F.lit("0a")), _byte(n), text, F.unhex(F.lit("10")), _byte(k)), "08")
    return rows.select("event_id", binary.valid_protobuf(F.col("payload"), _MESSAGE).alias("valid"))


@query("SELECT event_id FROM events WHERE event_id % 41 = 0")
def check_checksums(s, d):
    """Payloads that were altered after their checksum was taken."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.encode("props", "utf-8").alias("content"))
    sealed = e.withColumn("checksum", F.crc32("content"))
    spoilt = sealed.withColumn("content", F.when(F.col("event_id") % 41 == 0, F.concat("content", F.encode(F.lit("!"), "utf-8"))).otherwise(F.col("content")))
    return checkers.altered(spoilt, "content", "checksum").select("event_id")


# scalars


_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
_DIGEST = f"sha1(unhex('{_NAMESPACE.replace('-', '')}') || encode('account-' || user_id))"


@query(f"""SELECT user_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT DISTINCT user_id, {_DIGEST} AS h FROM events)""")
def uuid5_ids(s, d):
    users = s.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.select("user_id", scalars.uuid5(_NAMESPACE, F.concat(F.lit("account-"), F.col("user_id").cast("string"))).alias("id"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 1000 - 1600000000000 AS ms_since FROM events")
def time_units(s, d):
    t = F.col("ts")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", scalars.since_epoch(t).alias("ms"), scalars.since_epoch(t, "us").alias("us"), scalars.since_epoch(t, "ns").alias("ns"), scalars.since_epoch(t, "ms", 1_600_000_000).alias("ms_since"))


@query("SELECT user_id, lpad(lower(hex(user_id * 1000003)), 32, '0') AS id, to_base64(encode('u-' || user_id)) AS encoded, 'u-' || user_id AS decoded FROM (SELECT DISTINCT user_id FROM events)")
def id_conversion(s, d):
    users = s.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    text = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    encoded = F.base64(F.encode(text, "utf-8"))
    return users.select("user_id", scalars.hex_id((F.col("user_id") * 1_000_003).cast("string")).alias("id"), encoded.alias("encoded"), F.decode(F.unbase64(encoded), "utf-8").alias("decoded"))


@query(f"{M} SELECT aggregate_id, aggregate_version, count(DISTINCT event_type_major) AS types, min(event_type_major) AS low, max(event_type_major) AS high, bool_or(event_type_major = 3) AS buys FROM event GROUP BY 1, 2")
def type_arrays(s, d):
    t = F.col("event_types")
    return wal(s, d).where("kind = 'event_batch'").select("aggregate_id", "aggregate_version", F.size(t).cast("long").alias("types"), F.array_min(t).alias("low"), F.array_max(t).alias("high"), F.array_contains(t, F.lit(3).cast("long")).alias("buys"))


@query(f"""{M}, u AS (SELECT *, lpad(lower(hex(aggregate_id)), 32, '0') AS h FROM event)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS aggregate, aggregate_version, event_seq FROM u""")
def demo_event_list(s, d):
    return events(s, d).select("event_id", scalars.hyphened(scalars.hex_id(F.col("aggregate_id").cast("string"))).alias("aggregate"), "aggregate_version", "event_seq")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'panicked at' ELSE 'FATAL' END AS marker FROM events WHERE event_type = 'error' OR event_id % 10 = 3")
def marked_lines(s, d):
    fatal = F.when(F.col("event_id") % 10 == 3, "FATAL ").otherwise("")
    lines = s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(fatal, F.when(F.col("event_type") == "error", "thread panicked at main").otherwise("fine")).alias("line"))
    return checkers.marked_lines(lines, ("panicked at", "FATAL")).select("event_id", "marker")


# chains


@query(f"{M} SELECT shard_id, wal_seq FROM wal WHERE wal_seq = 3 OR wal_seq > 3 AND wal_seq % 50 = 1")
def check_chain_cut(s, d):
    """A chain without its first two rows and without every fiftieth: the first row that is left and each one after a gap are found."""
    return chain.breaks(chain.made(wal(s, d)).where("wal_seq > 2 AND wal_seq % 50 <> 0"))


def _forked(s, d) -> tuple[DataFrame, DataFrame]:
    """Our chain, and one that goes its own way from 97 on and has lost row 150."""
    w = wal(s, d)
    theirs = chain.made(w.withColumn("server_timestamp", F.col("server_timestamp") + (F.col("wal_seq") >= 97).cast("long")))
    return chain.made(w), theirs.where("wal_seq <> 150")


@query(f"{M} SELECT shard_id, wal_seq FROM wal WHERE wal_seq < 97")
def divergence_truncate(s, d):
    return chain.truncated(*_forked(s, d)).select("shard_id", "wal_seq")


@query(f"{M} SELECT shard_id, wal_seq, kind || '|' || aggregate_id || '|' || aggregate_version || '|' || (server_timestamp + CASE WHEN wal_seq >= 97 THEN 1 ELSE 0 END) AS content FROM wal WHERE wal_seq < 150")
def replication_reconcile(s, d):
    """Our log after following the other: cut back to where they part, then theirs up to its gap."""
    return chain.reconciled(*_forked(s, d)).select("shard_id", "wal_seq", "content")


# checkers


@query(f"{H}, b AS (SELECT host, tick, role, lag(role) OVER (PARTITION BY host ORDER BY tick) AS before FROM sample WHERE tick IN (SELECT tick FROM sample GROUP BY 1 HAVING bool_and(ok))) SELECT host, count(CASE WHEN role <> before THEN 1 END) AS flips FROM b GROUP BY 1")
def role_flips(s, d):
    return checkers.role_flips(samples(s, d)).withColumn("host", F.col("host").cast("int"))


@query(f"""{H}, g AS (SELECT host, t_ms, role, write_seq % 400 AS n FROM sample WHERE ok), l AS (SELECT arg_max(host, (t_ms, host)) AS host FROM g WHERE role = 1),
o AS (SELECT g.*, coalesce(n < lag(n) OVER (ORDER BY t_ms), false) AS fell FROM g JOIN l USING (host)), st AS (SELECT coalesce(max(CASE WHEN fell THEN t_ms END), min(t_ms)) AS start FROM o),
f AS (SELECT host, arg_min(n, t_ms) FILTER (WHERE role = 1 AND t_ms >= start) AS first_count, arg_max(n, t_ms) FILTER (WHERE t_ms <= {T0 + 29 * 86_400_000}) AS last_count, min(t_ms) FILTER (WHERE role = 1 AND t_ms >= start) > {T0 + 29 * 86_400_000} AS late FROM o, st GROUP BY 1)
SELECT host, first_count, last_count, coalesce(late OR last_count > first_count, false) AS wrote FROM f""")
def check_final_leader_wrote(s, d):
    """With a counter that begins anew now and then, as after a restart."""
    restarted = samples(s, d).withColumn("write_seq", F.col("write_seq") % 400)
    return checkers.final_leader_wrote(restarted, T0 + 29 * 86_400_000).withColumn("host", F.col("host").cast("int"))


@query(f"{H} SELECT arg_min(write_seq, (t_ms, host)) AS first, arg_max(write_seq, (t_ms, host)) AS last, arg_max(write_seq, (t_ms, host)) > arg_min(write_seq, (t_ms, host)) AS advanced FROM sample WHERE ok AND role = 1")
def check_wal_advanced(s, d):
    return checkers.wal_advanced(samples(s, d))


@query(f"{H} SELECT count(CASE WHEN outcome = 'ok' THEN 1 END) AS done, max(t_end) - min(t_start) AS ms, count(CASE WHEN outcome = 'ok' THEN 1 END) * 1000 >= (max(t_end) - min(t_start)) * 5 AS enough FROM op")
def check_throughput(s, d):
    return checkers.throughput_floor(ops(s, d), 5)


@query(f"{H}, n AS (SELECT count(CASE WHEN outcome <> 'ok' THEN 1 END) AS errors, count(CASE WHEN outcome = 'ok' THEN 1 END) AS done FROM op) SELECT errors, done, greatest(10, (errors + done) * 100 // 1000) AS allowed, errors <= greatest(10, (errors + done) * 100 // 1000) AS bounded FROM n")
def check_bench_errors(s, d):
    return checkers.error_budget(ops(s, d), 10, 100)


@query(f"""{H}, n AS (SELECT host AS node, 100 + arg_min(write_seq, t_ms) % 200 AS f0, 100 + arg_max(write_seq, t_ms) % 200 AS f1, 5000000 + arg_min(write_seq, t_ms) * 10 AS m0, 5000000 + arg_max(write_seq, t_ms) * 10 AS m1 FROM sample WHERE ok GROUP BY 1)
SELECT node, f1 <= f0 + 64 AS files_ok, m1 <= greatest(6291456, m0) AS memory_ok FROM n""")
def check_resources(s, d):
    good = samples(s, d).where("ok")
    at = lambda pick: good.groupBy(F.col("host").cast("int").alias("node")).agg(pick("write_seq", "t_ms").alias("n")).select("node", (100 + F.col("n") % 200).alias("files"), (5_000_000 + F.col("n") * 10).alias("memory_kb"))
    return checkers.resources(at(F.min_by), at(F.max_by))


@query(f"""{H}, v AS (SELECT outcome, op_id FROM op WHERE outcome <> 'ok') SELECT outcome, op_id, count(*) OVER (PARTITION BY outcome) AS violations FROM v QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY op_id) <= 10""")
def shown_violations(s, d):
    """The first ten of each kind."""
    return checkers.shown(ops(s, d).where("outcome <> 'ok'").select("outcome", "op_id"), "outcome", "op_id")


# streams


@query(f"{M} SELECT aggregate_id, count(*) AS batches, max(aggregate_version) AS to_version FROM wal WHERE kind = 'event_batch' GROUP BY 1")
def watch_latency(s, d):
    """A feed that gathers changes for 200 ms at a time, one file of the log a batch, over all shards."""
    out = shared(s)
    rows = wal(s, d).select("shard_id", *model.KEY, "kind", "wal_seq", "aggregate_version", "keep_from").where("kind = 'event_batch'")
    rows.repartition(3, "aggregate_id").write.parquet(f"{out}/wal")
    counted = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/changes")
    running = watch.feed(s, f"{out}/wal", rows.schema, counted, f"{out}/checkpoint", latency_ms=200, files=1, ops=["write"])
    running.processAllAvailable()
    running.stop()
    got = s.read.schema("aggregate_id bigint, from_version bigint, to_version bigint").parquet(f"{out}/changes")
    merged = got.groupBy("aggregate_id").agg(F.max("to_version").alias("to_version"), F.min("from_version").alias("from_version"))
    return merged.select("aggregate_id", (F.col("to_version") - F.col("from_version") + 1).alias("batches"), "to_version")
