"""Test histories derived from the log: operations, final reads, probes, deliveries and metric samples with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.model import EPOCH_MS, running


def operations(wal: DataFrame) -> DataFrame:
    b = wal.where("kind = 'event_batch'").withColumn("r", F.col("first_id") % 20)
    outcome = F.when(F.col("r") == 0, "info").when(F.col("r").isin(1, 2), "fail").otherwise("ok")
    one = b.select(
        (F.col("wal_seq") * 8 + F.col("shard_id") * 2).alias("op_id"), "shard_id", "aggregate_id", "client_id", F.col("max_client_seq").alias("client_seq"), (F.col("aggregate_version") - 1).alias("expected_version"),
        outcome.alias("outcome"), F.when(F.col("r") == 1, 2002).when(F.col("r") == 2, 2003).alias("error"), F.when(outcome == "ok", F.col("aggregate_version")).alias("acked_version"),
        F.col("server_timestamp").alias("t_start"), (F.col("server_timestamp") + F.col("first_id") % 500).alias("t_end"), "r",
    )
    again = one.where("r = 3").withColumn("op_id", F.col("op_id") + 1)
    return one.unionByName(again).drop("r")


def finals(ops: DataFrame) -> DataFrame:
    """The version that each of two nodes has in the end; some too low, some without an answer."""
    top = ops.groupBy("aggregate_id").agg(F.max("acked_version").alias("acked"))
    rows = top.select("aggregate_id", "acked", F.explode(F.array(F.lit(0), F.lit(1))).alias("node"))
    a, second = F.col("aggregate_id"), F.col("node") == 1
    return rows.select(F.col("node").cast("long").alias("node"), "aggregate_id", F.when(second & (a % 23 == 0), None).when(second & (a % 19 == 0) | (a % 29 == 0), F.col("acked") - 1).otherwise(F.col("acked")).alias("max_version"))


def probes(wal: DataFrame) -> DataFrame:
    b = wal.where("kind = 'event_batch'")
    rows = b.select((F.col("wal_seq") * 4 + F.col("shard_id")).alias("probe_id"), F.col("aggregate_version").alias("acked_version"), F.col("server_timestamp").alias("t_ns"), "wal_seq", F.explode(F.array(*map(F.lit, range(3)))).alias("node"))
    low = (F.col("wal_seq") % 31 == 0) | (F.col("wal_seq") % 37 == F.col("node"))
    return rows.select("probe_id", F.col("node").cast("long").alias("node"), "acked_version", "t_ns", F.when(F.col("wal_seq") % 7 != F.col("node"), F.col("acked_version") - low.cast("long")).alias("observed_version"))


def deliveries(wal: DataFrame) -> DataFrame:
    b = wal.where("kind = 'event_batch'")
    return b.select((F.col("wal_seq") * 4 + F.col("shard_id")).alias("delivery_id"), (F.col("aggregate_id") % 3).alias("connection"), F.lit(1).alias("epoch"), "aggregate_id", (F.col("aggregate_version") - (F.col("wal_seq") % 29 == 0).cast("long")).alias("from_version"), F.col("aggregate_version").alias("to_version"), F.col("server_timestamp").alias("t_ns"))


def samples(events: DataFrame) -> DataFrame:
    """Hourly metrics of two hosts: one row an hour and host, however many events."""
    hour = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - EPOCH_MS) / 3_600_000).cast("long")
    hours = events.groupBy(hour.alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    hours = running(hours, "total", F.col("n"), [], F.floor(F.col("tick") / 1000), [F.col("tick")])
    t, h = F.col("tick"), F.col("host")
    rows = hours.select("tick", "total", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("host"))
    role = F.when(t % 50 == 13, 1).when(t % 40 < 2, 0).otherwise((F.floor(t / 100) % 2 == h).cast("int"))
    return rows.select(
        h, t, (t * 3_600_000 + EPOCH_MS + h).alias("t_ms"), ((t * 7 + h) % 10 != 0).alias("ok"), role.alias("role"), F.col("total").alias("write_seq"),
        (F.col("total") - F.when(role == 1, 3).otherwise(5) + F.when((t % 60 < 2) & (h == 0), 9).otherwise(0)).alias("read_seq"),
    )


#: The same in DuckDB SQL, to follow the model's.
SQL = f"""
, op0 AS (
  SELECT wal_seq * 8 + shard_id * 2 AS op_id, shard_id, aggregate_id, client_id, max_client_seq AS client_seq, aggregate_version - 1 AS expected_version,
    CASE WHEN first_id % 20 = 0 THEN 'info' WHEN first_id % 20 IN (1, 2) THEN 'fail' ELSE 'ok' END AS outcome,
    CASE first_id % 20 WHEN 1 THEN 2002 WHEN 2 THEN 2003 END AS error,
    CASE WHEN first_id % 20 > 2 THEN aggregate_version END AS acked_version, server_timestamp AS t_start, server_timestamp + first_id % 500 AS t_end, first_id % 20 AS r
  FROM wal WHERE kind = 'event_batch'
), op AS (SELECT * FROM op0 UNION ALL SELECT * REPLACE (op_id + 1 AS op_id) FROM op0 WHERE r = 3
), acked AS (SELECT aggregate_id, max(acked_version) AS acked FROM op WHERE outcome = 'ok' GROUP BY 1
), final AS (
  SELECT node, aggregate_id, CASE WHEN node = 1 AND aggregate_id % 23 = 0 THEN NULL WHEN node = 1 AND aggregate_id % 19 = 0 OR aggregate_id % 29 = 0 THEN acked - 1 ELSE acked END AS max_version
  FROM (SELECT aggregate_id, max(acked_version) AS acked FROM op GROUP BY 1), (VALUES (0), (1)) AS n(node)
), probe AS (
  SELECT wal_seq * 4 + shard_id AS probe_id, node, aggregate_version AS acked_version, server_timestamp AS t_ns,
    CASE WHEN wal_seq % 7 <> node THEN aggregate_version - CASE WHEN wal_seq % 31 = 0 OR wal_seq % 37 = node THEN 1 ELSE 0 END END AS observed_version
  FROM wal, (VALUES (0), (1), (2)) AS n(node) WHERE kind = 'event_batch'
), delivery AS (
  SELECT wal_seq * 4 + shard_id AS delivery_id, aggregate_id % 3 AS connection, aggregate_id, aggregate_version - CASE WHEN wal_seq % 29 = 0 THEN 1 ELSE 0 END AS from_version, aggregate_version AS to_version, server_timestamp AS t_ns
  FROM wal WHERE kind = 'event_batch'
), hours AS (
  SELECT tick, CAST(sum(n) OVER (ORDER BY tick) AS BIGINT) AS total FROM (SELECT ((epoch_us(ts) // 1000) - {EPOCH_MS}) // 3600000 AS tick, count(*) AS n FROM events GROUP BY 1)
), sample0 AS (
  SELECT host, tick, total, CASE WHEN tick % 50 = 13 THEN 1 WHEN tick % 40 < 2 THEN 0 WHEN (tick // 100) % 2 = host THEN 1 ELSE 0 END AS role FROM hours, (VALUES (0), (1)) AS h(host)
), sample AS (
  SELECT host, tick, tick * 3600000 + {EPOCH_MS} + host AS t_ms, (tick * 7 + host) % 10 <> 0 AS ok, role, total AS write_seq,
    total - CASE WHEN role = 1 THEN 3 ELSE 5 END + CASE WHEN tick % 60 < 2 AND host = 0 THEN 9 ELSE 0 END AS read_seq
  FROM sample0
)
"""
