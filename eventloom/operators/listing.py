"""Catalogue listings, segment summaries and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.plans.model import KEY


def orgs(wal: DataFrame) -> DataFrame:
    return wal.select("org_id").distinct()


def types(wal: DataFrame, org_id: int | None = None) -> DataFrame:
    rows = wal if org_id is None else wal.where(F.col("org_id") == org_id)
    return rows.select("org_id", "aggregate_type_id").distinct()


def last_deletes(wal: DataFrame) -> DataFrame:
    """aggregate_id, delete_seq: where each deleted aggregate was deleted last. Few rows against the log's."""
    return wal.where("kind = 'soft_delete'").groupBy("aggregate_id").agg(F.max("wal_seq").alias("delete_seq"))


def partials(wal: DataFrame, *more: str) -> DataFrame:
    """What a segment, or the whole log, holds of each aggregate (and value of `more`), in a form that merge() can add up.

    Batches before the last delete count no longer, but keep their part in the largest version and time. `floor` is the highest trim after
    the first batch or delete here, `loose` that before it (all, where there is neither: `present` is false), both only after the last delete without
    continuation, which has_fresh tells of.

    The log itself is aggregated before it is shuffled; what is joined to it are tombstones, of which there are few.
    """
    keys = [*KEY, *more]
    batch, delete, trim = (F.col("kind") == k for k in ("event_batch", "soft_delete", "soft_trim"))
    fresh = F.when(~F.coalesce("allow_continuation", F.lit(False)), F.col("wal_seq"))
    barrier = wal.where(delete).groupBy(*keys).agg(F.max("wal_seq").alias("delete_seq"), F.max(fresh).alias("fresh_seq"))
    trims = wal.where(trim).select(*keys, F.col("wal_seq").alias("trim_seq"), "keep_from")
    born = wal.where(~trim).join(trims.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("wal_seq").alias("born"))
    counting = trims.join(born, keys, "left").join(barrier.select(*keys, "fresh_seq"), keys, "left").where(F.col("trim_seq") > F.coalesce("fresh_seq", F.lit(0)))
    after = F.coalesce(F.col("trim_seq") > F.col("born"), F.lit(False))
    floors = counting.groupBy(*keys).agg(F.max(F.when(after, F.col("keep_from"))).alias("floor"), F.max(F.when(~after, F.col("keep_from"))).alias("loose"))
    live = batch & (F.col("wal_seq") > F.coalesce("delete_seq", F.lit(0)))
    counted = wal.where(~trim).join(barrier, keys, "left").groupBy(*keys).agg(
        F.count(F.when(live, 1)).alias("batch_count"),
        F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.max(F.when(batch, F.col("aggregate_version"))), F.lit(0)).alias("max_version"),
        F.max("server_timestamp").alias("max_timestamp"),
        (F.coalesce(F.max("delete_seq"), F.lit(0)) > F.coalesce(F.max(F.when(batch, F.col("wal_seq"))), F.lit(0))).alias("is_deleted"),
        F.max("delete_seq").isNotNull().alias("has_delete"),
        F.max("fresh_seq").isNotNull().alias("has_fresh"),
        F.min(F.when(live, F.col("min_event_timestamp"))).alias("min_event_timestamp"),
        F.max(F.when(live, F.col("max_event_timestamp"))).alias("max_event_timestamp"),
    ).withColumn("present", F.lit(True))
    out = counted.join(floors, keys, "full")
    no = F.lit(False)
    return out.withColumns({"floor": F.coalesce("floor", F.lit(0)), "loose": F.coalesce("loose", F.lit(0)), "present": F.coalesce("present", no), "has_delete": F.coalesce("has_delete", no), "has_fresh": F.coalesce("has_fresh", no)})


def summary(wal: DataFrame, *more: str) -> DataFrame:
    """partials() of aggregates with a batch or a delete: a trim of another isn't listed."""
    return partials(wal, *more).where("present").drop("present", "loose", "has_fresh")


def merge(parts: DataFrame, order: str = "log_id") -> DataFrame:
    """Partials of segments merged in order, as the summary of the whole log: a segment with a delete replaces counts and sizes before it, one with a delete
    without continuation the floors. Trims before an aggregate's first batch or delete don't count."""
    of_key = Window.partitionBy(*KEY)
    at = lambda condition, pick: F.coalesce(pick(F.when(F.col(condition), F.col(order))).over(of_key), F.lit(-1))
    rows = parts.withColumns({"__cut": at("has_delete", F.max), "__fresh": at("has_fresh", F.max), "__born": at("present", F.min)})
    live = F.col(order) >= F.col("__cut")
    own = (F.col(order) >= F.col("__fresh")) & (F.col(order) >= F.col("__born"))
    loose = (F.col(order) > F.col("__fresh")) & (F.col(order) > F.col("__born"))
    floor = F.greatest(F.when(own, F.col("floor")).otherwise(0), F.when(loose, F.col("loose")).otherwise(0))
    return rows.where("__born >= 0").groupBy(*KEY).agg(
        F.sum(F.when(live, F.col("batch_count")).otherwise(0)).alias("batch_count"),
        F.sum(F.when(live, F.col("total_size")).otherwise(0)).alias("total_size"),
        F.max("max_version").alias("max_version"), F.max("max_timestamp").alias("max_timestamp"), F.max(floor).alias("floor"),
        F.max_by("is_deleted", F.when(F.col("present"), F.col(order))).alias("is_deleted"),
    )


def aggregates(wal: DataFrame, include_deleted: bool = False, org_id: int | None = None, type_id: int | None = None) -> DataFrame:
    rows = wal
    if org_id is not None:
        rows = rows.where(F.col("org_id") == org_id)
        if type_id is not None:
            rows = rows.where(F.col("aggregate_type_id") == type_id)
    out = summary(rows)
    return out if include_deleted else out.where(~F.col("is_deleted"))


def page(wal: DataFrame, cursor: int, size: int) -> DataFrame:
    """The newest `size` rows of each shard before the cursor, newest first."""
    return wal.where(F.col("wal_seq") < cursor).orderBy(F.desc("wal_seq"), "shard_id").limit(size)


def merge_pages(pages: DataFrame) -> DataFrame:
    """Statistics of aggregates from several pages: sums, maxima, minima that ignore 0, any deletion."""
    return pages.groupBy(*KEY).agg(
        F.sum("batch_count").alias("batch_count"), F.sum("total_size").alias("total_size"), F.max("max_version").alias("max_version"),
        F.coalesce(F.min(F.expr("nullif(min_event_timestamp, 0)")), F.lit(0)).alias("min_event_timestamp"), F.bool_or("is_deleted").alias("is_deleted"),
    )


def client_floors(events: DataFrame) -> DataFrame:
    """The highest client_seq of each aggregate and client; trims and deletes don't lower it."""
    return events.groupBy(*KEY, "client_id").agg(F.max("max_client_seq").alias("floor"))


def first_page(wal: DataFrame) -> DataFrame:
    """What a listing without a cursor answers first: the whole active segment of each shard, however large, and the cursor to go on from (null: there is no older segment)."""
    active = wal.groupBy("shard_id").agg(F.max("log_id").alias("log_id"), F.min("log_id").alias("__oldest"))
    rows = wal.join(active, ["shard_id", "log_id"])
    start = rows.groupBy("shard_id").agg(F.when(F.max("__oldest") < F.max("log_id"), F.min("wal_seq")).alias("cursor"))
    return summary(rows.drop("__oldest"), "shard_id").join(start, "shard_id")


def capped_client_sets(wal: DataFrame, most_bytes: int, each: int = 8, unknown: int = 4) -> DataFrame:
    """shard_id, log_id, aggregate_id, size, known: the client sets of each segment's summary; the largest become unknown (of `unknown` bytes) until the segment's sets have at most most_bytes."""
    keys = ["shard_id", "log_id"]
    sets = wal.groupBy(*keys, "aggregate_id").agg((F.count_distinct("client_id") * each + unknown).alias("size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "aggregate_id").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum(F.col("size") - unknown).over(order), F.lit(0))
    return sets.withColumn("known", F.sum("size").over(Window.partitionBy(*keys)) - saved <= most_bytes)


def absent(keys: DataFrame, *sources: DataFrame) -> DataFrame:
    """Keys that none of the sources holds: their answers are united, so a key is absent only if all say so. Exact, where a filter of bits would be a superset."""
    out = keys
    for source in sources:
        out = out.join(source.select(keys.columns), keys.columns, "left_anti")
    return out


def sampled(wal: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of aggregates: those with the smallest hash."""
    ids = wal.select("aggregate_id").distinct()
    return ids.orderBy(F.md5(F.concat(F.col("aggregate_id").cast("string"), F.lit(f"-{seed}")).cast("binary")), "aggregate_id").limit(n)


def authoritative(uploads: DataFrame) -> DataFrame:
    """Of the uploads of a segment (shard_id, log_id, lease_epoch, upload, ...) the one of the highest epoch, then number."""
    rest = [c for c in uploads.columns if c not in ("shard_id", "log_id")]
    return uploads.groupBy("shard_id", "log_id").agg(F.max_by(F.struct(*rest), F.struct("lease_epoch", "upload")).alias("__x")).select("shard_id", "log_id", "__x.*")


def overlaps(left: DataFrame, right: DataFrame, within: str, width: int) -> DataFrame:
    """Pairs of rows of the same `within` whose ranges (low, high) meet: both are cut into cells of `width`, so that the join is by equality."""
    cell = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    other = right.withColumn("__cell", cell).withColumnsRenamed({"low": "__low", "high": "__high"})
    return left.withColumn("__cell", cell).join(other, [within, "__cell"]).where("low <= __high AND __low <= high").drop("__cell", "__low", "__high").distinct()
