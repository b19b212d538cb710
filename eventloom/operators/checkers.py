"""History, consistency and metric checkers. Each gives its violations (or verdicts) as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalars import normalised
from eventloom.plans.model import running

#: Rows of a side up to which it is broadcast.
MOST_WINDOWS, MOST_SHARDS = 10_000, 100_000
#: Ticks that one window takes.
STRETCH = 1000
#: Violations of a kind that a report shows; file descriptors and memory (KB) that a node may have more after a run than before, or at all.
SHOWN, MORE_FILES, MOST_MEMORY_KB = 10, 64, 6 << 20


def duplicate_acks(ops: DataFrame) -> DataFrame:
    return ops.where("outcome = 'ok'").groupBy("aggregate_id", "client_id", "client_seq").agg(F.count(F.lit(1)).alias("acks")).where("acks > 1")


def occ(ops: DataFrame) -> DataFrame:
    """Versions of an aggregate acknowledged more than once, and expected versions that more than one write got past."""
    ok = ops.where("outcome = 'ok'")
    by = lambda kind, c: ok.where(F.col(c).isNotNull()).groupBy("aggregate_id", F.col(c).alias("version")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "aggregate_id", "version", "n")
    return by("acked", "acked_version").unionByName(by("expected", "expected_version"))


def seq_gaps(ops: DataFrame, stored: DataFrame) -> DataFrame:
    """How many acknowledged versions of each aggregate are above what is stored."""
    acked = ops.where("outcome = 'ok'").groupBy("aggregate_id").agg(F.max("acked_version").alias("acked"))
    return acked.join(stored, "aggregate_id", "left").select("aggregate_id", F.greatest(F.col("acked") - F.coalesce("stored", F.lit(0)), F.lit(0)).alias("missing"))


def idempotency(ops: DataFrame) -> DataFrame:
    """Replay rejections without a reason: no acknowledged or undecided operation of the client has a sequence as high before it.

    A rejection that is right is of a sequence below the maximum, so it never raises it: a running maximum over the others is the whole fold.
    """
    before = Window.partitionBy("aggregate_id", "client_id").orderBy("op_id").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max(F.when(F.col("outcome").isin("ok", "info"), F.col("client_seq"))).over(before), F.lit(0))
    return ops.withColumn("__high", high).where((F.col("outcome") == "fail") & (F.col("error") == 2002) & (F.col("client_seq") > F.col("__high"))).select("aggregate_id", "client_id", "client_seq", "op_id")


def wal_monotonicity(ops: DataFrame, finals: DataFrame) -> DataFrame:
    """Final versions outside [acked, acked + 1]."""
    acked = ops.where("outcome = 'ok'").groupBy("aggregate_id").agg(F.max("acked_version").alias("acked"))
    rows = finals.where("max_version IS NOT NULL").join(acked, "aggregate_id")
    return rows.where(~F.col("max_version").between(F.col("acked"), F.col("acked") + 1)).select("node", "aggregate_id", "max_version", "acked")


def parity(finals: DataFrame) -> DataFrame:
    """Aggregates for which nodes that answered differ."""
    return finals.where("max_version IS NOT NULL").groupBy("aggregate_id").agg(F.min("max_version").alias("low"), F.max("max_version").alias("high")).where("low <> high")


def trim_breach(ops: DataFrame, finals: DataFrame) -> DataFrame:
    """Whether all nodes that answered are below what was acknowledged."""
    acked = ops.where("outcome = 'ok'").groupBy("aggregate_id").agg(F.max("acked_version").alias("acked"))
    return finals.join(acked, "aggregate_id").groupBy("aggregate_id").agg(F.coalesce(F.bool_and(F.col("max_version") < F.col("acked")), F.lit(False)).alias("breach"))


def ryw(probes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Probes for which two nodes or more answered and all saw less than acknowledged; probes inside excluded windows (low, high) are left out."""
    if excluded is not None:
        inside = (F.col("t_ns") >= F.col("low")) & (F.col("t_ns") <= F.col("high"))
        if excluded.limit(MOST_WINDOWS + 1).count() <= MOST_WINDOWS:
            probes = probes.join(F.broadcast(excluded), inside, "left_anti")
        else:
            # by cells of time as wide as a window's length rounded up to a power of two, of which a window touches two at most
            bits = F.least(F.length(F.bin(F.col("high") - F.col("low"))), F.lit(63)).alias("bits")
            windows = excluded.where("low <= high").select("low", "high", bits).withColumn("cell", F.expr("explode(array_distinct(array(shiftright(low, bits), shiftright(high, bits))))"))
            levels = [r["bits"] for r in windows.select("bits").distinct().collect()]
            times = probes.select("t_ns").distinct().withColumn("bits", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell", F.expr("shiftright(t_ns, bits)"))
            of_probe = times.join(windows.withColumnsRenamed({"bits": "of", "cell": "at"}), (F.col("bits") == F.col("of")) & (F.col("cell") == F.col("at")) & inside, "left_semi")
            probes = probes.join(of_probe.select("t_ns").distinct(), "t_ns", "left_anti")
    seen = F.col("observed_version").isNotNull()
    return probes.groupBy("probe_id").agg(
        F.count_distinct(F.when(seen, F.col("node"))).alias("nodes"), F.bool_and(F.when(seen, F.col("observed_version") < F.col("acked_version"))).alias("stale")
    ).where("nodes >= 2 AND stale").select("probe_id", "nodes")


def watch_order(deliveries: DataFrame) -> DataFrame:
    before = F.lag("to_version").over(Window.partitionBy("connection", "epoch", "aggregate_id").orderBy("t_ns", "delivery_id"))
    return deliveries.withColumn("before", before).where(F.col("from_version") <= F.col("before")).select("delivery_id", "aggregate_id", "from_version", "before")


def watch_durable(deliveries: DataFrame, finals: DataFrame) -> DataFrame:
    """Deliveries of versions that no node has in the end; aggregates without an answer are unknown."""
    last = finals.groupBy("aggregate_id").agg(F.max("max_version").alias("final"))
    verdict = F.when(F.col("final").isNull(), "unknown").when(F.col("to_version") > F.col("final"), "lost").otherwise("durable")
    return deliveries.join(last, "aggregate_id", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def epoch_unique(copies: DataFrame) -> DataFrame:
    """Sequences that nodes hold under different epochs."""
    return copies.groupBy("shard_id", "wal_seq").agg(F.min("lease_epoch").alias("low"), F.max("lease_epoch").alias("high")).where("low <> high")


def _neighbour(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the value of the row whose wal_seq is one less (a join, so that no shard is one window)."""
    before = rows.select("shard_id", (F.col("wal_seq") + 1).alias("wal_seq"), F.col(column).alias(name))
    return rows.join(before, ["shard_id", "wal_seq"], "left")


def epoch_monotonic(wal: DataFrame) -> DataFrame:
    return _neighbour(wal.select("shard_id", "wal_seq", "lease_epoch"), "lease_epoch", "before").where("lease_epoch < before").select("shard_id", "wal_seq", "lease_epoch", "before")


def contiguous(wal: DataFrame) -> DataFrame:
    """Rows (but a shard's first) with no row just before them."""
    first = wal.groupBy("shard_id").agg(F.min("wal_seq").alias("first"))
    before = wal.select("shard_id", (F.col("wal_seq") + 1).alias("wal_seq"))
    if first.limit(MOST_SHARDS + 1).count() <= MOST_SHARDS:
        first = F.broadcast(first)
    return wal.select("shard_id", "wal_seq").join(first, "shard_id").where("wal_seq > first").join(before, ["shard_id", "wal_seq"], "left_anti").select("shard_id", "wal_seq")


def tip_fork(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """shard_id, ours, theirs, fork: the tips are of one chain unless equal sequences differ, or the longer one's row after the other's tip doesn't follow it."""
    tip = lambda c, name: c.groupBy("shard_id").agg(F.max("wal_seq").alias(name), F.max_by("tip", "wal_seq").alias(f"{name}_tip"))
    a, b = tip(ours, "ours"), tip(theirs, "theirs")
    both = a.join(b, "shard_id").withColumn("next", F.least("ours", "theirs") + 1)
    after = ours.unionByName(theirs).select("shard_id", F.col("wal_seq").alias("next"), "previous_tip").distinct()
    joined = both.join(after, ["shard_id", "next"], "left")
    lower = F.when(F.col("ours") < F.col("theirs"), F.col("ours_tip")).otherwise(F.col("theirs_tip"))
    fork = F.when(F.col("ours") == F.col("theirs"), F.col("ours_tip") != F.col("theirs_tip")).otherwise(F.coalesce(F.col("previous_tip") != lower, F.lit(False)))
    return joined.groupBy("shard_id", "ours", "theirs").agg(F.bool_or(fork).alias("fork"))


# metric samples: host, tick, t_ms, ok, role (1: leader), write_seq, read_seq


def one_leader(samples: DataFrame) -> DataFrame:
    """Ticks at which all hosts answered but not exactly one leads."""
    return samples.groupBy("tick").agg(F.bool_and("ok").alias("ok"), F.sum("role").alias("leaders")).where("ok AND leaders <> 1").select("tick", "leaders")


def leader_retained(samples: DataFrame) -> DataFrame:
    leads = samples.where("ok AND role = 1")
    return leads.agg(F.min_by("host", F.struct("t_ms", "host")).alias("first_leader"), F.max_by("host", F.struct("t_ms", "host")).alias("last_leader")).withColumn("retained", F.col("first_leader") == F.col("last_leader"))


def distinct_leaders(samples: DataFrame) -> DataFrame:
    return samples.where("ok AND role = 1").agg(F.count_distinct("host").alias("leaders"))


def longest_gap(samples: DataFrame) -> DataFrame:
    """The longest run of ticks without a leader; ticks at which a host didn't answer neither open nor close one."""
    ticks = samples.groupBy("tick").agg(F.bool_and("ok").alias("ok"), F.max("role").alias("led"), F.min("t_ms").alias("t_ms")).where("ok")
    islands = running(ticks, "island", F.col("led"), [], F.floor(F.col("tick") / STRETCH), [F.col("tick")])
    return islands.where("led = 0").groupBy("island").agg((F.max("t_ms") - F.min("t_ms")).alias("ms")).agg(F.coalesce(F.max("ms"), F.lit(0)).alias("longest_ms"))


def convergence(samples: DataFrame, recent_ms: int = 36_000_000) -> DataFrame:
    """Per pair of last samples: equal, or the lower host advanced recently."""
    good = samples.where("ok")
    last = good.groupBy("host").agg(F.max_by("read_seq", "t_ms").alias("last"), F.max("t_ms").alias("t"))
    earlier = good.join(last, "host").where(F.col("t_ms") <= F.col("t") - recent_ms).groupBy("host").agg(F.max_by("read_seq", "t_ms").alias("earlier"))
    hosts = last.join(earlier, "host", "left").withColumn("advanced", F.col("last") > F.coalesce("earlier", F.lit(0)))
    return hosts.agg(F.min("last").alias("low"), F.max("last").alias("high"), F.min_by("advanced", F.struct("last", "host")).alias("advanced")).select("low", "high", ((F.col("low") == F.col("high")) | F.col("advanced")).alias("converged"))


def _stretched(rows: DataFrame, name: str, inside, of_stretch, across) -> DataFrame:
    """rows (tick, ...) with a column that depends on all earlier ticks: `inside` over the rows of a stretch of ticks, and, where that isn't enough, `across` over what `of_stretch` makes of each stretch."""
    rows = rows.withColumn("__stretch", F.floor(F.col("tick") / STRETCH))
    whole = rows.groupBy("__stretch").agg(of_stretch.alias("__of"))
    whole = whole.select("__stretch", across(Window.orderBy("__stretch")).alias("__earlier"))  # one row for STRETCH ticks
    return rows.withColumn("__inside", inside(Window.partitionBy("__stretch").orderBy("tick"))).join(whole, "__stretch").withColumn(name, F.struct("__inside", "__earlier")).drop("__stretch", "__inside", "__earlier")


def never_ahead(samples: DataFrame) -> DataFrame:
    """Ticks at which the follower reads above all that the leader has read so far, twice running."""
    pairs = samples.where("ok").groupBy("tick").agg(F.max(F.when(F.col("role") == 1, F.col("read_seq"))).alias("leader"), F.max(F.when(F.col("role") == 0, F.col("read_seq"))).alias("follower"))
    rows = _stretched(pairs, "x", lambda w: F.max("leader").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("leader"), lambda w: F.max("__of").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("high", F.greatest("x.__inside", "x.__earlier")).drop("x").withColumn("ahead", F.coalesce(F.col("follower") > F.col("high"), F.lit(False)))
    rows = _stretched(rows, "x", lambda w: F.lag("ahead").over(w), F.max_by("ahead", "tick"), lambda w: F.lag("__of").over(w))
    return rows.where("ahead AND coalesce(x.__inside, x.__earlier, false)").select("tick", "follower", "high")


def read_within_write(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("bad", F.col("read_seq") > F.col("write_seq"))
    return rows.withColumn("before", F.lag("bad").over(Window.partitionBy("host").orderBy("tick"))).where("bad AND before").select("host", "tick")


def counter_delta(samples: DataFrame) -> DataFrame:
    good = samples.where("ok")
    return good.groupBy("host").agg(F.greatest(F.max_by("write_seq", "t_ms") - F.min_by("write_seq", "t_ms"), F.lit(0)).alias("delta"))


def median_tick(samples: DataFrame) -> DataFrame:
    gap = F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("host").orderBy("t_ms"))
    return samples.where("ok").withColumn("gap", gap).groupBy("host").agg(F.percentile("gap", 0.5).alias("median_ms"))


def disk_truth(acked: DataFrame, present: DataFrame) -> DataFrame:
    """aggregate_id, seq: sequences from 1 to the aggregate's highest acknowledged one that no node has.

    Only gaps between sequences that are there are written out, so what is there isn't made again.
    """
    there = present.select("aggregate_id", "seq").distinct().join(acked, "aggregate_id").where("seq BETWEEN 1 AND acked")
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("aggregate_id").orderBy("seq")), F.lit(0))
    inside = there.select("aggregate_id", (before + 1).alias("low"), (F.col("seq") - 1).alias("high"))
    last = acked.join(there.groupBy("aggregate_id").agg(F.max("seq").alias("last")), "aggregate_id", "left").select("aggregate_id", (F.coalesce("last", F.lit(0)) + 1).alias("low"), F.col("acked").alias("high"))
    return inside.unionByName(last).where("low <= high").select("aggregate_id", F.explode(F.sequence("low", "high")).alias("seq"))


def several_versions(present: DataFrame) -> DataFrame:
    """Sequences stored under more than one version."""
    return present.groupBy("aggregate_id", "client_id", "seq").agg(F.count_distinct("aggregate_version").alias("versions")).where("versions > 1")


def range_gaps(ranges: DataFrame) -> DataFrame:
    """Objects whose range begins after the end of the one before it; ranges may overlap. ranges: shard_id, first, last."""
    before = F.lag("last").over(Window.partitionBy("shard_id").orderBy("first", "last"))
    return ranges.withColumn("before", before).where((F.col("first") > F.col("last")) | (F.col("before") + 1 < F.col("first"))).select("shard_id", "first", "last", "before")


def error_storm(lines: DataFrame, most: int) -> DataFrame:
    return lines.where(F.col("line").contains("ERROR")).groupBy(normalised(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def marked_lines(lines: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Lines that hold one of the markers, and the first of them in their order."""
    marker = F.coalesce(*[F.when(F.col("line").contains(m), F.lit(m)) for m in markers])
    return lines.withColumn("marker", marker).where("marker IS NOT NULL")


def shown(violations: DataFrame, kind: str, *order: str, most: int = SHOWN) -> DataFrame:
    """The first violations of each kind, and how many there are."""
    counts = violations.groupBy(kind).agg(F.count(F.lit(1)).alias("violations"))
    first = violations.withColumn("__rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")
    return first.join(counts, kind)


def role_flips(samples: DataFrame) -> DataFrame:
    """How often each host's role changed, over the ticks at which all hosts answered."""
    good = samples.groupBy("tick").agg(F.bool_and("ok").alias("__all")).where("__all").select("tick")
    before = F.lag("role").over(Window.partitionBy("host").orderBy("tick"))
    rows = samples.join(good, "tick").withColumn("__before", before)
    return rows.groupBy("host").agg(F.count(F.when(F.col("__before") != F.col("role"), 1)).alias("flips"))


def final_leader_wrote(samples: DataFrame, until_ms: int | None = None, counter: str = "write_seq") -> DataFrame:
    """The host that led last; its counter when it first led since it was last started anew (since the counter fell), and at its last answer before the load ended; whether that advanced.
    A host that came to lead only after the load had ended passes."""
    good = samples.where("ok")
    until = F.lit(until_ms if until_ms is not None else (1 << 62))
    leader = good.where("role = 1").agg(F.max_by("host", F.struct("t_ms", "host")).alias("host"))
    own = good.join(leader, "host")
    fell = F.col(counter) < F.lag(counter).over(Window.partitionBy("host").orderBy("t_ms"))
    own = own.withColumn("__fell", F.coalesce(fell, F.lit(False)))
    start = own.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("__fell"), F.col("t_ms"))), F.min("t_ms")).alias("__start"))
    facts = own.join(start, "host").groupBy("host").agg(
        F.min_by(F.struct(F.col(counter).alias("n"), "t_ms"), F.when((F.col("role") == 1) & (F.col("t_ms") >= F.col("__start")), F.col("t_ms"))).alias("first"),
        F.max_by(counter, F.when(F.col("t_ms") <= until, F.col("t_ms"))).alias("last"),
    )
    late = F.col("first.t_ms") > until
    return facts.select("host", F.col("first.n").alias("first_count"), F.col("last").alias("last_count"), F.coalesce(late | (F.col("last") > F.col("first.n")), F.lit(False)).alias("wrote"))


def wal_advanced(samples: DataFrame) -> DataFrame:
    """The leader's sequence at the first and last tick at which one answered, and whether it advanced."""
    leads = samples.where("ok AND role = 1")
    ends = leads.agg(F.min_by("write_seq", F.struct("t_ms", "host")).alias("first"), F.max_by("write_seq", F.struct("t_ms", "host")).alias("last"))
    return ends.withColumn("advanced", F.coalesce(F.col("last") > F.col("first"), F.lit(False)))


def throughput_floor(ops: DataFrame, least: int) -> DataFrame:
    """Operations done and the time they took (ms), and whether that is at least `least` a second."""
    facts = ops.agg(F.count(F.when(F.col("outcome") == "ok", 1)).alias("done"), (F.max("t_end") - F.min("t_start")).alias("ms"))
    return facts.withColumn("enough", F.coalesce(F.col("done") * 1000 >= F.col("ms") * least, F.lit(False)))


def error_budget(ops: DataFrame, most: int, per_thousand: int) -> DataFrame:
    """Errors, and whether they are at most `most` or that share of all attempts (errors and completed operations)."""
    facts = ops.agg(F.count(F.when(F.col("outcome") != "ok", 1)).alias("errors"), F.count(F.when(F.col("outcome") == "ok", 1)).alias("done"))
    allowed = F.greatest(F.lit(most).cast("long"), F.floor((F.col("errors") + F.col("done")) * per_thousand / 1000))
    return facts.withColumn("allowed", allowed).withColumn("bounded", F.col("errors") <= F.col("allowed"))


def resources(before: DataFrame, after: DataFrame) -> DataFrame:
    """node, files_ok, memory_ok from snapshots (node, files, memory_kb): files may grow by MORE_FILES, memory up to MOST_MEMORY_KB or what it was. A node without a later snapshot fails."""
    late = after.select("node", F.col("files").alias("__files"), F.col("memory_kb").alias("__memory"))
    rows = before.join(late, "node", "left")
    no = F.lit(False)
    return rows.select("node", F.coalesce(F.col("__files") <= F.col("files") + MORE_FILES, no).alias("files_ok"), F.coalesce(F.col("__memory") <= F.greatest(F.lit(MOST_MEMORY_KB), F.col("memory_kb")), no).alias("memory_ok"))


def altered(rows: DataFrame, content: str, checksum: str) -> DataFrame:
    """Rows whose content doesn't have their checksum."""
    return rows.where(~F.col(checksum).eqNullSafe(F.crc32(F.col(content))))
