"""Reads, writes, listings, compaction, stores, schemas and streams on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import scalars, schemas
from eventloom.operators import chain, checkers, compact, errors, listing, read, write
from eventloom.operators.read import ReadFilters
from eventloom.plans import model
from eventloom.sources.store import CommitConflict, Store, read_history, write_history
from eventloom.streaming import watch

EVENTS = "array<struct<client_seq: bigint, event_seq: bigint, event_id: bigint, event_timestamp: bigint, event_type_major: bigint, event_type_minor: bigint, amount: bigint, props: string>>"
WAL = f"shard_id bigint, log_id bigint, wal_seq bigint, server_timestamp bigint, kind string, org_id bigint, aggregate_type_id bigint, aggregate_id bigint, aggregate_version bigint, client_id bigint, user_id bigint, keep_from bigint, allow_recreate boolean, allow_continuation boolean, size bigint, events {EVENTS}"


def batch(seq, aggregate=1, version=1, client=5, user=9, events=((1, 1),), size=100, log_id=1):
    rows = [(c, e, e, 1000 + e, t, 0, 10, None) for c, e, t in ((*x, 3) if len(x) == 2 else x for x in events)]
    return (aggregate % 4, log_id, seq, 1000 + seq, "event_batch", 1, 1, aggregate, version, client, user, None, None, None, size, rows)


def tomb(seq, kind, aggregate=1, keep=None, continues=None, version=1, log_id=1):
    return (aggregate % 4, log_id, seq, 1000 + seq, kind, 1, 1, aggregate, version, 5, 9, keep, True if kind == "soft_delete" else None, continues, None, None)


def log(spark, rows):
    return model.batch_metadata(spark.createDataFrame(rows, WAL))


def versions(df):
    return [r["aggregate_version"] for r in df.orderBy("aggregate_version").collect()]


def test_filters_keep_what_each_event_test_keeps(spark):
    """The batch condition never loses an event: random batches and bounds, against a plain loop."""
    rng = random.Random(4)
    rows, seq = [], 0
    for version in range(1, 41):
        events = []
        for _ in range(rng.randint(0, 4)):
            seq += 1
            events.append((rng.randint(1, 30), seq, rng.randint(1, 5)))
        rows.append(batch(version, version=version, client=rng.choice((5, 6)), user=rng.choice((9, None)), events=events))
    wal = log(spark, rows)
    for _ in range(12):
        low, high = sorted((rng.randint(1, 30), rng.randint(1, 30)))
        types = rng.choice(((), (2,), (1, 4)))
        filters = ReadFilters(from_version=rng.randint(0, 5), exclude_user=rng.choice((9, None)), include_client=rng.choice((5, None)), min_client_seq=low, max_client_seq=high, event_types=types)
        want = set()
        for r in rows:
            if r[8] >= max(1, filters.from_version) and (filters.include_client in (None, r[9])) and (filters.exclude_user is None or r[10] != filters.exclude_user):
                want |= {e[1] for e in r[15] if low <= e[0] <= high and (not types or e[4] in types)}
        got = {r["event_seq"] for r in read.flatten(read.read(wal, filters)).collect()}
        assert got == want


def test_pages_cut_by_bytes(spark):
    wal = log(spark, [batch(i, version=i, size=s) for i, s in enumerate((40, 40, 40, 500, 40), 1)])
    first = read.page(read.read(wal), 100)
    assert versions(first) == [1, 2] and first.first()["next_version"] == 3
    assert [versions(p) for p in read.read_all(wal, 1, 100)] == [[1, 2], [3], [4], [5]]
    assert read.page(read.read(wal, ReadFilters(from_version=4)), 100).count() == 0


def test_guards(spark):
    wal = log(spark, [batch(1), batch(2, version=2), tomb(3, "soft_trim", keep=2), batch(4, aggregate=2), tomb(5, "soft_delete", aggregate=2, continues=True)])
    with pytest.raises(errors.UnavailableVersion) as error:
        read.guarded(wal, 1)
    assert error.value.code == 1000 and error.value.minimum == 2
    assert versions(read.guarded(wal, 1, ReadFilters(from_version=2))) == [2]
    for aggregate in (2, 77):
        with pytest.raises(errors.LogError, match="1001"):
            read.guarded(wal, aggregate)
    assert read.details(wal, 2).first()["is_deleted"]
    with pytest.raises(errors.LogError, match="7001"):
        read.details(wal, 77)


def fold(rows):
    """The summary of one aggregate row by row."""
    s = None
    for r in sorted(rows, key=lambda r: r[2]):
        kind = r[4]
        if kind in ("event_batch", "soft_delete") and s is None:
            s = {"batch_count": 0, "total_size": 0, "max_version": 0, "max_timestamp": 0, "floor": 0, "is_deleted": False}
        if kind == "event_batch":
            s |= {"batch_count": s["batch_count"] + 1, "total_size": s["total_size"] + r[14], "max_version": max(s["max_version"], r[8]), "max_timestamp": max(s["max_timestamp"], r[3]), "is_deleted": False}
        elif kind == "soft_delete":
            s |= {"batch_count": 0, "total_size": 0, "max_timestamp": max(s["max_timestamp"], r[3]), "is_deleted": True}
            if not r[13]:
                s["floor"] = 0  # of versions that are gone
        elif s is not None:
            s["floor"] = max(s["floor"], r[11])
    return s


def test_summaries_and_their_merge_are_the_fold(spark):
    rng = random.Random(5)
    rows = []
    for aggregate in range(60):
        for i in range(1, rng.randint(2, 9)):
            seq, segment = aggregate * 100 + i, 1 + i // 3
            kind = rng.choice(("event_batch",) * 4 + ("soft_delete", "soft_trim"))
            rows.append(batch(seq, aggregate, version=i, size=i * 7, log_id=segment) if kind == "event_batch" else tomb(seq, kind, aggregate, keep=i if kind == "soft_trim" else None, continues=rng.random() < 0.5, log_id=segment))
    wal = log(spark, rows)
    want = {a: fold([r for r in rows if r[7] == a]) for a in range(60)}
    want = {a: s for a, s in want.items() if s}
    got = {r["aggregate_id"]: {k: r[k] for k in next(iter(want.values()))} for r in listing.aggregates(wal, include_deleted=True).collect()}
    assert got == want
    merged = {r["aggregate_id"]: {k: r[k] for k in next(iter(want.values()))} for r in listing.merge(listing.partials(wal, "log_id")).collect()}
    assert merged == want


ITEMS = write.ITEM_SCHEMA


def item(i, op, aggregate=4, client=100, first=1, n=1, kind=1, create=True, expected=None, keep=0, recreate=True, continues=False, valid=True, enforce=True, durable=None):
    return (i, op, aggregate, client, first, n, kind, valid, enforce, create, expected, keep, recreate, continues, durable)


def decide(spark, *rows, **more):
    got = write.decisions(spark.createDataFrame(list(rows), ITEMS), **more).orderBy("request_id", "aggregate_id").collect()
    return [(r["code"], r["aggregate_version"], r["event_seq"]) for r in got]


def test_write_decisions_one_by_one(spark):
    assert decide(
        spark,
        item(1, "write"), item(2, "write"), item(3, "write", first=2), item(4, "write", client=200), item(5, "write", first=3, expected=9), item(6, "write", first=3, expected=3),
        item(7, "write", n=0), item(8, "write", kind=0), item(9, "write", aggregate=8, create=False), item(10, "write", aggregate=8, expected=0),
    ) == [(0, 1, 1), (2002, 1, 1), (0, 2, 2), (0, 3, 3), (2003, 3, 3), (0, 4, 4), (2000, 4, 4), (2001, 4, 4), (2005, 0, 0), (0, 1, 1)]


def test_trims_and_deletes(spark):
    assert decide(
        spark,
        item(1, "trim"), item(2, "delete"), item(3, "write"), item(4, "write", first=2), item(5, "trim", keep=9), item(6, "trim", keep=2), item(7, "delete", expected=1),
        item(8, "delete", expected=2, continues=True), item(9, "delete"), item(10, "write", first=1), item(11, "write", first=3),
    ) == [(3000, 0, 0), (4000, 0, 0), (0, 1, 1), (0, 2, 2), (3004, 2, 2), (0, 2, 2), (4002, 2, 2), (0, 2, 2), (4000, 2, 2), (2002, 2, 2), (0, 3, 3)]
    assert decide(spark, item(1, "write"), item(2, "delete", recreate=False), item(3, "write", first=2)) == [(0, 1, 1), (0, 1, 1), (2006, 1, 1)]
    # anew: another client begins at 1, one that comes back goes on past its own last version
    assert decide(spark, item(1, "write"), item(2, "write", first=2), item(3, "delete"), item(4, "write", client=200), item(5, "write", first=3)) == [(0, 1, 1), (0, 2, 2), (0, 2, 2), (0, 1, 1), (0, 3, 2)]


def test_requests_are_atomic(spark):
    """Of a request with several items none is applied if one fails; streams of single items and of several agree."""
    two = [item(1, "write", 4), item(2, "write", 8), item(3, "write", 4, first=2), item(3, "write", 8, first=2, expected=7), item(4, "write", 4, first=2), item(4, "write", 8, first=2), item(5, "delete", 4), item(5, "delete", 8, expected=1), item(6, "write", 4, first=3)]
    assert decide(spark, *two) == [(0, 1, 1), (0, 1, 1), (2003, 1, 1), (2003, 1, 1), (0, 2, 2), (0, 2, 2), (4002, 2, 2), (4002, 2, 2), (0, 3, 3)]
    assert decide(spark, item(1, "write", 4), item(1, "write", 5), item(2, "write", 5, first=1)) == [(9001, None, None), (9001, None, None), (0, 1, 1)]


def test_replays_payloads_and_durability(spark):
    assert decide(
        spark,
        item(1, "write"), item(2, "write", enforce=False), item(3, "write", durable=1), item(4, "write", durable=2), item(5, "write", first=2, valid=False), item(6, "write", first=2),
    ) == [(0, 1, 1), (0, 2, 2), (2013, 2, 2), (2002, 2, 2), (2022, 2, 2), (0, 3, 3)]


def test_decisions_go_on_from_a_log_and_become_its_rows(spark, tmp_path):
    before = log(spark, [batch(1, 4, events=((1, 1), (2, 2))), batch(2, 4, version=2, events=((3, 3),)), batch(3, 8), tomb(4, "soft_delete", 8, continues=False), batch(1, 5)])
    rows = [item(10, "write", 4, client=5, first=3), item(11, "write", 4, client=5, first=4, n=2, expected=2), item(12, "write", 8, client=6), item(13, "write", 8, client=5, first=2), item(14, "trim", 4, keep=3), item(15, "delete", 5)]
    items = spark.createDataFrame(rows, ITEMS)
    decided = write.decisions(items, write.known(before))
    assert [(r["code"], r["aggregate_version"], r["event_seq"]) for r in decided.orderBy("request_id").collect()] == [(2002, 2, 3), (0, 3, 5), (0, 1, 1), (0, 2, 2), (0, 3, 5), (0, 1, 1)]
    event = "array<struct<client_seq: bigint, event_seq: bigint, event_id: bigint, event_timestamp: bigint, event_type_major: bigint, event_type_minor: bigint, amount: bigint, props: string>>"
    content = [(r[0], r[2], 1, 1, r[3], 9, 2000 + r[0], r[11] if r[1] == "trim" else None, True if r[1] == "delete" else None, False if r[1] == "delete" else None, 100 if r[1] == "write" else None, [(r[4] + i, None, 7, 1, 3, 0, 10, None) for i in range(r[5])] if r[1] == "write" else None) for r in rows]
    content = spark.createDataFrame(content, f"request_id bigint, aggregate_id bigint, org_id bigint, aggregate_type_id bigint, client_id bigint, user_id bigint, server_timestamp bigint, keep_from bigint, allow_recreate boolean, allow_continuation boolean, size bigint, events {event}")
    new = write.log_rows(decided, content, before.groupBy("shard_id").agg(F.max("wal_seq").alias("wal_seq")))
    assert sorted((r["shard_id"], r["wal_seq"], r["kind"], r["aggregate_id"], r["aggregate_version"], r["max_event_seq"]) for r in new.collect()) == [
        (0, 5, "event_batch", 4, 3, 5), (0, 6, "event_batch", 8, 1, 1), (0, 7, "event_batch", 8, 2, 2), (0, 8, "soft_trim", 4, 3, None), (1, 2, "soft_delete", 5, 1, None)]
    store = Store(spark, f"{tmp_path}/log")
    store.append(before)
    store.commit()
    store.append(new.select(before.columns))
    store.commit()
    assert versions(read.guarded(store.wal(), 8)) == [1, 2] and versions(read.guarded(store.wal(), 4, ReadFilters(from_version=3))) == [3]
    with pytest.raises(errors.LogError, match="1001"):
        read.guarded(store.wal(), 5)


def test_compaction_keeps_what_can_be_read(spark):
    rows = [batch(1), batch(2, version=2), tomb(3, "soft_trim", keep=2), batch(4, 2), tomb(5, "soft_delete", 2, continues=False), batch(6, 2, version=2), batch(7, 3), tomb(8, "soft_delete", 3, continues=True), batch(9, 3, version=2), batch(10, 6), tomb(11, "soft_delete", 6, continues=True)]
    # trimmed at 4, deleted, made anew: the old floor is of other versions
    rows += [batch(20 + i, 7, version=i) for i in range(1, 6)] + [tomb(26, "soft_trim", 7, keep=4), tomb(27, "soft_delete", 7, continues=False)] + [batch(27 + i, 7, version=i) for i in range(1, 4)]
    wal = log(spark, rows)
    kept = lambda df: sorted(r["wal_seq"] for r in df.where("keep").collect())
    assert kept(compact.marked(wal)) == [2, 3, 5, 6, 8, 9, 11, 26, 27, 28, 29, 30]
    assert kept(compact.marked(wal, continued=True)) == [2, 3, 5, 6, 7, 8, 9, 11, 26, 27, 28, 29, 30]
    small = compact.marked(wal, continued=True).where("keep").drop("keep")
    assert sorted(r["wal_seq"] for r in read.live(small).collect()) == sorted(r["wal_seq"] for r in read.above_floor(read.live(wal), read.floors(wal)).collect())


def test_incarnations(spark):
    """Reads see the last incarnation only, with its own floor."""
    rows = [batch(i, 4, version=i) for i in range(1, 6)] + [tomb(6, "soft_trim", 4, keep=4), tomb(7, "soft_delete", 4, continues=False), batch(8, 4, version=1, events=((9, 1),)), batch(9, 4, version=2, events=((10, 2),))]
    rows += [batch(20, 8), tomb(21, "soft_delete", 8, continues=True), batch(22, 8, version=2), tomb(23, "soft_trim", 8, keep=2), batch(30, 12), tomb(31, "soft_delete", 12, continues=True)]
    wal = log(spark, rows)
    assert versions(read.guarded(wal, 4)) == [1, 2]
    state = {r["aggregate_id"]: r for r in read.state(wal).collect()}
    assert (state[4]["min_version"], state[4]["max_version"], state[4]["max_event_seq"], state[4]["is_deleted"]) == (1, 2, 2, False)
    assert (state[8]["min_version"], state[8]["max_version"]) == (2, 2) and state[12]["is_deleted"] and state[12]["max_version"] == 1
    assert sorted((r["aggregate_id"], r["aggregate_version"]) for r in read.read(wal).collect()) == [(4, 1), (4, 2), (8, 1), (8, 2)]
    assert {r["aggregate_id"]: (r["code"], r["floor"]) for r in read.answers(wal).collect()} == {4: (0, 0), 8: (1000, 2), 12: (1001, 0)}
    assert versions(read.with_payloads(wal, ReadFilters(min_client_seq=10))) == [2]


def test_chain_breaks_are_found_across_windows(spark):
    wal = log(spark, [batch(i, version=i) for i in range(1, 30)])
    made = chain.made(wal)
    assert chain.breaks(made).count() == 0
    bad = made.withColumn("content", F.when(F.col("wal_seq") == 7, F.lit("x")).otherwise(F.col("content")))
    assert [r["wal_seq"] for r in chain.breaks(bad).collect()] == [7]
    # a chain that lost its head, or a row
    assert [r["wal_seq"] for r in chain.breaks(made.where("wal_seq > 2")).collect()] == [3]
    tip = made.where("wal_seq = 2").first()
    assert chain.breaks(made.where("wal_seq > 2"), {1: (3, tip["tip"])}).count() == 0
    assert [r["wal_seq"] for r in chain.breaks(made.where("wal_seq <> 9")).collect()] == [10]
    # following another node: cut back, then theirs as far as it can be followed
    theirs = chain.made(wal.withColumn("server_timestamp", F.col("server_timestamp") + (F.col("wal_seq") > 5).cast("long")))
    got = chain.reconciled(made, theirs).orderBy("wal_seq").collect()
    assert [r["tip"] for r in got] == [r["tip"] for r in theirs.orderBy("wal_seq").collect()] and chain.truncated(made, theirs).count() == 5
    assert chain.reconciled(made, theirs.where("wal_seq <> 20")).count() == 19
    assert chain.reconciled(made.limit(0), theirs.where("wal_seq > 1")).count() == 0


def test_store_commits_once_and_reads_what_is_visible(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/log")
    wal = log(spark, [batch(i, aggregate=i % 3, version=i) for i in range(1, 10)] + [tomb(10, "soft_trim", aggregate=1, keep=7)])
    store.append(wal)
    assert store.commit({0: 4, 1: 5, 2: 3}) == 1
    assert store.wal().count() == wal.where("shard_id = 0 AND wal_seq <= 4 OR shard_id = 1 AND wal_seq <= 5 OR shard_id = 2 AND wal_seq <= 3").count()
    assert store.commit() == 2 and store.wal().count() == 10 and store.wal(1).count() < 10
    other = Store(spark, f"{tmp_path}/log")
    other.manifest = lambda number=None: {"number": 1, "visible": {}}  # a writer that hasn't seen the second commit
    with pytest.raises(CommitConflict):
        other.commit({0: 1})
    store.write_summaries()
    assert store.summaries().count() == 3
    assert store.compact(f"{tmp_path}/small").wal().where("kind = 'event_batch'").count() < 9
    write_history(spark.createDataFrame([("op", 1, "7"), ("ryw", 2, "8")], "type string, process bigint, agg_id string"), f"{tmp_path}/history")
    assert read_history(spark, f"{tmp_path}/history", "op").first()["agg_id"] == "7"


@pytest.mark.parametrize("text, good", [('{"amount": 42}', True), ('{"amount": "42"}', False), ("{}", False), ('{"amount": 42, "more": 1}', True), ('{"amount": -1}', False), ("[]", False), ("nonsense", False), (None, False)])
def test_json_schema(spark, text, good):
    schema = '{"type": "object", "properties": {"amount": {"type": "integer", "minimum": 0}}, "required": ["amount"]}'
    assert spark.createDataFrame([(text,)], "p string").select(schemas.valid_json(F.col("p"), schema)).first()[0] is good


def test_bad_schemas_are_refused():
    for schema in ("nonsense", "[]", '{"type": "array"}', " " * 20_000):
        with pytest.raises(errors.LogError, match="2021"):
            schemas.check(schema)


def test_ids_and_routing(spark):
    big = 0xFEDCBA98765432100123456789ABCDEF
    rows = spark.createDataFrame([(f"{big:032x}",), ("FEDCBA98-7654-3210-0123-456789ABCDEF",), ("255",), ("x",)], "id string")
    got = rows.select(scalars.hex_id(F.col("id")), scalars.shard_of_hex(scalars.hex_id(F.col("id")), 7)).collect()
    assert [r[0] for r in got] == [f"{big:032x}", f"{big:032x}", f"{255:032x}", None]
    assert [r[1] for r in got][:3] == [big % 7, big % 7, 255 % 7]
    assert spark.range(5).select(scalars.shard_of(F.col("id"), 1)).distinct().collect()[0][0] == 0


def test_watch_streams(spark, tmp_path):
    wal = log(spark, [batch(1), batch(2, version=2), tomb(3, "soft_trim", keep=2), batch(4, 2)]).select("shard_id", *model.KEY, "kind", "wal_seq", "aggregate_version", "keep_from")
    wal.repartition(3).write.parquet(f"{tmp_path}/wal")
    got = watch.collected(spark, f"{tmp_path}/wal", wal.schema, f"{tmp_path}/out", files=1)
    assert {(r["aggregate_id"], r["op"]): (r["from_version"], r["to_version"], r["keep_from"]) for r in got.collect()} == {(1, "create"): (1, 1, None), (1, "write"): (1, 2, None), (1, "trim"): (1, 1, 2), (2, "create"): (1, 1, None), (2, "write"): (1, 1, None)}
    assert [r["op"] for r in watch.commit_order(watch.merged(watch.changes(wal))).where("aggregate_id = 1").collect()] == ["create", "write", "trim"]
    with pytest.raises(errors.LogError, match="8001"):
        watch.feed(spark, f"{tmp_path}/wal", wal.schema, print, f"{tmp_path}/c", latency_ms=2001)


def test_stream_without_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:00:10")], "event_id bigint, t string").select("event_id", F.col("t").cast("timestamp").alias("server_time"))
    rows.write.parquet(f"{tmp_path}/in")
    query = watch.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_entry_imports_without_the_training_data_package():
    """The queries of the log don't need eventloom.llm or corpus_pipeline."""
    import subprocess
    import sys

    code = "import sys; sys.modules['eventloom.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None and len(e.queries()) > 100 and 'pipeline' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_checkers_beyond_what_is_broadcast(spark, monkeypatch):
    """Bounds of broadcast sides change the way of the join, not its result."""
    probes = [(i, n, t, 1, 2) for i, t in enumerate((-9, -1, 0, 5, 6, 9, 10, 100, 163, 164, 10**15)) for n in (1, 2)]
    probes = spark.createDataFrame(probes, "probe_id bigint, node bigint, t_ns bigint, observed_version bigint, acked_version bigint")
    windows = spark.createDataFrame([(5, 5), (-3, -1), (9, 8), (10, 163), (7, 9), (-(2**62), -5), (2 * 10**14, 2**62)], "low bigint, high bigint")
    wal = spark.createDataFrame([(s, q) for s in range(4) for q in (s, s + 1, s + 3)], "shard_id bigint, wal_seq bigint")
    for bound in (100, 2):
        monkeypatch.setattr(checkers, "MOST_WINDOWS", bound, raising=False)
        monkeypatch.setattr(checkers, "MOST_SHARDS", bound, raising=False)
        assert sorted(r["probe_id"] for r in checkers.ryw(probes, windows).collect()) == [2, 4, 9]
        assert sorted(tuple(r) for r in checkers.contiguous(wal).collect()) == [(s, s + 3) for s in range(4)]
    many = spark.range(10_050).select((F.col("id") * 4 + 200).alias("low"), (F.col("id") * 4 + 201).alias("high"))
    monkeypatch.undo()
    late = spark.createDataFrame([(1, n, t, 1, 2) for n, t in ((1, 40_396), (2, 40_397))] + [(2, n, 40_398, 1, 2) for n in (1, 2)], probes.schema)
    assert [r["probe_id"] for r in checkers.ryw(late, many).collect()] == [2]


def test_scalars_and_segments(spark):
    import uuid

    rows = spark.createDataFrame([("a",), ("Ärger",)], "name string").select("name", scalars.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("name")).alias("id")).collect()
    assert all(r["id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["name"])) for r in rows)
    wal = log(spark, [batch(i, 4, version=i, size=s) for i, s in enumerate((40, 40, 40, 500, 40), 1)])
    got = {r["wal_seq"]: r["log_id"] for r in model.rotated(wal, 100, bucket_rows=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 7}


def test_subscribers():
    now = [0.0]
    group = watch.Subscribers(most=2, waiting=3, clock=lambda: now[0])
    first, second = group.add(orgs=[1], ops=["write"]), group.add()
    with pytest.raises(errors.LogError, match="8005"):
        group.add()
    change = lambda org, op: {"org_id": org, "aggregate_type_id": 1, "aggregate_id": 1, "op": op}
    group.publish([change(1, "write"), change(2, "write"), change(1, "trim")])
    assert group.take(first) == [change(1, "write")] and group.take(first) is None
    now[0] = 6.0
    assert group.take(first) == []  # a heartbeat
    group.publish([change(2, "write")])
    assert second not in group and group.take(second) is None and len(group) == 1  # it didn't keep up


def test_cli(spark, tmp_path, capsys):
    from eventloom import cli
    from eventloom.sources import inline

    store = Store(spark, f"{tmp_path}/log")
    store.append(log(spark, [batch(1, 4), batch(2, 8, version=1), tomb(3, "soft_delete", 8, continues=False)]))
    store.commit()
    run = lambda *args: cli.main(["--log", f"{tmp_path}/log", "--json", *args], spark)
    assert run("orgs") == 0 and capsys.readouterr().out == '{"org_id":1}\n'
    assert run("aggregates") == 0 and '"aggregate_id":4' in capsys.readouterr().out
    assert run("read", "8") == 1 and "1001" in capsys.readouterr().err
    assert run("details", "8") == 0 and '"is_deleted":true' in capsys.readouterr().out
    schema = '{"type": "object", "required": ["a"]}'
    assert run("check", "--schema", schema, "--data", '[{"client_seq": 1, "event_value": {"a": 2}}, {"client_seq": 2, "event_value": "{}"}]') == 0
    assert capsys.readouterr().out.splitlines() == ['{"client_seq":1,"valid":true}', '{"client_seq":2,"valid":false}']
    (tmp_path / "e.json").write_text('{"client_seq": 1, "event_value": "x"}\n{"client_seq": 2, "event_type_minor": 3}\n')
    rows = inline.events_from_file(spark, f"{tmp_path}/e.json").collect()
    assert [(r["client_seq"], r["event_value"], r["event_type_minor"]) for r in rows] == [(1, "x", 0), (2, None, 3)] == [(r["client_seq"], r["event_value"], r["event_type_minor"]) for r in inline.events_from_text(spark, (tmp_path / "e.json").read_text()).collect()]


def test_segments_are_pruned(spark, tmp_path):
    """A read of one segment lists its folder only, and a predicate on an aggregate reaches the scan."""
    store = Store(spark, f"{tmp_path}/log")
    store.append(log(spark, [batch(i, 4 * i, log_id=1 + i // 10) for i in range(1, 40)]))
    plan = store.written().where("shard_id = 0 AND log_id = 2 AND aggregate_id = 48")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan and "log_id" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(aggregate_id,48)" in plan
    assert len({r[0] for r in store.written().where("log_id = 2").select(F.input_file_name()).collect()}) < len({r[0] for r in store.written().select(F.input_file_name()).collect()})


def test_columns_have_bloom_filters(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/log")
    store.append(log(spark, [batch(i, 4 * i, client=1000 + i) for i in range(1, 40)]))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for name in store.written().inputFiles():
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        for block in reader.getFooter().getBlocks():
            found |= {c.getPath().toDotString() for c in block.getColumns() if c.getBloomFilterOffset() > 0}
        reader.close()
    assert {"aggregate_id", "client_id"} <= found


def test_stretches_of_ticks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(host, t, t * 10 + host, rng.random() < 0.95, role, t, t + rng.randint(0, 9) + (0 if role else 6)) for t in range(120) for host, role in ((0, int(t % 11 > 2)), (1, 0))]
    samples = spark.createDataFrame(rows, "host long, tick long, t_ms long, ok boolean, role int, write_seq long, read_seq long")
    got = []
    for stretch in (1000, 7):
        monkeypatch.setattr(checkers, "STRETCH", stretch)
        got.append((sorted(map(tuple, checkers.never_ahead(samples).collect())), checkers.longest_gap(samples).collect()))
    assert got[0] == got[1] and got[0][0]
