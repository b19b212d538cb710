"""N-gram Jaccard self-join by grouped prefixes.

The set of a document is its distinct word shingles, as 52-bit hashes; two documents link when
100 * |A and B| >= 75 * |A or B|. In any fixed order of all shingles, two sets that link share a shingle among
the first n - ceil(0.75 n) + 1 of each (the prefix). The order puts frequent shingles last.

1. `frequent`: shingles that repeat within a task's share of the documents are counted (summed over all); the
   most frequent MOST_FREQUENT of them are ordered last, by the logarithm of the count. This bounded list only
   steers the order, so what it misses costs time, never a link.
2. `profile`: size, 128-bit key of the set and of (size, prefix), and the prefix, of each document.
3. Documents with equal prefix and size are one group. Each task packs the prefixes of its groups into one
   array for each range of shingles; the arrays are shuffled by range, and sorting one gives, for each
   shingle, the groups that have it. All of them go to the bundle of the first one. Pairs are never written.
   Within a shingle's groups a bundle ends where sizes differ too much to link. Shingles of class HOT and above don't meet in
   a range: each makes bundles of its own, one for each size class (sizes of two that follow one another can link, so a group is in two).
4. Bundles are expanded to the distinct sets of their groups. A bundle of more than LEAST_ROWS sets, or with more than BLOCK_SHINGLES
   shingles, is dealt out to several blocks, each with a few sets of the bundle (hubs) besides its own. In the others, a set stays
   only if its bitmap (two bits or more a shingle, by hash) leaves room for enough common shingles with
   another one: a bit of A that B lacks is a shingle of A that B lacks, so no link is lost.
5. The sets of a block are verified in one task: exact intersections, links as a spanning forest. Where a
   bundle had several blocks, sets that aren't linked to its largest class by then meet every
   block in a second round, MOST_ROWS of them at a time: first by bitmaps alone, then, where these leave room for a link, exactly. So each pair that
   shares a prefix shingle is either verified or known to be in one component.
6. Components of the links, with equal sets linked to their smallest id.

Null, empty and blank texts have an empty set and link with nothing. Rows with equal doc_id count as one
document whose texts may all link; a row with null doc_id has its n_shingles, no links and a null component.
An empty table gives an empty result. Sets of any size are whole; a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, cut, runs, ship, unused
from eventloom.llm.components import components
from eventloom.llm.hashing import mix, shingle_sets

WIDTH, PERCENT = 5, 75
#: Frequent shingles that the order knows, and how often a shingle must be counted to be one.
MOST_FREQUENT, FREQUENT = 1 << 18, 16
#: Class of shingles (the logarithm of how often they were counted) from which each has bundles of its own.
HOT = 17
#: Shingles a task counts at a time, entries of a shuffled array, ids that may be broadcast.
COUNT_CHUNK, PACK_CHUNK, BROADCAST_IDS = 1 << 21, 1 << 19, 1 << 20
#: Sets of a block: a thirty-second of the bundle within these bounds; shingles of all of them, and hubs that go to every block of a bundle (on average).
LEAST_ROWS, MOST_ROWS, BLOCK_SHINGLES, HUBS = 64, 512, 1 << 20, 4

Sets = Iterator[tuple[int, np.ndarray, np.ndarray]]


def frequent(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, and the class (1 or more, higher: more frequent) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            more = count > 1
            return pa.RecordBatch.from_arrays([pa.array(value[more].astype(np.int64)), pa.array(count[more].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, found, _ in shingle_sets(batch.column(0), width):
                held.append(found)
                size += len(found)
                if size >= COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counted = docs.select(docs[text].alias("__text")).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    value, count = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(value)
    return value[order].astype(np.uint64), np.log2(count[order]).astype(np.int64)


def _key(found: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """An order-independent 64-bit key of each run."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ np.uint64(salt)), dtype=np.uint64)])
    return mix((total[starts[1:]] - total[starts[:-1]]) ^ np.diff(starts).astype(np.uint64))


def _prefixes(found: np.ndarray, starts: np.ndarray, known: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set in the order, and where each starts."""
    n = np.diff(starts)
    size = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    value, level = known
    if len(value) and len(found):
        at = np.searchsorted(value, found)
        at[at == len(value)] = 0
        level = np.where(value[at] == found, level[at], 0)
        if level.any():
            found = found[np.argsort(owner * 64 + level, kind="stable")]  # within a level by hash, as before
    place = np.arange(len(found)) - starts[:-1][owner]
    return found[place < size[owner]], np.concatenate([[0], np.cumsum(size)])


def _bitmaps(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the bitmap of each set, and where each starts: 64 bits or the power of two from twice the size on, by the low bits of the hash."""
    n = np.diff(starts)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    flags = np.zeros(at[-1], bool)
    flags[np.repeat(at[:-1], n) + (found & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little"), at // 8


def _blobs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values from an array and where each starts in it."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def profile(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n, k1, k2 (of the set), g (of size and prefix), prefix (64-bit numbers) and bits binary."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found, starts in shingle_sets(batch.column(1), width):
                n = np.diff(starts)
                prefix, at = _prefixes(found, starts, held.value, percent)
                g = mix(_key(prefix, at, 3) ^ n.astype(np.uint64))
                as_long = lambda x: pa.array(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(n)), pa.array(n.astype(np.int64)), as_long(_key(found, starts, 1)), as_long(_key(found, starts, 2)), as_long(g), _blobs(prefix, at), _blobs(*_bitmaps(found, starts))], [key, "n", "k1", "k2", "g", "prefix", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, f"`{key}` {kind}, n bigint, k1 bigint, k2 bigint, g bigint, prefix binary, bits binary")


def _bundles(groups: DataFrame, ranges: int, percent: int, hot: np.ndarray) -> DataFrame:
    """leader, member: groups that share a prefix shingle, under the first of them, or under a number made from the shingle if it is hot (sorted). groups: g, n, prefix."""

    def _is_hot(token: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hot, token)
        at[at == len(hot)] = 0
        return hot[at] == token

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = np.floor(np.log(n) / np.log(100 / percent)).astype(np.uint64)
            for low in range(0, len(g), 512):
                parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2).slice(low, 512)]
                owner = np.repeat(np.arange(low, low + len(parts)), [len(p) for p in parts])
                token = np.concatenate(parts)
                here = _is_hot(token)
                owner, token = owner[here], token[here]
                # sizes that link are of one class, or of two that follow one another
                leader = np.concatenate([mix(mix(token) ^ (size[owner] + np.uint64(k))) for k in (0, 1)])
                yield pa.RecordBatch.from_arrays([pa.array(leader.view(np.int64)), pa.array(np.concatenate([g[owner]] * 2))], ["leader", "member"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            token, g, n = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            part = (token % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(bounds))
            cut_up = lambda x: [x[order[bounds[r] : bounds[r + 1]]].tobytes() for r in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(cut_up(x), pa.binary()) for x in (token, g, n))], ["r", "token", "g", "n"])

        for batch in batches:
            g, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prefix = batch.column(2)
            for low in range(0, len(g), 512):
                parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in prefix.slice(low, 512)]
                if len(hot):
                    parts = [p[~_is_hot(p)] for p in parts]
                length = [len(p) for p in parts]
                tokens += parts
                owners.append(np.repeat(g[low : low + 512], length))
                sizes.append(np.repeat(n[low : low + 512].astype(np.int32), length))
                held += sum(length)
                if held >= PACK_CHUNK:
                    yield flush()
                    tokens, owners, sizes, held = [], [], [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {"token": [], "g": [], "n": []}
        for batch in batches:
            for name, kind in (("token", np.uint64), ("g", np.int64), ("n", np.int32)):
                parts[name] += [np.frombuffer(x.as_py(), kind) for x in batch.column(name)]
        if not parts["token"]:
            return
        token, g, n = (np.concatenate(parts[x]) for x in ("token", "g", "n"))
        parts.clear()
        # only shingles of two groups or more
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        order, token = order[keep], token[keep]
        g, n = g[order], n[order]
        order = np.lexsort((g, n, token))
        token, g, n = token[order], g[order], n[order]
        if not len(token):
            return
        # a run ends at another shingle, or where no set before can link with one after
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
        run = np.cumsum(new) - 1
        leader = np.minimum.reduceat(g, np.flatnonzero(new))[run]
        good = leader != g
        pairs = np.unique(np.stack([leader[good], g[good]], 1), axis=0) if good.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "member"])

    packed = groups.select("g", "n", "prefix").mapInArrow(pack, "r bigint, token binary, g binary, n binary")
    found = packed.repartition(ranges, "r").mapInArrow(gather, "leader bigint, member bigint")
    if len(hot):
        found = found.unionByName(groups.select("g", "n", "prefix").mapInArrow(direct, "leader bigint, member bigint"))
    return found.distinct()


def linked(sizes: np.ndarray, tokens: np.ndarray, hubs: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets of a block that join all that is linked there (a spanning forest); hubs: only pairs with one of these."""
    m = len(sizes)
    _, ids = np.unique(tokens, return_inverse=True)
    times = np.bincount(ids)
    shared = times[ids] > 1
    owner = np.repeat(np.arange(m), sizes)[shared]
    ids = ids[shared]
    flag = np.zeros(len(times), bool)
    begin = np.searchsorted(owner, np.arange(m + 1))
    root = np.arange(m)
    edges = []
    for hub in range(m) if hubs is None else hubs:
        own = ids[begin[hub] : begin[hub + 1]]
        if not len(own) or (root == root[hub]).all():
            continue
        flag[own] = True
        common = np.bincount(owner[flag[ids]], minlength=m)
        flag[own] = False
        # unions with the hub's class need no test
        hit = np.flatnonzero((100 * common >= percent * (sizes + sizes[hub] - common)) & (common > 0) & (root != root[hub]))
        for other in hit.tolist():
            if root[other] != root[hub]:
                edges.append((int(hub), other))
                root[root == root[other]] = root[hub]
    return edges


def may_link(sizes: np.ndarray, bitmaps: list[bytes], percent: int, side: np.ndarray | None = None, component: np.ndarray | None = None) -> np.ndarray:
    """Which sets have another one that they may link with, by their bitmaps; if sides are given, one of the other side and of another component."""
    good = np.zeros(len(sizes), bool)
    width = np.array([len(x) for x in bitmaps])
    for w in np.unique(width):
        # sets that link differ in size by a third at most, and in the width of their bitmaps by one step
        own = np.flatnonzero((width == w) | (width == 2 * w))
        rows = np.zeros((len(own), w // 8), np.uint64)
        for i, x in enumerate(own):
            rows[i] = np.bitwise_or.reduce(np.frombuffer(bitmaps[x], np.uint64).reshape(-1, w // 8), 0)
        n = sizes[own]
        for i in range(len(own) - 1):
            rest = rows[i + 1 :]
            most = np.minimum(n[i] - np.bitwise_count(rows[i] & ~rest).sum(1, dtype=np.int64), n[i + 1 :] - np.bitwise_count(rest & ~rows[i]).sum(1, dtype=np.int64))
            hit = 100 * most >= percent * (n[i] + n[i + 1 :] - most)
            if side is not None:
                hit &= (side[own[i + 1 :]] != side[own[i]]) & (component[own[i + 1 :]] != component[own[i]])
            hit = np.flatnonzero(hit)
            if len(hit):
                good[own[i]] = True
                good[own[i + 1 + hit]] = True
    return good


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """leader, block, rep, k1, k2 of the sets that may link inside their bundle. rows: the same, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            if group.num_rows > 1:
                good = may_link(group.column(5).to_numpy(), group.column(6).to_pylist(), percent)
                if good.any():
                    yield group.select(["leader", "block", "rep", "k1", "k2"]).filter(pa.array(good))

    ordered = rows.select("leader", "block", "rep", "k1", "k2", "n", "bits").repartition("leader", "block").sortWithinPartitions("leader", "block")
    return ordered.mapInArrow(run, "leader bigint, block bigint, rep bigint, k1 bigint, k2 bigint")


def _visits(rows: DataFrame, percent: int) -> DataFrame:
    """leader, block, rep, k1, k2, late of the sets that may link with one of the other kind (late or not) and of another component. rows: the same, component, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            late, component = group.column(5).to_numpy(), group.column(6).to_numpy()
            if not late.any() or late.all():
                continue
            good = may_link(group.column(7).to_numpy(), group.column(8).to_pylist(), percent, late, component)
            if good.any():
                yield group.select(["leader", "block", "rep", "k1", "k2", "late"]).filter(pa.array(good))

    ordered = rows.select("leader", "block", "rep", "k1", "k2", "late", "component", "n", "bits").repartition("leader", "block").sortWithinPartitions("leader", "block")
    return ordered.mapInArrow(run, "leader bigint, block bigint, rep bigint, k1 bigint, k2 bigint, late bigint")


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links within each block. rows: leader, block, rep, late (1: compare with all; no row of the block has it: compare all), blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for group in runs(batches, 2):
            if group.num_rows < 2:
                continue
            reps, late = group.column(2).to_numpy(), group.column(3).to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(4)]
            sizes = np.array([len(s) for s in sets])
            hubs = np.flatnonzero(late == 1) if (late >= 0).any() else None
            edges = linked(sizes, np.concatenate(sets), hubs, percent)
            if edges:
                found.append(reps[np.array(edges)])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    ordered = rows.select("leader", "block", "rep", "late", "blob").repartition("leader", "block").sortWithinPartitions("leader", "block")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, one row for each row of docs. The key is a bigint."""
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession) as work:
        return cut(_join(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), key, width, percent, work))


def _join(docs: DataFrame, key: str, width: int, percent: int, work: Scratch) -> DataFrame:
    spark = docs.sparkSession
    known = frequent(docs, "text", width)
    made = work.cut(profile(docs, known, "id", "text", width, percent))
    some = made.where("n > 0 AND id IS NOT NULL")

    # groups and the bundles that their prefixes make
    grouped = some.groupBy("g").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = some.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    ranges = max(shuffles, int(entries // 4e6) + 1)
    hot = known[0][known[1] >= HOT]
    bundles = work.cut(_bundles(work.cut(grouped) if len(hot) else grouped, ranges, percent, hot))
    classes = work.cut(some.groupBy("g", "k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")))
    several = classes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    leaders = bundles.select("leader").distinct().select("leader", F.col("leader").alias("member")).unionByName(several.select(F.col("g").alias("leader"), F.col("g").alias("member"))).distinct()
    members = work.cut(bundles.unionByName(leaders).join(classes.select(F.col("g").alias("member"), "k1", "k2", "n", "rep"), "member").select("leader", "k1", "k2", "n", "rep"))
    # few bundles need several blocks (there are at most as many as a block's bounds go into all members)
    m = F.count(F.lit(1))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, m / F.least(F.greatest(m / 32, F.lit(LEAST_ROWS)), F.lit(MOST_ROWS)))).cast("long")
    large = work.cut(members.groupBy("leader").agg(blocks.alias("blocks"), m.alias("m"), F.min(F.struct("k1", "k2")).alias("hub")).where("blocks > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    hub = (F.struct("k1", "k2") == F.col("hub")) | (F.pmod(F.xxhash64(F.lit(HUBS), "k1", "k2"), F.greatest(F.lit(1), F.floor(F.col("m") / HUBS))) == 0)
    placed = members.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", one)).withColumn("home", F.pmod(F.xxhash64("k1", "k2"), "blocks"))
    everywhere = F.when((F.col("blocks") > 1) & hub, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("home"))
    dealt = work.cut(placed.withColumn("block", F.explode(everywhere)).select("leader", "block", "home", "blocks", "rep", "k1", "k2"))
    bits = classes.select("k1", "k2", "n", "bits", "rep")
    kept = work.cut(
        _survivors(dealt.where("blocks = 1").join(bits, ["rep", "k1", "k2"]), percent)
        .unionByName(dealt.where("blocks > 1").select("leader", "block", "rep", "k1", "k2"))
    )

    # the sets of the documents that stand for their class
    needed = work.cut(kept.select("rep", "k1", "k2").distinct())
    ids = needed.select(F.col("rep").alias("id")).distinct()
    chosen = docs.join(F.broadcast(ids), "id", "left_semi") if needed.count() <= BROADCAST_IDS else docs.join(ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found, starts in shingle_sets(batch.column(1), width):
                as_long = lambda salt: pa.array(_key(found, starts, salt).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(starts) - 1), as_long(1), as_long(2), _blobs(found, starts)], ["rep", "k1", "k2", "blob"])

    of_rep = chosen.select("id", "text").mapInArrow(sets, "rep bigint, k1 bigint, k2 bigint, blob binary").dropDuplicates(["rep", "k1", "k2"])
    links = work.cut(_verify(kept.join(of_rep, ["rep", "k1", "k2"]).withColumn("late", F.lit(-1).cast("long")), percent))

    # second round, for bundles of several blocks: what isn't in the bundle's largest class meets every block
    split = dealt.where("blocks > 1 AND block = home").select("leader", "home", "blocks", "rep", "k1", "k2")
    if not split.isEmpty():
        so_far = components(links, work=work).withColumnsRenamed({"node": "rep"})
        placed = work.cut(split.join(so_far, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
        largest = placed.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("leader").agg(F.max_by("component", F.struct("m", "component")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).where("others > 0")
        late = placed.join(largest.select("leader", "main", F.ceil(F.col("others") / MOST_ROWS).cast("long").alias("turns")), "leader").join(bits, ["rep", "k1", "k2"])
        away = F.col("component") != F.col("main")
        upto = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
        # a block's own sets are there for each turn; a late one goes to all blocks in its turn
        columns = ["leader", "block", "rep", "k1", "k2", "late", "component", "n", "bits"]
        stay = late.withColumn("turn", upto("turns")).withColumn("at", F.col("home")).withColumn("late", zero)
        move = late.where(away).withColumn("turn", F.pmod(F.xxhash64("k2", "k1"), "turns")).withColumn("at", upto("blocks")).withColumn("late", one)
        visits = stay.unionByName(move).withColumn("block", F.col("at") * F.col("turns") + F.col("turn")).select(*columns)
        found = work.cut(_visits(visits, percent))
        links = work.cut(links.unionByName(_verify(found.join(of_rep, ["rep", "k1", "k2"]), percent)))

    # rows of one id with several sets tie these together
    twice = some.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    ties = some.join(twice, "id", "left_semi").join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(ties), work=work)
    placed = classes.join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").where("copies > 1 OR component IS NOT NULL").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = made.select("id", "n", "k1", "k2").join(placed, ["k1", "k2"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (all columns) with one document of each component: the smallest id. Of rows with one id, the first by text stays; rows without an id stay."""
    helper, rank = unused(docs.columns, "__id", "__rank")
    placed = join(docs, key, text).select(F.col(key).alias(helper), "component_id")
    gone = cut(placed.where(F.col(helper) != F.col("component_id")).select(helper).distinct())
    twice = cut(placed.where(F.col(helper).isNotNull()).groupBy(helper).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(helper))
    small = gone.count() + twice.count() <= BROADCAST_IDS
    side = lambda df: F.broadcast(df) if small else df
    kept = docs.withColumn(helper, F.col(key).cast("long")).join(side(gone), helper, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    first = kept.join(side(twice), helper, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(helper).orderBy(text))).where(F.col(rank) == 1)
    return kept.join(side(twice), helper, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))
