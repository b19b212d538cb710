"""Near-duplicate embeddings by NN-descent.

Vectors with equal label (and dimension) are compared by cosine; pairs of at least THRESHOLD link.

1. Equal vectors of a label are one node with a number of copies.
2. Each node starts with a list of its best neighbours in ORDERS orders of all nodes by random hyperplane codes: those at most RUN
   places away, EACH of each run. RUN is far smaller than a label, so this only seeds the lists.
3. NN-descent: nodes that have a node in their list meet in its group, so neighbours' neighbours are joined; pairs with a new member
   are compared, and each node keeps its best neighbours. A node whose list is saturated (full, all of it above the threshold) gets a
   list twice as long, up to LONGEST. Groups of nodes that very many have in their list are dealt out to parts of about PART rows, by a hash that
   differs in each round. Rounds go on until few lists change. All pairs above the threshold that any run or group sees are kept as a spanning
   forest, so what a list has no room for isn't lost.
4. Candidate classes are the components of these pairs. Within each, all pairs are compared exactly in
   double precision, block against block, which gives the threshold edges: links are counted, not written,
   and a spanning forest of them gives the components. Saturated lists are thereby completed exactly.
5. Recall audit: a sample of each label (by hash, AUDIT nodes, more of larger labels) is compared with all nodes of the
   label by brute force, and the share of its links that lie within candidate classes is taken node by node. Labels whose mean over
   nodes with links, or over those with more than LONGEST, is below RECALL get new orders and rounds, TRIES times at most. Labels with
   too few linked nodes in the sample are judged together, by a sample MORE times as large if those are too few as well. What is still below, or
   can't be judged, is one class in step 4, so all its pairs are compared: exact, and quadratic in the size of the label. Links that the audit
   itself finds are kept. Bits, number of orders and sample grow with the largest label beyond USUAL nodes.

Lists and groups use half-precision unit vectors and a threshold lower by SLACK, above their rounding error; step 4 decides.
Null, zero and empty vectors, and vectors with null or non-finite components, and rows with a null label or id,
link with nothing (a null id has a null component). Rows with equal id, label and vector are one vector, which counts once. Rows of one id
with other vectors or labels are vectors of their own, each with its own links; the id ties them into one
component. Ties between neighbours go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, cut, ship, whole
from eventloom.llm.components import components, spanning

THRESHOLD, SLACK = 0.93, 0.004
ORDERS, RUN, EACH, BITS = 6, 16, 5, 16
LIST, LONGEST, PART, BEST = 10, 40, 256, 3
ROUNDS, CHANGED = 8, 0.02
AUDIT, RECALL, TRIES, MORE = 128, 0.98, 3, 8
#: Nodes of a block of the exact step: a twenty-fourth of the class within these bounds.
LEAST_BLOCK, MOST_BLOCK = 32, 2048
#: Size of a label from which effort grows; nodes of all samples together; linked nodes from which a label is judged by its own; centres that may be broadcast.
USUAL, MOST_AUDITED, LEAST_LINKED, BROADCAST = 1 << 13, 1 << 14, 20, 1 << 20

_FOUND = "id bigint, near array<bigint>, sims array<float>"
_LISTS = "id bigint, half binary, near array<bigint>, sims array<float>, fresh array<boolean>, k int, least float, n_fresh bigint"


def _unit(data: list[bytes], dtype: type = np.float32) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float16).reshape(len(data), -1).astype(np.float32)


def _by_size(data: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, where) of values of equal length."""
    length = np.array([len(x) for x in data], np.int64)
    for size in np.unique(length):
        yield int(size), np.flatnonzero(length == size)


def _raw(value: pa.ListScalar) -> bytes | None:
    """The components as doubles; null for what links with nothing."""
    if not value.is_valid or not len(value.values) or value.values.null_count:
        return None
    x = value.values.to_numpy().astype(np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    norm = np.linalg.norm(x)
    if not np.isfinite(norm) or norm < 1e-150:  # scaled, so that squares neither overflow nor vanish
        x = x / np.abs(x).max()
    return (x + 0.0).tobytes()


def _vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, raw (null for what links with nothing) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_raw(v) for v in batch.column(2)], pa.binary())], ["id", "label", "raw"])

    typed = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return typed.mapInArrow(run, "id bigint, label bigint, raw binary")


def nodes(rows: DataFrame, work: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """id (the smallest of its copies, or a negative number if another node has that), least (the smallest id), label, raw, half (the unit vector in half precision), copies;
    and pairs of nodes that an id ties together (None: no id has two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            half: list = [None] * len(data)
            for _, here in _by_size(data):
                for i, x in zip(here.tolist(), _unit([data[i] for i in here], np.float64).astype(np.float16), strict=True):
                    half[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(half, pa.binary())], [*batch.schema.names, "half"])

    own = work.cut(_vectors(rows, key, vector, label).where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").distinct())
    made = own.groupBy("label", "raw").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    twice = work.cut(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    several = not twice.isEmpty()
    if several:
        other = -1 - F.shiftrightunsigned(F.xxhash64("label", "raw"), 1)
        rank = F.row_number().over(Window.partitionBy("least").orderBy("label", "raw"))  # nodes of one smallest id
        made = made.withColumn("id", F.when(rank == 1, F.col("least")).otherwise(other))
    else:
        made = made.withColumn("id", F.col("least"))
    known = work.cut(made.select("label", "raw", "id", "least", "copies").mapInArrow(run, "label bigint, raw binary, id bigint, least bigint, copies bigint, half binary"))
    if not several:
        return known, None
    held = own.join(twice, "id").join(known.select("label", "raw", F.col("id").alias("node")), ["label", "raw"])
    hub = held.groupBy("id").agg(F.min("node").alias("a"))
    return known, work.cut(held.join(hub, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct())


class _Out:
    """Candidates for lists, and a spanning forest of the close pairs as one row without an id: its pairs one after another."""

    def __init__(self):
        self.ids, self.sizes, self.near, self.sims, self.a, self.b, self.held = [], [], [], [], [], [], 0

    def add(self, ids: np.ndarray, sims: np.ndarray, least: np.ndarray, best: int, close: np.ndarray) -> None:
        """Each row's best columns above its least; pairs in `close`."""
        k = min(best, len(ids) - 1)
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, top, 1)
        good = value > least[:, None]
        some = np.flatnonzero(good.any(1))
        if len(some):
            self.ids.append(ids[some])
            self.sizes.append(good[some].sum(1))
            self.near.append(ids[top[some]][good[some]])
            self.sims.append(value[some][good[some]])
            self.held += len(some)
        i, j = np.nonzero(close)
        if len(i):
            a, b = spanning(ids[i], ids[j]) if len(i) > len(ids) else (ids[i], ids[j])
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)

    def flush(self) -> pa.RecordBatch:
        joined = np.stack(spanning(np.concatenate(self.a), np.concatenate(self.b)), 1).ravel() if self.a else np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        ids = pa.concat_arrays([pa.array(np.concatenate([none, *self.ids])), pa.nulls(1, pa.int64())])
        at = np.concatenate([[0], np.cumsum(np.concatenate([none, *self.sizes]))])
        near = pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + len(joined)), pa.int32()), pa.array(np.concatenate([none, *self.near, joined])))
        sims = pa.ListArray.from_arrays(pa.array(np.append(at, at[-1]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *self.sims]).astype(np.float32)))
        self.__init__()
        return pa.RecordBatch.from_arrays([ids, near, sims], ["id", "near", "sims"])


def _joined(found: DataFrame) -> DataFrame:
    """a, b of the spanning forests."""
    at = F.explode(F.expr("sequence(0, cast(size(near) div 2 as int) - 1)"))
    return found.where("id IS NULL AND size(near) > 0").select("near", at.alias("i")).select(F.get("near", 2 * F.col("i")).alias("a"), F.get("near", 2 * F.col("i") + 1).alias("b"))


def _start(known: DataFrame, orders: range, floor: float, parts: int, bits: int) -> DataFrame:
    """_FOUND from runs of several orders of the nodes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            for size, here in _by_size(data):
                x = _halves([data[i] for i in here])
                at = pa.array(here)
                for order in orders:
                    planes = np.random.default_rng((order, size)).standard_normal((x.shape[1], bits)).astype(np.float32)
                    value = ((x @ planes > 0) << np.arange(bits)).sum(1)
                    same = lambda v: pa.array(np.full(len(here), v, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(order), batch.column(1).take(at), same(size), pa.array(value), batch.column(0).take(at), batch.column(2).take(at)], ["o", "label", "size", "code", "id", "half"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, ids, x = _Out(), None, None, None

        def compare(low: int, high: int) -> None:
            if high - low < 2:
                return
            sims = x[low:high] @ x[low:high].T
            np.fill_diagonal(sims, -2)
            out.add(ids[low:high], sims, np.full(high - low, -2.0), EACH, np.triu(sims >= floor, 1))

        def windows(end: bool) -> None:
            """Compares all whole runs, or all that is left; the second half of a run is the first of the next, so neighbours in the order meet."""
            nonlocal ids, x
            low = 0
            while low + 2 * RUN <= len(ids):
                compare(low, low + 2 * RUN)
                low += RUN
            if end:
                compare(low, len(ids))
            else:
                ids, x = ids[low:], x[low:]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            own, data = batch.column(3).to_numpy(), batch.column(4)
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                new = _halves(data.slice(low, high - low).to_pylist())
                if last is not None and (keys[low] == last).all():
                    ids, x = np.concatenate([ids, own[low:high]]), np.concatenate([x, new])
                else:
                    if last is not None:
                        windows(True)
                    ids, x, last = own[low:high], new, keys[low]
                windows(False)
                if out.held > 50_000:
                    yield out.flush()
        if last is not None:
            windows(True)
        yield out.flush()

    coded = known.select("id", "label", "half").mapInArrow(code, "o bigint, label bigint, size bigint, code bigint, id bigint, half binary")
    order = ["o", "label", "size", "code", "id"]
    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("o", "label", "size", "id", "half").mapInArrow(pairs, _FOUND)


def _merge(lists: DataFrame, found: DataFrame, floor: float) -> DataFrame:
    """_LISTS: each node's old list with what was found, cut to its length; that of the next merge is longer if it is saturated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, 1):
            rows = batch.column(0).to_numpy()
            head = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))  # one for each node
            ids, k = rows[head], batch.column(4).take(pa.array(head)).to_numpy().astype(np.int64)
            near, sims = batch.column(2), batch.column(3)
            size = np.diff(near.offsets.to_numpy())
            owner = np.repeat(np.searchsorted(ids, rows), size)
            fresh = np.ones(len(rows), bool)
            fresh[head] = False
            fresh, near, sims = np.repeat(fresh, size), near.flatten().to_numpy(), sims.flatten().to_numpy()
            order = np.lexsort((fresh, near, owner))
            owner, near, sims, fresh = owner[order], near[order], sims[order], fresh[order]
            once = near != ids[owner]
            once[1:] &= (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
            owner, near, sims, fresh = owner[once], near[once], sims[once], fresh[once]
            order = np.lexsort((near, -sims, owner))
            owner, near, sims, fresh = owner[order], near[order], sims[order], fresh[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(ids)))[owner]
            stay = place < k[owner]
            owner, near, sims, fresh = owner[stay], near[stay], sims[stay], fresh[stay]
            n = np.bincount(owner, minlength=len(ids))
            at = np.concatenate([[0], np.cumsum(n)])
            full = n == k
            lowest = np.full(len(ids), -2.0, np.float32)
            lowest[full] = sims[at[1:][full] - 1]
            longer = np.where(full & (lowest >= floor), np.minimum(2 * k, LONGEST), k)
            least = np.where(longer > k, -2.0, lowest)
            listed = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column(1).take(pa.array(head)), listed(pa.array(near)), listed(pa.array(sims)), listed(pa.array(fresh)), pa.array(longer, pa.int32()), pa.array(least, pa.float32()), pa.array(np.bincount(owner, weights=fresh, minlength=len(ids)).astype(np.int64))],
                ["id", "half", "near", "sims", "fresh", "k", "least", "n_fresh"],
            )

    rows = lists.select("id", "half", "near", "sims", "k").unionByName(found.where("id IS NOT NULL").select("id", F.lit(None).cast("binary").alias("half"), "near", "sims", F.lit(None).cast("int").alias("k")))
    return rows.repartition("id").sortWithinPartitions("id").select("id", "half", "near", "sims", "k").mapInArrow(run, _LISTS)


def _meet(lists: DataFrame, floor: float, salt: int, work: Scratch) -> DataFrame:
    """_FOUND from the groups of nodes that have the same node in their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in whole(batches, 2):
            center, part, ids, fresh, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            halves = batch.column(5)
            new = np.flatnonzero((center[1:] != center[:-1]) | (part[1:] != part[:-1])) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
                if high - low < 2 or not fresh[low:high].any():
                    continue
                x = _halves(halves.slice(low, high - low).to_pylist())
                sims = x @ x.T
                old = ~fresh[low:high]
                sims[np.ix_(old, old)] = -2  # these have met
                np.fill_diagonal(sims, -2)
                out.add(ids[low:high], sims, least[low:high], BEST, np.triu(sims >= floor, 1))
            if out.held > 50_000:
                yield out.flush()
        yield out.flush()

    entry = F.explode(F.arrays_zip("near", "fresh")).alias("e")
    centers = lists.select(entry).groupBy(F.col("e.near").alias("center")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("e.fresh").alias("fresh")).where("fresh AND n > 1")
    centers = work.cut(centers.select("center", F.ceil(F.col("n") / PART).cast("long").alias("parts")))
    small = centers.count() <= BROADCAST
    around = lists.select("id", "half", "least", entry).select(F.col("e.near").alias("center"), "id", F.col("e.fresh").alias("fresh"), "least", "half")
    around = around.join(F.broadcast(centers) if small else centers, "center")
    around = around.select("center", F.pmod(F.xxhash64(F.lit(salt), "id"), "parts").alias("part"), "id", "fresh", "least", "half")
    return around.repartition("center", "part").sortWithinPartitions("center", "part", "id").mapInArrow(run, _FOUND)


def _descend(known: DataFrame, orders: range, floor: float, parts: int, bits: int, work: Scratch) -> DataFrame:
    """a, b: what joins all close pairs that the orders and the rounds of descent see."""
    found = work.cut(_start(known, orders, floor, parts, bits))
    seen = _joined(found)
    nothing = lambda kind: F.array().cast(f"array<{kind}>")
    lists = known.select("id", "half", nothing("bigint").alias("near"), nothing("float").alias("sims"), F.lit(LIST).alias("k"))
    for turn in range(ROUNDS):
        lists = work.cut(_merge(lists, found, floor))
        total, changed = lists.agg(F.sum(F.size("near")), F.sum("n_fresh")).first()
        if not total or changed <= CHANGED * total:
            break
        found = work.cut(_meet(lists, floor, orders.start * 100 + turn, work))
        seen = seen.unionByName(_joined(found))
    return seen


def _exact(known: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """id, links, root: of each node of a class, counts of links to copies of others, to be summed over its rows; the smallest node that it is linked with, if the class is one block; otherwise rows
    without id have pairs that join what is linked (near), one after another."""
    each = F.least(F.greatest(F.col("n") / 24, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", F.ceil(F.col("n") / each).cast("long").alias("blocks"))
    members = candidates.join(sizes, "component").withColumnsRenamed({"node": "id"}).join(known.select("id", "copies", "raw"), "id")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), (F.col("blocks") == 1).alias("alone"), "id", "copies", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        a, b, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, a, b, held
            none = np.zeros(0, np.int64)
            joined = np.stack(spanning(np.concatenate(a), np.concatenate(b)), 1).ravel() if a else none
            ids, links, root = (np.concatenate([none, *x]) for x in out)
            out, a, b, held = [[], [], []], [], [], 0
            more = pa.nulls(1, pa.int64())
            near = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(len(ids) + 1, np.int64), len(joined)), pa.int32()), pa.array(joined))
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(ids), more]), pa.concat_arrays([pa.array(links), more]), pa.concat_arrays([pa.array(root, mask=root == _NONE), more]), near], ["id", "links", "root", "near"])

        for batch in whole(batches, 3):
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            side, alone = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            every, copies, raw = batch.column(5).to_numpy(), batch.column(6).to_numpy().astype(np.float64), batch.column(7)
            for low, high in zip([0, *new.tolist()], [*new.tolist(), len(every)], strict=True):
                i, j = keys[low, 1], keys[low, 2]
                ids, own = every[low:high], copies[low:high]
                x = _unit(raw.slice(low, high - low).to_pylist(), np.float64)
                left = np.flatnonzero(~side[low:high]) if i != j else np.arange(high - low)
                right = np.flatnonzero(side[low:high]) if i != j else left
                link = x[left] @ x[right].T >= threshold
                if i == j:
                    np.fill_diagonal(link, False)
                links = np.zeros(len(ids))
                links[left] += link @ own[right]
                if i != j:
                    links[right] += link.T @ own[left]
                at, to = np.nonzero(np.triu(link) if i == j else link)
                root = np.full(len(ids), _NONE)
                tree = spanning(ids[left[at]], ids[right[to]]) if len(at) else None
                if alone[low]:
                    root = ids.copy()
                    if tree:
                        order = np.argsort(ids)
                        root[order[np.searchsorted(ids, tree[1], sorter=order)]] = tree[0]
                elif tree:
                    a.append(tree[0])
                    b.append(tree[1])
                for column, value in zip(out, (ids, links.astype(np.int64), root), strict=True):
                    column.append(value)
                held += len(ids)
            if held > 50_000:
                yield flush()
        yield flush()

    keys = ["component", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "right", "alone", "id", "copies", "raw").mapInArrow(run, "id bigint, links bigint, root bigint, near array<bigint>")


#: No node has this number.
_NONE = np.iinfo(np.int64).min


def _sample(known: DataFrame, more: int, work: Scratch) -> tuple[list, int]:
    """id, label, raw, whole (the sample is all of the label) of nodes by hash; and the number of labels. Dimensions count as labels apart."""
    sizes = known.groupBy("label", F.length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = work.cut(sizes.withColumn("wanted", F.least(F.col("n"), AUDIT * more * F.sqrt(F.greatest(F.lit(1.0), F.col("n") / USUAL)))))
    total, n_labels = sizes.agg(F.sum("wanted"), F.count(F.lit(1))).first()
    share = F.col("wanted") / F.col("n") * min(1.0, MOST_AUDITED / (total or 1))
    chance = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 30)) / (1 << 30)
    return known.withColumn("size", F.length("raw")).join(sizes, ["label", "size"]).where(chance < share).select("id", "label", "raw", (share >= 1).alias("whole")).collect(), n_labels


def _audit(known: DataFrame, candidates: DataFrame, sample: list, threshold: float) -> DataFrame:
    """id (of the sample), links and hits (those within its candidate class) by brute force in parts to be summed; missed: for each class that it should have been one with, a node of that (null in rows of counts)."""
    ids = known.sparkSession.createDataFrame([(r["id"],) for r in sample], "node bigint")
    place = {r["node"]: r["component"] for r in candidates.join(F.broadcast(ids), "node").collect()}  # of the sample, at most MOST_AUDITED
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    groups: dict[tuple[int, int], list] = {}
    for r in sample:
        groups.setdefault((r["label"], len(r["raw"])), []).append(r)
    for at, own in groups.items():
        by[at] = np.array([r["id"] for r in own]), np.array([place.get(r["id"], r["id"]) for r in own]), _unit([bytes(r["raw"]) for r in own], np.float64)
    held = known.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, places = (batch.column(i).to_numpy() for i in (0, 1, 3))
            data = batch.column(2).to_pylist()
            length = np.array([len(d) for d in data])
            out: list[list] = [[], [], [], []]
            for label, size in {*zip(labels.tolist(), length.tolist(), strict=True)} & held.value.keys():
                queries, own, x = held.value[label, size]
                here = np.flatnonzero((labels == label) & (length == size))
                link = (_unit([data[i] for i in here], np.float64) @ x.T >= threshold) & (ids[here][:, None] != queries)
                same = places[here][:, None] == own
                n, hit = link.sum(0), (link & same).sum(0)
                some = np.flatnonzero(n)
                row, column = np.nonzero(link & ~same)
                _, first = np.unique(np.stack([column, places[here[row]]], 1), axis=0, return_index=True)
                for k, (counted, missed) in enumerate(((queries[some], queries[column[first]]), (n[some], [0] * len(first)), (hit[some], [0] * len(first)), ([None] * len(some), ids[here[row[first]]]))):
                    out[k] += [*counted, *missed]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "links", "hits", "missed"])

    placed = known.select("id", "label", "raw").join(candidates.withColumnsRenamed({"node": "id"}), "id", "left")
    return placed.select("id", "label", "raw", F.coalesce("component", "id").alias("place")).mapInArrow(run, "id bigint, links bigint, hits bigint, missed bigint")


def _recall(counts: list[tuple[int, int]]) -> float:
    """Mean over nodes of the share of links hit; of nodes with very many links and of the others, the smaller."""
    share = lambda some: float(np.mean([hit / n for n, hit in some])) if some else 1.0
    return min(share([c for c in counts if c[0] > LONGEST]), share([c for c in counts if c[0] <= LONGEST]))


def _judged(sample: list, n_labels: int, counts: dict[int, tuple[int, int]]) -> tuple[set, set, float | None, float | None]:
    """Labels (with the length of a vector) whose recall is good and bad by their own sample; the recall of the others together (None: too few linked nodes to tell), 1 if there are none; and the least recall that was measured."""
    own: dict[tuple[int, int], list] = {}
    whole_ = set()
    for r in sample:
        at = r["label"], len(r["raw"])
        if r["whole"]:
            whole_.add(at)  # all links were seen, and are kept
        linked = own.setdefault(at, [])
        if r["id"] in counts:
            linked.append(counts[r["id"]])
    single = {at: _recall(c) for at, c in own.items() if at not in whole_ and len(c) >= LEAST_LINKED}
    good = whole_ | {at for at, r in single.items() if r >= RECALL}
    pool = [c for at, some in own.items() if at not in whole_ and at not in single for c in some]
    rest = n_labels > len(whole_) + len(single)
    pooled = (_recall(pool) if len(pool) >= LEAST_LINKED else None) if rest else 1.0
    measured = [r for r in ([pooled] if rest else []) + [*single.values()] if r is not None]
    return good, single.keys() - good, pooled, min(measured) if measured else None if rest else 1.0


def _audited(open_: DataFrame, candidates: DataFrame, threshold: float, work: Scratch) -> tuple[DataFrame, set, set, float | None, float | None]:
    """The audit's missed links (a, b), and what _judged says; a larger sample is taken if the first has too few linked nodes."""
    missed = None
    for more in (1, MORE):
        sample, n_labels = _sample(open_, more, work)
        truth = work.cut(_audit(open_, candidates, sample, threshold))
        own = truth.where("missed IS NOT NULL").select(F.col("id").alias("a"), F.col("missed").alias("b"))
        missed = own if missed is None else missed.unionByName(own)
        counts = {r["id"]: (r["n"], r["hit"]) for r in truth.groupBy("id").agg(F.sum("links").alias("n"), F.sum("hits").alias("hit")).where("n > 0").collect()}  # at most MOST_AUDITED
        good, bad, pooled, recall = _judged(sample, n_labels, counts)
        if pooled is not None:
            break
    return missed, good, bad, pooled, recall


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> tuple[DataFrame, list[float | None]]:
    """key, n_links, component_id, kept, one row for each row; and the least audited recall of each try (None: too few links to tell), at last 1 if what fell short was compared in full."""
    ship(rows.sparkSession)
    with Scratch(rows.sparkSession) as work:
        return _search(rows, key, vector, label, threshold, work)


def _search(rows: DataFrame, key: str, vector: str, label: str, threshold: float, work: Scratch) -> tuple[DataFrame, list[float | None]]:
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    floor = threshold - SLACK
    known, ties = nodes(rows, work, key, vector, label)
    pairs, recalls, start, open_ = None, [], 0, known
    for _ in range(TRIES):
        largest = open_.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        more = max(0, int(np.ceil(np.log2(largest / USUAL))))
        orders = range(start, start + ORDERS * (1 + more))
        start = orders.stop
        seen = _descend(open_, orders, floor, parts, min(BITS + more, 40), work)
        # the classes of earlier tries go on
        candidates = components(seen if pairs is None else seen.unionByName(pairs), work=work)
        missed, good, bad, pooled, recall = _audited(open_, candidates, threshold, work)
        recalls.append(recall)
        pairs = candidates.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)
        others = pooled is not None and pooled >= RECALL
        if not bad and others:
            open_ = None
            break
        listed = spark.createDataFrame(sorted(bad if others else good), "label bigint, size int")
        open_ = work.cut(open_.withColumn("size", F.length("raw")).join(F.broadcast(listed), ["label", "size"], "left_semi" if others else "left_anti").select(known.columns))
    candidates = components(pairs, work=work)
    if open_ is not None:
        # one class of each label
        least = open_.groupBy("label", F.length("raw").alias("size")).agg(F.min("id").alias("component"))
        of_label = work.cut(open_.select(F.col("id").alias("node"), "label", F.length("raw").alias("size")).join(least, ["label", "size"]).select("node", "component"))
        candidates = work.cut(candidates.join(of_label.select("node"), "node", "left_anti").unionByName(of_label))
        recalls.append(1.0)
    exact = work.cut(_exact(known, candidates, threshold))
    counts = exact.where("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    edges = _joined(exact)
    if ties is not None:
        edges = edges.unionByName(ties).unionByName(counts.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = components(edges, work=work).withColumnsRenamed({"node": "id"})
    of_node = known.select("id", "least", "copies", "label", "raw").join(counts, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "root", "id"))
    if ties is not None:  # a number that stands for a node isn't an id
        real = of_node.groupBy("component").agg(F.min("least").alias("real"))
        of_node = of_node.join(real, "component").withColumn("component", F.col("real"))
    of_node = of_node.where("copies > 1 OR links > 0 OR component <> id").select("label", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = _vectors(rows, key, vector, label).join(of_node, ["label", "raw"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    done = out.select(
        F.col("id").alias(key),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
    return cut(done), recalls
