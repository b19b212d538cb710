"""Connected components as Spark joins: nothing is collected, and no list of neighbours is built.

Each round every node moves to the first node, in a pseudo-random order (a new one each round), of all
that are two edges away at most; edges are rewritten between the places moved to, and loops and doubles go.
A star is one place after a round, and of a long chain at most a constant share of the nodes is left.
Before each round every task replaces the edges that it holds, CHUNK at a time, by a spanning forest of them. Edges and
places are written to the shared folder each round. Hubs are safe: the first neighbour is a minimum,
aggregated before the shuffle, and the joins are sort-merge joins that AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, cut, ship

#: Edges of a task that are replaced by a spanning forest at a time.
CHUNK = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges as stars: the least node of each tree, and another node of it."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    others = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[others]], ids[others]


def forest(edges: DataFrame) -> DataFrame:
    """a, b: edges (bigints, no nulls) that join what those of each task join, at most one for each node and chunk."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a, b = spanning(*(np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b", work: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node of its component) for each node of the edges; nulls and loops are left out.

    The result is a table in the shared folder: one of `work`, or one that stays.
    """
    rounds = Scratch(edges.sparkSession)
    with rounds:
        given = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        edges = rounds.cut(forest(given).distinct())
        places = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("place", F.col("node"))
        turn = 0
        while not edges.isEmpty():
            turn += 1
            rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), c.alias("node"))
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # written, so that the join reads two plain shuffles, which AQE can split at a hub
            first = rounds.cut(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best")).select(F.col("a").alias("b"), F.least("best", rank(F.col("a"))).alias("best")))
            moves = rounds.cut(both.join(first, "b").groupBy("a").agg(F.min("best")["node"].alias("to")))
            of_a, of_b = moves.withColumnsRenamed({"to": "to_a"}), moves.withColumnsRenamed({"a": "b", "to": "to_b"})
            moved = edges.join(of_a, "a").join(of_b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
            edges = rounds.cut(forest(moved))
            places = rounds.cut(places.join(moves.withColumnsRenamed({"a": "place"}), "place", "left").select("node", F.coalesce("to", "place").alias("place")))
        least = places.groupBy("place").agg(F.min("node").alias("component"))
        done = places.join(least, "place").select("node", "component")
        return work.cut(done) if work else cut(done)
