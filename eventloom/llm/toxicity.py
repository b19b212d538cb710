"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic examples P and unlabelled text U are all that is learnt from. A linear classifier over
the presence of features (words, and beginnings of words) minimises the class-prior-corrected risk

    prior * E_P[loss(+f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

with the logistic loss, in numpy; where the second term would be negative, the step goes back up on it
alone, so a flexible classifier can't drive it below zero.

No confirmed negatives are used, for the class prior neither: it is a parameter, or estimated from P and U alone. As
U holds P's kind of text with the share `prior`, no feature is rarer in U than prior times its rate in P, and those
that only positives have are just as rare; so the estimate is the least, over features, of the upper confidence bound (SURE
standard errors) of the rate in U over the rate in P.

P and U are samples of bounded size (MOST_POSITIVE, MOST_UNLABELLED: the rows whose hashed id is smallest),
and so are the features (MOST_FEATURES: those whose frequency in P exceeds that in the implied
negatives by most standard errors). All counts are summed before any feature is left out, and the sample is put in order before training, so the
model doesn't depend on how rows are partitioned. Every word of every document takes part in its score.

Null texts count as empty. An empty text has the score of the bias alone. Null labels, labels other than
1 and repeated labels of a document add nothing to P but the text once. Without a positive or without
unlabelled text, every score is 0. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, ship
from eventloom.llm.hashing import LOWER, blocks, hashes, mix, words

MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 12_000, 24_000, 4096
#: Lengths in bytes of the beginnings of words, and the least share of them in P over that in the negatives.
BEGINNINGS, LEAST_LIFT, LEAST_COUNT = (4, 5, 6, 7), 3.0, 3
STEPS, RATE, DECAY = 400, 0.1, 1e-4
#: Bounds of an estimated prior, its confidence in standard errors, and the least rate in P of a feature that it is estimated by.
LEAST_PRIOR, MOST_PRIOR, SURE, LEAST_RATE = 1e-4, 0.95, 2.5, 0.02

#: Everything in ASCII that is neither a letter nor a digit parts words.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, feature hashes, the row of each within the block); a feature may be repeated."""
    for low, high, data, starts in blocks(column):
        data = LOWER[data]
        begin, end, first = words(data, starts, APART)
        owner = np.repeat(np.arange(high - low), np.diff(first))
        found, owners = [hashes(data, begin, end)], [owner]
        for k in BEGINNINGS:
            longer = np.flatnonzero(end - begin > k)
            found.append(mix(hashes(data, begin[longer], begin[longer] + k) + np.uint64(k)))
            owners.append(owner[longer])
        yield low, high, np.concatenate(found), np.concatenate(owners)


def _once(owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


class Chosen:
    """A set of feature hashes that finds the position of each of many hashes; -1 for others."""

    def __init__(self, hashes_: np.ndarray):
        self.sorted = np.sort(hashes_.astype(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.sorted >> np.uint64(44)] = True

    def find(self, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and position, once each, of those hashes that are in the set."""
        here = np.flatnonzero(self.maybe[found >> np.uint64(44)])
        owner, found = owner[here], found[here]
        at = np.searchsorted(self.sorted, found)
        at[at == len(self.sorted)] = 0
        good = self.sorted[at] == found if len(self.sorted) else np.zeros(len(found), bool)
        return _once(owner[good], at[good])


def train(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, n_features: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias of the nnPU classifier for the sparse 0/1 matrix with ones at (rows, columns).

    positive, unlabelled: how often each row counts in P and in U (0 or 1). As steps go to and fro about the point where the risk would
    turn negative, the mean over the second half of them is taken.
    """
    n = len(positive)
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    mean_w, mean_b = np.zeros(n_features), 0.0
    of_p, of_u = positive / positive.sum(), unlabelled / unlabelled.sum()
    for step in range(1, steps + 1):
        f = b + np.bincount(rows, weights=w[columns], minlength=n)
        yes = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        loss_no = np.logaddexp(0, f)
        negative = of_u @ loss_no - prior * (of_p @ loss_no)
        down = (of_u - prior * of_p) * yes  # gradient of the negative part by f
        slope = prior * of_p * (yes - 1) + down if negative >= 0 else -down
        gradient = np.append(np.bincount(columns, weights=slope[rows], minlength=n_features) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if 2 * step > steps:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (steps - steps // 2), float(mean_b / (steps - steps // 2))


@dataclass
class Model:
    chosen: Chosen | None
    weights: np.ndarray
    bias: float
    prior: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.chosen is None:
            return out
        for low, high, found, owner in features(column):
            row, at = self.chosen.find(owner, found)
            f = self.bias + np.bincount(row, weights=self.weights[at], minlength=high - low)
            out[low:high] = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        return out


def _sample(docs: DataFrame, positives: DataFrame, key: str, may_learn: Column, most: tuple[int, int]) -> DataFrame:
    """__key, p, u: the ids of P and U; at most sum(most) rows."""
    first = lambda ids, n: ids.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct().orderBy(F.xxhash64("__key"), "__key").limit(n)
    p = first(positives, most[0]).withColumn("p", F.lit(1.0)).withColumn("u", F.lit(0.0))
    u = first(docs.where(may_learn), most[1]).withColumn("p", F.lit(0.0)).withColumn("u", F.lit(1.0))
    return p.unionByName(u).groupBy("__key").agg(F.max("p").alias("p"), F.max("u").alias("u"))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", may_learn: Column | None = None, most: tuple[int, int] = (MOST_POSITIVE, MOST_UNLABELLED), prior: float | None = None
) -> Model:
    """labels: rows to learn from, of which those with label 1 are used. may_learn: which documents may serve as unlabelled text. prior: the share of positives in it (None: estimated)."""
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession) as work:
        return _fit(docs, labels, label, key, text, F.lit(True) if may_learn is None else may_learn, most, prior, work)


def _fit(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, may_learn: Column, most: tuple[int, int], prior: float | None, work: Scratch) -> Model:
    ids = work.cut(_sample(docs, labels.where(F.col(label) == 1), key, may_learn, most))
    texts = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    sample = work.cut(texts.join(F.broadcast(ids), "__key").select("__text", "p", "u", F.xxhash64("__key").alias("k")))  # sum(most) ids at most
    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return Model(None, np.zeros(0), 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = (batch.column(i).to_numpy() for i in (1, 2))
            for low, high, found, owner in features(batch.column(0)):
                owner, found = _once(owner, found)
                one, where = np.unique(found, return_inverse=True)
                in_p, in_u = (np.bincount(where, weights=x[low:high][owner]) for x in (p, u))
                # all of them: what is rare in a block may be frequent in the sample
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(in_p), pa.array(in_u)], ["f", "p", "u"])

    rate_p, rate_u = F.col("p") / n_p, F.col("u") / n_u
    counted = work.cut(sample.select("__text", "p", "u").mapInArrow(count, "f bigint, p double, u double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST_COUNT))
    if prior is None:
        # relative variance of the ratio of the two rates; a feature that U lacks counts as one half
        u = F.greatest(F.col("u"), F.lit(0.5))
        spread = F.greatest(1 - rate_u, F.lit(0.0)) / u + F.greatest(1 - rate_p, F.lit(0.0)) / F.col("p")
        most_rate = u / n_u / rate_p * (1 + SURE * F.sqrt(spread))
        prior = counted.where(rate_p >= LEAST_RATE).agg(F.min(most_rate)).first()[0]
        prior = float(min(MOST_PRIOR, max(LEAST_PRIOR, MOST_PRIOR if prior is None else prior)))
    rate_n = F.greatest((rate_u - prior * rate_p) / (1 - prior), F.lit(0.5 / n_u))
    best = (
        counted.where(rate_p >= LEAST_LIFT * rate_n)
        .withColumn("z", (rate_p - rate_n) / F.sqrt(rate_n * (1 / n_p + 1 / n_u)))
        .orderBy(F.desc("z"), "f").limit(MOST_FEATURES)
    )
    chosen = Chosen(np.array([r["f"] for r in best.select("f").collect()], np.int64).view(np.uint64))  # MOST_FEATURES at most

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found, owner in features(batch.column(0)):
                row, at = chosen.find(owner, found)
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                own = lambda i: batch.column(i).slice(low, high - low)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at, pa.int32())), own(1), own(2), own(3)], ["at", "p", "u", "k"])

    got = sample.mapInArrow(seen, "at array<int>, p double, u double, k bigint").toArrow()  # one row of feature numbers for each of the sample
    at = got.column("at").combine_chunks()
    columns = at.flatten().to_numpy().astype(np.int64)
    sizes = np.diff(at.offsets.to_numpy()) if len(at) else np.zeros(0, int)
    rows = np.repeat(np.arange(len(at)), sizes)
    content = np.bincount(rows, weights=(columns + 1.0) ** 2, minlength=len(at))
    place = np.argsort(np.lexsort((content, got.column("k").to_numpy())))  # the same order however rows were dealt out
    order = np.lexsort((columns, place[rows]))
    p, u = (got.column(c).to_numpy()[np.argsort(place)] for c in ("p", "u"))
    w, b = train(place[rows][order], columns[order], p, u, len(chosen.sorted), prior)
    return Model(chosen, w, b, prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs (all columns) with the score, by a name that none of them has."""
    ship(docs.sparkSession)
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index(text)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(batch.column(at)), pa.float64())], [*docs_columns, name])

    docs_columns = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(run, schema)
