"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

`statistics` makes DIM transformed statistics of each whole text in one pass over its bytes. `fit` adds up
counts, sums and outer products of all labelled rows of each class (a few numbers from each task, so
nothing grows with the data), shrinks each class covariance towards the pooled one and its own diagonal,
and keeps the Cholesky factor of each with its inverse, both computed once. A score is the logistic function of the difference of the two
Gaussian log-densities (Mahalanobis terms by a product with the cached inverse factors) plus log priors.

Null texts count as empty; empty texts have statistics and a score like any other. Labels other than 0
and 1, null labels and labels of unknown documents are left out. With no labelled rows, or of one class
only, every score is the share of class 1 among them (0.5 without any). Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, ship
from eventloom.llm.hashing import LOWER, blocks, hashes, words

#: Shares of the pooled covariance and of the class's own diagonal in a class covariance, and the least variance.
TO_POOLED, TO_DIAGONAL, LEAST = 0.10, 0.10, 1e-3

_KINDS = np.zeros(256, np.int64)  # 0: any other byte
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"|/\\<>[]{}=_`~^", b"#$%&*@+", bytes(range(128, 256))), 1):
    _KINDS[list(_chars)] = _kind
KINDS = 12
DIM = 20


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each of n owners has."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return np.bincount(owner[new], minlength=n)


def matrix(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text."""
    out = np.zeros((len(column), DIM))
    for low, high, data, starts in blocks(column):
        n = high - low
        size = np.diff(starts)
        owner = np.repeat(np.arange(n) * KINDS, size)
        kinds = np.bincount(owner + _KINDS[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
        begin, end, first = words(data, starts)
        count = np.diff(first).astype(float)
        of_word = np.repeat(np.arange(n), np.diff(first))
        length = (end - begin).astype(float)
        upper = _KINDS[data[begin]] == 2
        shout = upper & (length > 1) & (_KINDS[data[np.minimum(begin + 1, max(0, len(data) - 1))]] == 2)
        closing = _KINDS[data[end - 1]] if len(end) else np.zeros(0, np.int64)
        marked = (closing >= 9) & (closing <= 10)
        alone = (length == 1) & (_KINDS[data[begin]] >= 6) & (_KINDS[data[begin]] <= 10)
        lines_end = np.flatnonzero(data == 10)
        edges = np.unique(np.concatenate([starts[:-1], lines_end + 1]))
        edges = edges[edges < len(data)]
        line_owner = np.searchsorted(starts, edges, "right") - 1
        line_end = np.append(edges[1:], len(data))
        lines = np.bincount(line_owner, minlength=n).astype(float)
        by_word = lambda x: np.bincount(of_word, weights=x, minlength=n)
        per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
        mean = by_word(length) / per_word
        share = lambda x, of: np.sqrt(x / of)
        x = out[low:high]
        x[:, 0] = np.log1p(size)
        x[:, 1] = np.log1p(mean)
        x[:, 2] = np.log1p(np.sqrt(np.maximum(0, by_word(length**2) / per_word - mean**2)))
        x[:, 3] = share(kinds[:, 1], per_byte)
        x[:, 4] = share(kinds[:, 2], per_byte)
        x[:, 5] = share(kinds[:, 3], per_byte)
        x[:, 6] = share(kinds[:, 6], per_byte)
        x[:, 7] = share(kinds[:, 7], per_byte)
        x[:, 8] = share(kinds[:, 8], per_byte)
        x[:, 9] = share(kinds[:, 9], per_byte)
        x[:, 10] = share(kinds[:, 10], per_byte)
        x[:, 11] = share(kinds[:, 11], per_byte)
        x[:, 12] = share(kinds[:, 0], per_byte)
        x[:, 13] = share(by_word(upper), per_word)
        x[:, 14] = share(by_word(shout), per_word)
        x[:, 15] = share(by_word(marked), per_word)
        x[:, 16] = share(by_word(alone), per_word)
        x[:, 17] = np.log1p(per_word / np.maximum(lines, 1))
        x[:, 18] = 1 - _distinct(line_owner, hashes(data, edges, line_end), n) / np.maximum(lines, 1)
        x[:, 19] = np.log((_distinct(of_word, hashes(LOWER[data], begin, end), n) + 1) / (count + 1)) / np.log(count + 2)
    return out


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, stats array<float>."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], [key, "stats"])

    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, stats array<float>")


def _inverse(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = -(factor[i, :i] @ out[:i])
        out[i, i] += 1
        out[i] /= factor[i, i]
    return out


@dataclass
class Discriminant:
    means: np.ndarray | None
    factors: np.ndarray | None
    log_prior: np.ndarray | None
    share: float
    inverse: np.ndarray | None = None

    def __post_init__(self):
        if self.factors is not None:
            self.inverse = np.array([_inverse(factor) for factor in self.factors])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if self.factors is None:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, inverse, prior in zip(self.means, self.factors, self.inverse, self.log_prior, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(rows: DataFrame, label: str, stats: str = "stats", to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From all rows with label 0 or 1."""
    ship(rows.sparkSession)
    width = 1 + DIM + DIM * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(float)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["label", "sums"])

    parts = rows.where(F.col(label).isin(0, 1) & F.col(stats).isNotNull()).select(F.col(label).cast("int"), stats).mapInArrow(run, "label int, sums array<double>")
    # sums of each class are added up by Spark, one number a row
    summed = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    total = np.zeros((2, width))
    for row in summed:
        total[row["label"], row["pos"]] = row["v"]
    count = total[:, 0]
    if count.min() < 2:
        return Discriminant(None, None, None, float(count[1] / count.sum()) if count.sum() else 0.5)
    means = total[:, 1 : 1 + DIM] / count[:, None]
    covariances = [(total[c, 1 + DIM :].reshape(DIM, DIM) - count[c] * np.outer(means[c], means[c])) / (count[c] - 1) for c in (0, 1)]
    pooled = sum(n * s for n, s in zip(count, covariances, strict=True)) / count.sum()
    factors = []
    for c, own in zip(count, covariances, strict=True):
        # the fewer rows a class has, the more its covariance leans on the pooled one
        lean = max(to_pooled, DIM / (DIM + c))
        mixed = (1 - lean) * own + lean * pooled
        factors.append(np.linalg.cholesky((1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(mixed)) + LEAST * np.eye(DIM)))
    return Discriminant(means, np.array(factors), np.log(count / count.sum()), float(count[1] / count.sum()))


def score(rows: DataFrame, model: Discriminant, stats: str = "stats", name: str = "score") -> DataFrame:
    """rows with the statistics replaced by a score."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != stats]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(model.scores(x), pa.float64())], [*keep, name])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])
    return rows.select(*keep, stats).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, score, predicted for each document; learns from all rows of `labels` (which the caller has restricted to training rows).

    The statistics (DIM numbers a document) are written to the shared folder once, so texts are read once.
    """
    stats = cut(statistics(docs, key=key))
    # a document with several labels counts once for each; one of several equal ids would, too
    train = stats.join(labels.select(F.col(key), F.col(label).alias("__label")).where(F.col(key).isNotNull()), key)
    model = fit(train.select("__label", "stats"), "__label")
    return score(stats, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
