"""Shared plumbing: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.shared import shared_dir
from eventloom.sources.shipping import ship


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage; columns are kept.

    Parquet rather than checkpoint(): it is columnar, compressed, and read with column pruning.
    """
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator: cut() writes one, and all are deleted when the operator is done with them.

    What the operator returns must not read them: it is cut() by the function of the module, which keeps it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that none of the columns has (case doesn't tell names apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def third(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; 1 marks held-out rows."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each starts (one more for the end)."""
    column = strings(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by their first `by` columns (bigints without nulls), the rows of each key; a key may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(by)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), n]
        if held and (keys[0] != last).any():
            yield _one(held)
            held = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low and held:
                yield _one(held)
                held = []
            held.append(batch.slice(low, high - low))
        last = keys[-1]
    if held:
        yield _one(held)


def whole(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first `by` columns (bigints without nulls), cut anew so that no key spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(by)], 1)
        last = int(n - 1 - np.argmax((keys[::-1] != keys[-1]).any(1))) if (keys != keys[-1]).any() else -1
        if last >= 0:  # the last row of another key than the last
            yield _one([*held, batch.slice(0, last + 1)])
            held = []
        elif held and any(held[-1].column(i)[-1].as_py() != keys[0][i] for i in range(by)):
            yield _one(held)
            held = []
        held.append(batch.slice(last + 1))
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
