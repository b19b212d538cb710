"""The log as Parquet with a manifest, and JSON-lines histories.

Rows are partitioned by shard and segment and sorted by aggregate and sequence, so statistics and bloom filters prune
segments. A commit is one manifest file that must not exist yet: readers see rows up to the last manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.listing import summary
from eventloom.operators.read import visible


class CommitConflict(Exception):
    """Another writer committed this number first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        numbers = self.commits()
        if not numbers:
            return {"number": 0, "visible": {}}
        p, fs = self._fs(f"{self.path}/manifest/{numbers[-1] if number is None else number:020d}.json")
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def append(self, rows: DataFrame) -> None:
        """Writes rows; they aren't visible before commit()."""
        (
            rows.repartition("shard_id", "log_id").sortWithinPartitions("shard_id", "log_id", "aggregate_id", "wal_seq").write.mode("append").partitionBy("shard_id", "log_id")
            .option("compression", "zstd").option("parquet.bloom.filter.enabled#aggregate_id", "true").option("parquet.bloom.filter.enabled#client_id", "true").parquet(f"{self.path}/wal")
        )

    def commit(self, visible_seq: dict[int, int] | None = None) -> int:
        """Makes rows visible up to a sequence for each shard (all that is written, if None). Fails if another commit has this number."""
        if visible_seq is None:
            visible_seq = {r[0]: r[1] for r in self.written().groupBy("shard_id").agg(F.max("wal_seq")).collect()}  # one row a shard
        number = self.manifest()["number"] + 1
        p, fs = self._fs(f"{self.path}/manifest/{number:020d}.json")
        try:
            out = fs.create(p, False)
        except Exception as error:
            raise CommitConflict(str(number)) from error
        out.write(bytearray(json.dumps({"number": number, "visible": {str(k): v for k, v in visible_seq.items()}}).encode()))
        out.close()
        return number

    def written(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/wal")

    def wal(self, number: int | None = None) -> DataFrame:
        """Visible rows as of a commit (the last, if None)."""
        seen = [(int(k), int(v)) for k, v in self.manifest(number)["visible"].items()]
        return visible(self.written(), self.spark.createDataFrame(seen, "shard_id bigint, visible_seq bigint"))

    def write_summaries(self) -> None:
        """Replaces the materialised segment summaries."""
        summary(self.wal(), "shard_id", "log_id").write.mode("overwrite").parquet(f"{self.path}/summary")

    def summaries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/summary")

    def of_aggregate(self, aggregate_id: int) -> DataFrame:
        """An aggregate's visible batches and deletes, from the segments whose materialised summary has it; others aren't opened. Segments sealed after the summaries were written are read by their own statistics."""
        known = self.summaries()
        own = known.where(F.col("aggregate_id") == aggregate_id).select("shard_id", "log_id").distinct().collect()  # one row a segment
        last = known.groupBy("shard_id").agg(F.max("log_id").alias("sealed"))
        rows = self.wal().where((F.col("aggregate_id") == aggregate_id) & (F.col("kind") != "soft_trim"))
        in_summary = F.lit(False)
        for shard in {r["shard_id"] for r in own}:
            in_summary |= (F.col("shard_id") == shard) & F.col("log_id").isin(*[r["log_id"] for r in own if r["shard_id"] == shard])
        later = rows.join(F.broadcast(last), "shard_id", "left").where("sealed IS NULL OR log_id > sealed").drop("sealed")  # one row a shard
        return rows.where(in_summary).unionByName(later.select(rows.columns))

    def compact(self, out: str) -> Store:
        """A store without dead batches, under another path."""
        from eventloom.operators.compact import marked

        other = Store(self.spark, out)
        other.append(marked(self.wal()).where("keep").drop("keep"))
        other.commit()
        return other


HISTORY = "type string, process bigint, org_id string, type_id string, agg_id string, client_id string, client_seq bigint, expected_version bigint, outcome string, error bigint, acked_max_aggregate_version bigint, t_start_ns bigint, t_end_ns bigint, node bigint, probe_id bigint, observed_max_aggregate_version bigint, read_error string, connection bigint, epoch bigint, from_version bigint, to_version bigint, t_ns bigint, max_aggregate_version bigint"


def read_history(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSON lines with a `type` tag (op, ryw, watch-delivery, final-read), by a fixed schema."""
    rows = spark.read.schema(HISTORY).json(path)
    return rows if kind is None else rows.where(F.col("type") == kind)


def write_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
