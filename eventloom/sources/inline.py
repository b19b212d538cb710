"""Events and schemas given as JSON text or files, and results as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A payload that isn't text is kept as its JSON.
EVENT = "client_seq bigint, event_id string, event_timestamp bigint, event_type_major bigint, event_type_minor bigint, event_value string"


def events_from_text(spark: SparkSession, text: str) -> DataFrame:
    """EVENT rows of a JSON object, an array of them, or one a line; fields that aren't there are null, a missing minor type is 0."""
    try:
        given = json.loads(text)
    except ValueError:
        given = [json.loads(line) for line in text.splitlines() if line.strip()]
    rows = given if isinstance(given, list) else [given]
    names = [c.strip().split(" ")[0] for c in EVENT.split(",")]
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    made = [tuple(plain(r.get(n)) if n in ("event_id", "event_value") else r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(made, EVENT).withColumn("event_type_minor", F.coalesce("event_type_minor", F.lit(0).cast("long")))


def events_from_file(spark: SparkSession, path: str) -> DataFrame:
    """The same from files that Spark reads: one object a line, or (for *.json.array) one array a file."""
    reader = spark.read.schema(EVENT).option("multiLine", path.endswith(".array"))
    return reader.json(path).withColumn("event_type_minor", F.coalesce("event_type_minor", F.lit(0).cast("long")))


def as_json(rows: DataFrame) -> DataFrame:
    """One column `json`: each row as an object, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
