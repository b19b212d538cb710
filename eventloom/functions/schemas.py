"""Schema registry and payload validation for JSON, protobuf-like and Avro-like records.

JSON Schema: type, properties, required, enum, minimum and maximum of flat objects, compiled to Spark
expressions. Keys without a registered schema are stored unvalidated; encrypted payloads (with an iv) too.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import errors

LONGEST, MOST_SCHEMAS = 16_384, 500
_KEY = ("org_id", "aggregate_type_id", "event_type_major", "event_type_minor")


def check(schema: str) -> dict:
    """The schema as a dict; raises for what isn't one."""
    try:
        out = json.loads(schema)
    except ValueError:
        out = None
    if len(schema) > LONGEST or not isinstance(out, dict) or out.get("type", "object") != "object" or not isinstance(out.get("properties", {}), dict):
        raise errors.LogError(errors.SCHEMA_INVALID, "not a supported schema")
    return out


def valid_json(payload: Column, schema: str) -> Column:
    """Whether a JSON text satisfies the schema; null and malformed texts don't."""
    spec = check(schema)
    value = F.try_parse_json(payload)
    tests = [value.isNotNull() & F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))]
    required = set(spec.get("required", ()))
    # JSON types and the variant types that satisfy them.
    kinds = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
    for name in sorted(required | set(spec.get("properties", {}))):
        rule = spec.get("properties", {}).get(name, {})
        part = F.try_variant_get(value, f"$['{name}']", "variant")
        own = []
        if "type" in rule:
            own.append(reduce(lambda a, b: a | b, [F.startswith(F.schema_of_variant(part), F.lit(k)) for k in kinds[rule["type"]]]))
        for key, compare in (("minimum", lambda c, v: c >= v), ("maximum", lambda c, v: c <= v)):
            if key in rule:
                own.append(F.coalesce(compare(F.try_variant_get(part, "$", "double"), rule[key]), F.lit(False)))
        if "enum" in rule:
            own.append(F.coalesce(F.try_variant_get(part, "$", "string").isin(*map(str, rule["enum"])), F.lit(False)))
        good = reduce(lambda a, b: a & b, own, F.lit(True))
        tests.append(F.when(part.isNull(), F.lit(name not in required)).otherwise(good))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New schemas with the code of each: 2020 for a key that is there or came before, else 0. The first of each key is a minimum, aggregated before it is shuffled."""
    first = new.groupBy(*_KEY).agg(F.min("wal_seq").alias("__first"))
    known = registry.select(*_KEY).distinct().withColumn("__known", F.lit(True))
    taken = first.join(known, list(_KEY), "left")
    return new.join(taken, list(_KEY)).withColumn("code", F.when(F.col("__known") | (F.col("wal_seq") > F.col("__first")), errors.SCHEMA_EXISTS).otherwise(0)).drop("__known", "__first")


def lookup(events: DataFrame, registry: DataFrame) -> DataFrame:
    """events with the schema of their key, null where there is none. Registries are small; Spark broadcasts by size."""
    return events.join(registry.select(*_KEY, "schema"), list(_KEY), "left")


def validate(events: DataFrame, schemas: dict[tuple[int, int, int, int], str], payload: str = "props") -> DataFrame:
    """events with `valid`: by the schema of their key, true where there is none."""
    out = F.lit(True)
    for key, schema in schemas.items():
        same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(_KEY, key, strict=True)])
        out = F.when(same, valid_json(F.col(payload), schema)).otherwise(out)
    return events.withColumn("valid", out)


def validate_all(events: DataFrame, registry: DataFrame, payload: str = "props") -> DataFrame:
    """events with `valid` by the registered schema of their key, true where there is none.

    The registry is joined; each distinct text of a schema becomes one compiled expression, so a registry of many keys with few schemas costs no more than these.
    """
    texts = [r["schema"] for r in registry.select("schema").where("schema IS NOT NULL").distinct().orderBy("schema").limit(MOST_SCHEMAS + 1).collect()]
    if len(texts) > MOST_SCHEMAS:
        raise ValueError(f"more than {MOST_SCHEMAS} different schemas at once")
    out = F.lit(True)
    for text in texts:
        out = F.when(F.col("__schema") == text, valid_json(F.col(payload), text)).otherwise(out)
    found = events.join(registry.select(*_KEY, F.col("schema").alias("__schema")), list(_KEY), "left")
    return found.withColumn("valid", F.when(F.col("__schema").isNull(), F.lit(True)).otherwise(out)).drop("__schema")
