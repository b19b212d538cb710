"""Validation of binary payloads: Avro data by a record schema, protobuf messages by a message definition.

Both are pure Python inside Arrow-batched functions, as Spark's own readers of these formats need packages that
aren't part of it. A payload is valid if it decodes by the schema; an Avro datum must also end where its bytes do.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import errors
from eventloom.sources.shipping import ship

MOST_DEPTH = 64


class Malformed(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned number of up to ten bytes, and where it ends."""
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return out, at
        shift += 7


def _skip(data: bytes, at: int, size: int) -> int:
    if size < 0 or at + size > len(data):
        raise Malformed
    return at + size


class Avro:
    """A reader of one schema: records, enums, arrays, maps, fixed, unions and the primitive types."""

    def __init__(self, schema: str):
        self.named: dict[str, object] = {}
        try:
            self.schema = json.loads(schema)
            self._learn(self.schema)
        except (ValueError, KeyError, TypeError) as error:
            raise errors.LogError(errors.SCHEMA_INVALID, "not an Avro schema") from error

    _PRIMITIVE = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")

    def _learn(self, schema: object) -> None:
        if isinstance(schema, list):
            for branch in schema:
                self._learn(branch)
        elif isinstance(schema, str):
            if schema not in self._PRIMITIVE and schema not in self.named:
                raise KeyError(schema)
        else:
            kind = schema["type"]
            if kind in ("record", "enum", "fixed"):
                self.named[schema["name"]] = schema
            if kind == "record":
                for one in schema["fields"]:
                    self._learn(one["type"])
            elif kind in ("array", "map"):
                self._learn(schema["items" if kind == "array" else "values"])
            elif kind not in ("enum", "fixed"):
                self._learn(kind)

    @staticmethod
    def _long(data: bytes, at: int) -> tuple[int, int]:
        raw, at = varint(data, at)
        return (raw >> 1) ^ -(raw & 1), at

    def read(self, data: bytes, at: int = 0, schema: object = None, depth: int = 0) -> int:
        """Where the datum that begins at `at` ends."""
        schema = self.schema if schema is None else schema
        if depth > MOST_DEPTH:
            raise Malformed
        if isinstance(schema, list):
            branch, at = self._long(data, at)
            if not 0 <= branch < len(schema):
                raise Malformed
            return self.read(data, at, schema[branch], depth + 1)
        kind = schema if isinstance(schema, str) else schema["type"]
        if isinstance(kind, (dict, list)):
            return self.read(data, at, kind, depth + 1)
        if kind == "null":
            return at
        if kind == "boolean":
            end = _skip(data, at, 1)
            if data[at] > 1:
                raise Malformed
            return end
        if kind in ("int", "long"):
            value, at = self._long(data, at)
            if kind == "int" and not -(1 << 31) <= value < 1 << 31:
                raise Malformed
            return at
        if kind in ("float", "double"):
            return _skip(data, at, 4 if kind == "float" else 8)
        if kind in ("bytes", "string"):
            size, at = self._long(data, at)
            end = _skip(data, at, size)
            if kind == "string":
                data[at:end].decode()
            return end
        if kind == "fixed":
            return _skip(data, at, schema["size"])
        if kind == "enum":
            index, at = self._long(data, at)
            if not 0 <= index < len(schema["symbols"]):
                raise Malformed
            return at
        if kind == "record":
            for one in schema["fields"]:
                at = self.read(data, at, one["type"], depth + 1)
            return at
        if kind in ("array", "map"):
            while True:
                count, at = self._long(data, at)
                if count == 0:
                    return at
                if count < 0:
                    count = -count
                    _, at = self._long(data, at)
                if count > len(data):
                    raise Malformed
                for _ in range(count):
                    if kind == "map":
                        at = self.read(data, at, "string", depth + 1)
                    at = self.read(data, at, schema["items" if kind == "array" else "values"], depth + 1)
        return self.read(data, at, self.named[kind], depth + 1)

    def valid(self, data: bytes | None) -> bool:
        try:
            return data is not None and self.read(bytes(data)) == len(data)
        except (Malformed, UnicodeDecodeError):
            return False


# Scalar types by wire type.
WIRE = {0: "int32 int64 uint32 uint64 sint32 sint64 bool", 1: "fixed64 sfixed64 double", 2: "string bytes", 5: "fixed32 sfixed32 float"}


class Protobuf:
    """A reader of one flat message definition; unknown fields pass, known ones need their wire type."""

    _FIELD = re.compile(r"^\s*(optional|required|repeated)?\s*(\w+)\s+(\w+)\s*=\s*(\d+)\s*(\[[^\]]*\])?\s*$")

    def __init__(self, schema: str):
        body = re.search(r"message\s+\w+\s*\{([^{}]*)\}", re.sub(r"//[^\n]*", "", schema))
        wire = {name: number for number, names in WIRE.items() for name in names.split()}
        self.fields: dict[int, tuple[int, str, bool]] = {}
        for line in body[1].split(";") if body else ["bad"]:
            if line.strip():
                match = self._FIELD.match(line)
                if not match or match[2] not in wire:
                    raise errors.LogError(errors.SCHEMA_INVALID, "not a flat message definition")
                self.fields[int(match[4])] = wire[match[2]], match[2], match[1] == "repeated"

    def valid(self, data: bytes | None) -> bool:
        if data is None:
            return False
        data, at = bytes(data), 0
        try:
            while at < len(data):
                tag, at = varint(data, at)
                number, kind = tag >> 3, tag & 7
                want, name, repeated = self.fields.get(number, (kind, "", False))
                if number == 0 or kind != want and not (repeated and kind == 2 and want != 2):
                    return False
                if kind == 0:
                    _, at = varint(data, at)
                elif kind in (1, 5):
                    at = _skip(data, at, 8 if kind == 1 else 4)
                elif kind == 2:
                    size, at = varint(data, at)
                    end = _skip(data, at, size)
                    if name == "string":
                        data[at:end].decode()
                    at = end
                else:
                    return False
            return True
        except (Malformed, UnicodeDecodeError):
            return False


def _udf(reader: Avro | Protobuf):
    ship(SparkSession.active())

    @F.pandas_udf("boolean")
    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(reader.valid).astype(bool)

    return run


def valid_avro(payload: Column, schema: str) -> Column:
    return _udf(Avro(schema))(payload)


def valid_protobuf(payload: Column, schema: str) -> Column:
    return _udf(Protobuf(schema))(payload)
