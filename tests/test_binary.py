"""Avro and protobuf payloads."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from eventloom.functions.binary import Avro, Protobuf, valid_avro, valid_protobuf
from eventloom.operators.errors import LogError

RECORD = json.dumps({"type": "record", "name": "R", "fields": [
    {"name": "a", "type": "string"}, {"name": "b", "type": ["null", "int"]}, {"name": "c", "type": {"type": "array", "items": "long"}},
    {"name": "d", "type": {"type": "enum", "name": "E", "symbols": ["x", "y"]}}, {"name": "e", "type": {"type": "map", "values": "double"}}, {"name": "f", "type": "boolean"},
]})
GOOD = b"\x04hi" + b"\x02\x54" + b"\x04\x02\x03\x00" + b"\x02" + b"\x02\x02k" + struct.pack("<d", 1.5) + b"\x00" + b"\x01"


@pytest.mark.parametrize("data, good", [(GOOD, True), (GOOD[:-1], False), (GOOD + b"\x00", False), (b"", False), (None, False), (GOOD[:-1] + b"\x02", False), (b"\x04\xff\xff" + GOOD[3:], False), (b"\xff" * 12, False)])
def test_avro(data, good):
    assert Avro(RECORD).valid(data) is good


MESSAGE = "syntax = 'proto3'; message P { string name = 1; int32 id = 2; repeated int64 more = 3; // note\n}"


@pytest.mark.parametrize("data, good", [(b"\x0a\x02hi\x10\x2a", True), (b"", True), (b"\x0a\x09hi", False), (b"\x08\x2a", False), (b"\x0a\x02\xff\xff", False), (b"\x1a\x02\x01\x02\x18\x05", True), (b"\x98\x06\x01", True), (b"\x00", False), (None, False)])
def test_protobuf(data, good):
    assert Protobuf(MESSAGE).valid(data) is good


def test_bad_definitions():
    for make, schema in ((Avro, "x"), (Avro, '{"type": "record", "name": "R", "fields": [{"name": "a", "type": "Missing"}]}'), (Protobuf, "message P { Other o = 1; }"), (Protobuf, "x")):
        with pytest.raises(LogError, match="2021"):
            make(schema)


def test_columns(spark):
    rows = spark.createDataFrame([(bytearray(GOOD), bytearray(b"\x10\x2a")), (bytearray(b"x"), bytearray(b"\x0a"))], "a binary, p binary")
    got = rows.select(valid_avro(F.col("a"), RECORD), valid_protobuf(F.col("p"), MESSAGE)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]
