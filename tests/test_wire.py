"""Frames, MessagePack and fixed-width bodies."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.sources import wire

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=40), lambda v: st.lists(v, max_size=20) | st.dictionaries(st.text(max_size=5), v, max_size=18), max_leaves=30)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_messagepack_round_trip(value):
    assert wire.unpack(wire.pack(value)) == value


def test_known_messagepack():
    # as the format's description has them
    assert wire.pack({"compact": True, "schema": 0}) == b"\x82\xa7compact\xc3\xa6schema\x00"
    assert wire.pack([1, -1, 300, "x" * 40]) == b"\x94\x01\xff\xcd\x01\x2c\xd9\x28" + b"x" * 40
    for bad in (b"", b"\xa5abc", b"\xc1", b"\x01\x02", b"\x91"):
        with pytest.raises(wire.BadFrame):
            wire.unpack(bad)


FIELDS = (("client_seq", "u64"), ("id", "?u128"), ("types", "*u64"), ("value", "bytes"), ("name", "str"), ("good", "bool"), ("x", "f64"), ("n", "i64"))


def test_fixed_width():
    record = {"client_seq": 7, "id": 2**100, "types": [1, 2], "value": b"\x00\xff", "name": "é", "good": True, "x": 1.5, "n": -3}
    data = wire.write_fixed(record, FIELDS)
    assert wire.read_fixed(data, FIELDS) == record and data[:9] == struct.pack("<QB", 7, 1)
    assert wire.read_fixed(wire.write_fixed(record | {"id": None}, FIELDS), FIELDS)["id"] is None
    for bad in (data[:-1], data + b"x"):
        with pytest.raises(wire.BadFrame):
            wire.read_fixed(bad, FIELDS)


@pytest.mark.parametrize("compression", range(5))
def test_frames(compression):
    body = wire.pack({"a": list(range(50)), "b": "text" * 20})
    data = wire.frame(body, 4, compression=compression) + wire.frame(body, 5, version=2, compression=compression)
    assert list(wire.frames(data)) == [(3, 4, body), (2, 5, body)]


def test_bad_frames():
    good = wire.frame(b"abc", 1)
    for bad in (good[:-1], good[:10], wire.HEADER.pack(1, 1, 0, 0, 0), wire.HEADER.pack(3, 1, 0, 0, 9), wire.HEADER.pack(3, 1, 2, 3, 0) + b"abc", wire.HEADER.pack(3, 1, 1 << 30, 1 << 30, 1)):
        with pytest.raises(wire.BadFrame):
            list(wire.frames(bad))


def test_frame_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1, 2], bytearray(b"\x01")), (2, None, [], None)], "id bigint, name string, n array<bigint>, raw binary")
    made = wire.encoded(rows, 9, compression=1)
    assert [(r["version"], r["message_type"], r["json"]) for r in wire.decoded(made).orderBy("json").collect()] == [(3, 9, '{"id":1,"name":"a","n":[1,2],"raw":"01"}'), (3, 9, '{"id":2,"name":null,"n":[],"raw":null}')]
    (tmp_path / "f.bin").write_bytes(wire.frame(wire.write_fixed({"a": 2**70, "b": "x"}, (("a", "u128"), ("b", "str"))), 3, version=2) * 2)
    assert [r["json"] for r in wire.read_frames(spark, str(tmp_path), (("a", "u128"), ("b", "str"))).collect()] == ['{"a":"1180591620717411303424","b":"x"}'] * 2
