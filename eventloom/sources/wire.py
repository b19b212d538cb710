"""Framed messages: a header of 17 bytes, then a body that is MessagePack (version 3) or fixed-width little-endian (version 2), perhaps compressed.

Header: version, message type, length as sent, length unpacked (four bytes each, little-endian), compression (one byte). Both lengths are
checked against a bound before anything is unpacked.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.shipping import ship

HEADER = struct.Struct("<IIIIB")
# Versions, compression by number, and the most bytes of a message.
FIXED, MSGPACK = 2, 3
COMPRESSION = (None, "zstd", "snappy", "brotli", "gzip")
MOST_BYTES = 64 << 20


class BadFrame(ValueError):
    pass


def pack(value) -> bytes:
    """MessagePack of None, bool, int, float, str, bytes, lists and dicts."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack("b" if value < 0 else "B", value)
        sizes = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")) if value >= 0 else ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
        for mark, form in sizes:
            try:
                return bytes([mark]) + struct.pack(form, value)
            except struct.error:
                continue
        raise BadFrame("a number of more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return _sized(len(data), ((0xA0, 32),), (0xD9, 0xDA, 0xDB)) + data
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), (), (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, dict):
        return _sized(len(value), ((0x80, 16),), (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    return _sized(len(value), ((0x90, 16),), (None, 0xDC, 0xDD)) + b"".join(map(pack, value))


def _sized(n: int, small: Sequence[tuple[int, int]], marks: Sequence[int | None]) -> bytes:
    for mark, below in small:
        if n < below:
            return bytes([mark | n])
    for mark, form in zip(marks, (">B", ">H", ">I"), strict=True):
        if mark is not None and n < 1 << 8 * struct.calcsize(form):
            return bytes([mark]) + struct.pack(form, n)
    raise BadFrame("too long")


def unpack(data: bytes):
    """The value of all of data."""
    value, end = _unpack(data, 0, 0)
    if end != len(data):
        raise BadFrame("bytes after the message")
    return value


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise BadFrame("the message ends too early")
    return data[at : at + n], at + n


def _number(data: bytes, at: int, form: str) -> tuple[int | float, int]:
    part, at = _take(data, at, struct.calcsize(form))
    return struct.unpack(form, part)[0], at


def _unpack(data: bytes, at: int, depth: int):
    if depth > 100:
        raise BadFrame("nested too deeply")
    (mark,), at = _take(data, at, 1)
    if mark < 0x80 or mark >= 0xE0:
        return mark if mark < 0x80 else mark - 256, at
    if mark in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[mark], at
    if form := {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}.get(mark):
        return _number(data, at, form)
    lengths = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    if mark in lengths:
        n, at = _number(data, at, lengths[mark])
    elif mark < 0xC0:
        n = mark & (0x1F if mark >= 0xA0 else 0x0F)
    else:
        raise BadFrame(f"unknown mark {mark:#x}")
    if 0xA0 <= mark < 0xC0 or 0xD9 <= mark <= 0xDB:
        part, at = _take(data, at, n)
        return part.decode(), at
    if 0xC4 <= mark <= 0xC6:
        return _take(data, at, n)
    out: list = []
    for _ in range(n * (2 if mark < 0x90 or mark >= 0xDE else 1)):
        value, at = _unpack(data, at, depth + 1)
        out.append(value)
    return (dict(zip(out[::2], out[1::2], strict=True)) if mark < 0x90 or mark >= 0xDE else out), at


#: Fixed-width types by name.
_FORMS = {"u8": "<B", "u16": "<H", "u32": "<I", "u64": "<Q", "i64": "<q", "f64": "<d"}


def read_fixed(data: bytes, fields: Sequence[tuple[str, str]]) -> dict:
    """A record of (name, type): u8 u16 u32 u64 u128 i64 f64 bool str bytes, and ? (may be missing) or * (list) before one of these."""
    out, at = {}, 0
    for name, kind in fields:
        out[name], at = _fixed(data, at, kind)
    if at != len(data):
        raise BadFrame("bytes after the record")
    return out


def _fixed(data: bytes, at: int, kind: str):
    if kind[0] == "?":
        there, at = _number(data, at, "<B")
        if there > 1:
            raise BadFrame("neither there nor missing")
        return _fixed(data, at, kind[1:]) if there else (None, at)
    if kind[0] == "*":
        n, at = _number(data, at, "<Q")
        if n > len(data):
            raise BadFrame("a list longer than the message")
        out = []
        for _ in range(n):
            value, at = _fixed(data, at, kind[1:])
            out.append(value)
        return out, at
    if kind in _FORMS:
        return _number(data, at, _FORMS[kind])
    if kind == "u128":
        part, at = _take(data, at, 16)
        return int.from_bytes(part, "little"), at
    if kind == "bool":
        value, at = _number(data, at, "<B")
        return bool(value), at
    n, at = _number(data, at, "<Q")
    part, at = _take(data, at, n)
    return (part.decode() if kind == "str" else part), at


def write_fixed(record: dict, fields: Sequence[tuple[str, str]]) -> bytes:
    return b"".join(_write_fixed(record.get(name), kind) for name, kind in fields)


def _write_fixed(value, kind: str) -> bytes:
    if kind[0] == "?":
        return b"\0" if value is None else b"\1" + _write_fixed(value, kind[1:])
    if kind[0] == "*":
        return struct.pack("<Q", len(value)) + b"".join(_write_fixed(v, kind[1:]) for v in value)
    if kind in _FORMS:
        return struct.pack(_FORMS[kind], value)
    if kind == "u128":
        return value.to_bytes(16, "little")
    if kind == "bool":
        return bytes([bool(value)])
    data = value.encode() if kind == "str" else bytes(value)
    return struct.pack("<Q", len(data)) + data


def frame(body: bytes, message_type: int, version: int = MSGPACK, compression: int = 0) -> bytes:
    sent = bytes(pa.compress(body, codec=COMPRESSION[compression], asbytes=True)) if compression else body
    return HEADER.pack(version, message_type, len(sent), len(body), compression) + sent


def frames(data: bytes, most: int = MOST_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(version, message type, body) of each frame in data."""
    at = 0
    while at < len(data):
        head, at = _take(data, at, HEADER.size)
        version, kind, sent, size, compression = HEADER.unpack(head)
        if version not in (FIXED, MSGPACK):
            raise BadFrame(f"unknown version {version}")
        if compression >= len(COMPRESSION):
            raise BadFrame(f"unknown compression {compression}")
        if max(sent, size) > most:
            raise BadFrame(f"a message of {max(sent, size)} bytes")
        if not compression and sent != size:
            raise BadFrame("lengths differ without compression")
        body, at = _take(data, at, sent)
        if compression:
            body = pa.decompress(body, decompressed_size=size, codec=COMPRESSION[compression], asbytes=True)
        yield version, kind, body


def encoded(rows: DataFrame, message_type: int, compression: int = 0) -> DataFrame:
    """One column `frame`: each row as a MessagePack map of its columns (which must be numbers, texts, booleans, binaries, or lists of these)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([frame(pack(r), message_type, MSGPACK, compression) for r in batch.to_pylist()], pa.binary())], ["frame"])

    return rows.mapInArrow(run, "frame binary")


def decoded(data: DataFrame, column: str = "frame", fields: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """version, message_type, json of each frame in the column's values; bytes are given as hex, numbers over 64 bits as texts. fields: how bodies of version 2 are read. A bad frame ends the query."""
    ship(data.sparkSession)

    def plain(value):
        if isinstance(value, (bytes, bytearray)):
            return value.hex()
        if isinstance(value, dict):
            return {str(k): plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return str(value) if isinstance(value, int) and abs(value) >= 1 << 64 else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(0):
                for version, kind, body in frames(value.as_py() or b""):
                    if version == FIXED and fields is None:
                        raise BadFrame("a body of fixed width needs its fields")
                    out.append((version, kind, json.dumps(plain(unpack(body) if version == MSGPACK else read_fixed(body, fields)), separators=(",", ":"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], ["version", "message_type", "json"])

    return data.select(F.col(column).alias("frame")).mapInArrow(run, "version int, message_type bigint, json string")


def read_frames(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """decoded() of files of frames."""
    return decoded(spark.read.format("binaryFile").load(path), "content", fields)
