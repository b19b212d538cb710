"""Column functions of the log: routing, codes, identities, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of watch operations, and errors by outcome.
OPERATIONS = {"delete": 0, "write": 1, "read": 2, "trim": 3, "details": 4, "create": 5}
DEFINITE_FAILURES = (2000, 2001, 2002, 2003, 2005, 2006, 2020, 2021, 2022, 3000, 3004, 4000, 4002, 9001)


def shard_of(key: Column, shards: int, coordinator: bool = False) -> Column:
    """The shard of a routing id; with a coordinator, shard 0 takes none."""
    if shards <= 1:
        return F.lit(0).cast("long")
    return F.pmod(key, F.lit(shards - 1)) + 1 if coordinator and shards > 1 else F.pmod(key, F.lit(shards))


def shard_of_hex(key: Column, shards: int) -> Column:
    """The same for a 128-bit id in hex: remainders of its four 32-bit parts, put together without wider numbers."""
    out = F.lit(0).cast("long")
    for part in range(4):
        word = F.conv(F.substring(F.lpad(key, 32, "0"), 1 + 8 * part, 8), 16, 10).cast("long")
        out = F.pmod(out * ((1 << 32) % shards) + word, F.lit(shards))
    return out


def hex_id(value: Column) -> Column:
    """Canonical form of a 128-bit id: 32 lower-case hex digits from hex with or without hyphens, or from a decimal number up to 64 bits."""
    plain = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain).when(value.rlike("^[0-9]{1,19}$"), F.lower(F.lpad(F.conv(value, 10, 16), 32, "0")))


def operation_code(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in OPERATIONS.items()]).cast("int")


def outcome(code: Column) -> Column:
    """ok without a code, fail for those that surely had no effect, else info."""
    return F.when(code.isNull() | (code == 0), "ok").when(code.isin(*DEFINITE_FAILURES), "fail").otherwise("info")


def client_identity(secret: Column) -> Column:
    """128 bits of SHA-256, byte order reversed, as hex."""
    digest = F.sha2(secret.cast("string"), 256)
    return F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(15, -1, -1)])


def payload(aggregate_id: Column, seq: Column) -> Column:
    return F.format_string("[t-%d-s-%d]", aggregate_id, seq)


def batch_path(path: Column) -> tuple[Column, Column, Column]:
    """shard, first and last sequence of an object's path shard_N/batch_first_last_id.bin; null where it has another form."""
    pattern = r"^shard_([0-9]+)/batch_([0-9]+)_([0-9]+)_[^/]+\.bin$"
    return tuple(F.regexp_extract(path, pattern, i).try_cast("long") for i in (1, 2, 3))


def normalised(line: Column) -> Column:
    return F.regexp_replace(line, "[0-9]+", "#")


def signed(event_type: Column, amount: Column, signs: dict[int, int]) -> Column:
    """What an event adds to a balance; unknown types and null amounts nothing."""
    out = F.coalesce(*[F.when(event_type == k, amount * v) for k, v in signs.items()], F.lit(0))
    return F.coalesce(out, F.lit(0)).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """The deterministic id of a name: version 5 of the namespace (hex with or without hyphens)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name.cast("string"), "utf-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + F.lit(1), F.lit(1))
    part = lambda low, n: F.substring(digest, low, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def hyphened(hex_id: Column) -> Column:
    """32 hex digits as the text of a UUID."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex_id, low, n) for low, n in cuts])


def since_epoch(time: Column, precision: str = "ms", offset_seconds: int = 0) -> Column:
    """Whole ms, us or ns of a timestamp since an epoch that is offset_seconds after 1970."""
    micros = F.unix_micros(time.cast("timestamp")) - offset_seconds * 1_000_000
    return F.floor(micros / 1000).cast("long") if precision == "ms" else micros if precision == "us" else micros * 1000
