"""Errors of the log's commands, by fixed code."""

from __future__ import annotations

# Error codes.
UNAVAILABLE_VERSION, NOT_READABLE = 1000, 1001
EMPTY_WRITE, ZERO_EVENT_TYPE, REPLAYED, VERSION_CONFLICT, MISSING, DELETED = 2000, 2001, 2002, 2003, 2005, 2006
IN_FLIGHT, SCHEMA_EXISTS, SCHEMA_INVALID, PAYLOAD_INVALID = 2013, 2020, 2021, 2022
TRIM_MISSING, TRIM_OUT_OF_RANGE = 3000, 3004
DELETE_MISSING, DELETE_CONFLICT = 4000, 4002
UNKNOWN_AGGREGATE, LATENCY_TOO_LONG, TOO_MANY_SUBSCRIBERS, SEVERAL_SHARDS = 7001, 8001, 8005, 9001


class LogError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class UnavailableVersion(LogError):
    def __init__(self, requested: int, minimum: int):
        super().__init__(UNAVAILABLE_VERSION, f"version {requested} is below the trim floor {minimum}")
        self.requested, self.minimum = requested, minimum
