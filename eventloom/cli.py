"""A command line over a stored log: python -m eventloom.cli --log PATH COMMAND ... [--json]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import schemas
from eventloom.operators import errors, listing, read
from eventloom.operators.read import ReadFilters
from eventloom.sources import inline
from eventloom.sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="eventloom", description="Reads a stored event log.")
    out.add_argument("--log", help="where the log is stored")
    out.add_argument("--json", action="store_true", help="one JSON object a row instead of a table")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("orgs")
    types = commands.add_parser("types")
    types.add_argument("--org", type=int)
    aggregates = commands.add_parser("aggregates")
    aggregates.add_argument("--org", type=int)
    aggregates.add_argument("--type", type=int)
    aggregates.add_argument("--deleted", action="store_true")
    details = commands.add_parser("details")
    details.add_argument("aggregate", type=int)
    reading = commands.add_parser("read")
    reading.add_argument("aggregate", type=int)
    reading.add_argument("--from-version", type=int, default=1)
    reading.add_argument("--to-version", type=int)
    reading.add_argument("--event-types", type=int, nargs="*", default=[])
    checking = commands.add_parser("check", help="which events satisfy a JSON Schema")
    given = checking.add_mutually_exclusive_group(required=True)
    given.add_argument("--data", help="events as JSON")
    given.add_argument("--file", help="events in files of JSON")
    checking.add_argument("--schema", required=True)
    return out


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "check":
        events = inline.events_from_text(spark, args.data) if args.data is not None else inline.events_from_file(spark, args.file)
        return events.select("client_seq", schemas.valid_json(F.col("event_value"), args.schema).alias("valid"))
    log = Store(spark, args.log).wal()
    if args.command == "orgs":
        return listing.orgs(log).orderBy("org_id")
    if args.command == "types":
        return listing.types(log, args.org).orderBy("org_id", "aggregate_type_id")
    if args.command == "aggregates":
        return listing.aggregates(log, args.deleted, args.org, args.type).orderBy("aggregate_id")
    if args.command == "details":
        return read.details(log, args.aggregate)
    filters = ReadFilters(from_version=args.from_version, to_version=args.to_version, event_types=tuple(args.event_types))
    return read.guarded(log, args.aggregate, filters)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after an error of the log, whose code goes to standard error."""
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("eventloom").getOrCreate()
    try:
        rows = answer(spark, args)
        if args.json:
            for row in inline.as_json(rows).toLocalIterator():
                print(row["json"])
        else:
            rows.show(1000, truncate=False)
    except errors.LogError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
