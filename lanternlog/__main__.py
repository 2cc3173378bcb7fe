"""search, hunt and dump from the command line: python -m lanternlog search --query 'event.id == 4624' FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import report
from .operators.correlate import correlate, pretty
from .operators.search import alerts, explain, nested_summary, record_shape, rule_matches, search
from .plans.sigma import load_rules, selected
from .plans.stql import parse
from .sources.events import discover, read_events, write_errors
from .sources.sinks import dump, json_lines, pretty_records


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanternlog", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("search", "hunt", "dump"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--paths-from")
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--no-recursive", action="store_true")
        c.add_argument("--source-records", action="store_true", help="lines are flat source records")
        c.add_argument("--strict", action="store_true")
        c.add_argument("--stats", action="store_true")
        c.add_argument("--format", choices=["jsonl", "json", "csv", "pretty"], default="jsonl")
        c.add_argument("--fields", help="names with commas between them")
        if name != "hunt":
            c.add_argument("--errors", help="a file for what is no record")
        if name == "search":
            text = c.add_mutually_exclusive_group(required=True)
            text.add_argument("--query")
            text.add_argument("--query-file")
            c.add_argument("--limit", type=int)
            c.add_argument("--explain", action="store_true")
        if name == "dump":
            c.add_argument("--output", required=True)
            c.add_argument("--parts", action="store_true", help="a folder of part files")
            c.add_argument("--raw", action="store_true")
            c.add_argument("--pretty", action="store_true")
            c.add_argument("--compact", action="store_true")
        if name == "hunt":
            c.add_argument("--rules", action="append", required=True)
            c.add_argument("--quiet", action="store_true")
            c.add_argument("--summary", action="store_true")
            c.add_argument("--limit", type=int)
            c.add_argument("--min-level")
            for kind in ("status", "level", "tag", "exclude-rule"):
                c.add_argument(f"--{kind}", action="append", default=[])
            c.add_argument("--correlation-scope", choices=["file", "host", "global"], default="host")
            c.add_argument("--correlation-lateness-seconds", type=int, default=120)
            c.add_argument("--correlation-max-state", type=int, default=100_000)
            c.add_argument("--correlation-event-field", action="append", default=[])
            c.add_argument("--correlation-event-limit", type=int, default=3)
    return top


def lines(df: DataFrame) -> None:
    for row in json_lines(df).toLocalIterator():
        print(row.value)


def run_search(spark: SparkSession, a, inputs) -> None:
    if a.query_file:
        with open(a.query_file, encoding="utf-8") as f:
            a.query = f.read()
    if a.explain:
        print(explain(a.query))
        return
    fields = a.fields.split(",") if a.fields else None
    found = search(read(spark, a, inputs), a.query, fields, a.limit)
    summary = parse(a.query).summarize
    if a.format == "pretty":
        for text in pretty_records(found):
            print(text)
    else:
        lines(nested_summary(found, summary) if summary else found)
    if a.stats:
        print(report.search_stats(spark, inputs, a.query, a.source_records), file=sys.stderr)


def run_dump(spark: SparkSession, a, inputs) -> None:
    fields = a.fields.split(",") if a.fields else None
    rows = record_shape(read(spark, a, inputs).orderBy("file_seq", "rec_seq"), fields, a.raw)
    dump(rows, a.output, a.format, fields, a.raw, a.pretty, a.compact, a.parts)
    if a.stats:
        print(report.dump_stats(spark, inputs, a.source_records), file=sys.stderr)


def run_hunt(spark: SparkSession, a, inputs) -> None:
    rules, skipped = load_rules(a.rules, a.strict)
    wanted = selected(rules, tuple(a.status), tuple(a.level), tuple(a.tag), a.min_level, tuple(a.exclude_rule))
    correlated = any(r.correlation for r in rules)
    if a.quiet and not a.stats and not a.summary:
        return
    events = read(spark, a, inputs)
    matches = rule_matches(events, rules)
    told = None
    if correlated:
        told = correlate(matches, rules, a.correlation_scope, a.correlation_lateness_seconds * 1_000_000, a.correlation_max_state, a.correlation_event_field)
    if not a.quiet:
        found = alerts(matches, rules, wanted)
        if a.format == "pretty":
            print(report.alert_table(found, a.limit))
        else:
            ordered = found.orderBy("file_seq", "rec_seq", "rule_index")
            lines((ordered if a.limit is None else ordered.limit(a.limit)).select("type", "rule", "event"))
        if told is not None:
            for row in told.orderBy("time_us", "correlation_index", "scope", "groups").toLocalIterator():
                print(pretty(row, rules, a.correlation_event_field, a.correlation_event_limit))
    if a.stats or a.summary or skipped:
        stats = report.hunt_stats(events, rules, wanted, len(inputs), skipped, told)
        said = [stats] if a.stats else []
        for text in (*said, report.hunt_summary(stats, a.summary)):
            if text is not None:
                print(text, file=sys.stderr)


def read(spark: SparkSession, a, inputs) -> DataFrame:
    return read_events(spark, inputs, source_records=a.source_records, strict=a.strict)


def main(given: list[str] | None = None) -> int:
    a = options().parse_args(given)
    spark = SparkSession.builder.appName("lanternlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        inputs = discover(a.paths, a.paths_from, tuple(a.include), tuple(a.exclude), not a.no_recursive)
        {"search": run_search, "dump": run_dump, "hunt": run_hunt}[a.command](spark, a, inputs)
        if getattr(a, "errors", None):
            write_errors(spark, inputs, a.errors)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
