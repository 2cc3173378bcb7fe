"""What is told about a run beside its rows: counts, samples of errors, and alerts as tables."""

from __future__ import annotations

import textwrap
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sigma import Rule
from ..plans.stql import condition, parse
from ..sources.events import bad_lines, records_and_errors, with_metadata
from .search import rule_matches

#: Errors of a run that are shown.
SAMPLES = 5
#: Characters of a cell, and of a line of it.
CELL, WIDTH = 496, 62


@dataclass(frozen=True)
class Stats:
    """Counts in the order in which they are told, and (file, error) samples."""

    counts: dict
    samples: tuple = ()

    def __str__(self) -> str:
        out = "stats: " + " ".join(f"{k}={v}" for k, v in self.counts.items())
        for path, error in self.samples:
            out += f"\n  parse_error: file={path} error={' '.join(error.split())}"
        return out


def _counted(spark: SparkSession, inputs: list[tuple[str, str]], matched, source_records: bool) -> tuple[int, int, int]:
    """Records, matches and what is no record, in one scan."""
    events = with_metadata(records_and_errors(spark, inputs, source_records))
    found = F.col("raw_json").isNotNull()
    row = events.agg(
        F.count_if(found).alias("scanned"),
        F.count_if(found & matched).alias("matched"),
        F.count_if(~found).alias("bad"),
    ).first()
    return row.scanned, row.matched, row.bad


def _samples(spark: SparkSession, inputs: list[tuple[str, str]], bad: int) -> tuple:
    if not bad:
        return ()
    first = bad_lines(spark, inputs).orderBy("file_seq", "rec_seq").limit(SAMPLES).collect()
    return tuple((r.file_path, r.error) for r in first)


def search_stats(spark: SparkSession, inputs: list[tuple[str, str]], query: str, source_records: bool = False) -> Stats:
    counts = _counted(spark, inputs, condition(parse(query).filter), source_records)
    return Stats(dict(zip(("scanned", "matched", "parse_errors"), counts, strict=True)), _samples(spark, inputs, counts[2]))


def dump_stats(spark: SparkSession, inputs: list[tuple[str, str]], source_records: bool = False) -> Stats:
    dumped, _, bad = _counted(spark, inputs, F.lit(True), source_records)
    return Stats({"dumped": dumped, "parse_errors": bad, "inputs": len(inputs)}, _samples(spark, inputs, bad))


def hunt_stats(events: DataFrame, rules: list[Rule], wanted: list[bool], inputs: int, skipped: int = 0, told: DataFrame | None = None) -> Stats:
    """matched counts (event, rule) pairs of the wanted rules; told: the rows of correlate, if there are such rules."""
    numbers = [i for i, w in enumerate(wanted) if w]
    matched = rule_matches(events, rules).where(F.col("rule_index").isin(numbers)).count() if numbers else 0
    counts = {"scanned": events.count(), "matched": matched}
    if told is not None:
        counts["correlation_matched"] = told.count()
    counts["rules"] = len(numbers)
    if told is not None:
        counts["correlation_rules"] = sum(r.correlation is not None for r in rules)
    return Stats(counts | {"skipped_rules": skipped, "inputs": inputs})


def hunt_summary(stats: Stats, asked: bool = True) -> str | None:
    """One line about a hunt; where nobody asked, only a warning that rules were left out."""
    c = stats.counts
    if not asked and not c["skipped_rules"]:
        return None
    matched = c["matched"] + c.get("correlation_matched", 0)
    return ("" if asked else "warning: ") + (
        f"hunt loaded {c['rules']} rule(s), loaded {c.get('correlation_rules', 0)} correlation rule(s), "
        f"skipped {c['skipped_rules']} rule(s), discovered {c['inputs']} input(s), matched {matched} event(s)"
    )


def table(header: list[str], rows: list[list[str]]) -> str:
    """A box with a line under the header; long cells are cut, and wrapped."""
    cells = [header, *([c if len(c) <= CELL else c[:CELL] + "..." for c in map(str, r)] for r in rows)]
    wrapped = [[[x for line in c.split("\n") for x in textwrap.wrap(line, WIDTH) or [""]] for c in r] for r in cells]
    widths = [max(len(x) for r in wrapped for x in r[k]) for k in range(len(header))]

    def rule(left: str, mid: str, right: str) -> str:
        return left + mid.join("─" * (w + 2) for w in widths) + right

    out = [rule("┌", "┬", "┐")]
    for i, r in enumerate(wrapped):
        for k in range(max(map(len, r))):
            line = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, widths, strict=True)]
            out.append("│ " + " │ ".join(line) + " │")
        out.append(rule("├", "┼", "┤") if i == 0 else "")
    return "\n".join([*(x for x in out if x), rule("└", "┴", "┘")])


def alert_table(alerts: DataFrame, most: int | None = None) -> str:
    """Alerts in order of events and rules, at most so many, as one table. Alerts are brought to the driver."""
    rows = alerts.orderBy("file_seq", "rec_seq", "rule_index")
    rows = rows.limit(most) if most is not None else rows
    text = lambda v: "" if v is None else str(v)
    found = [
        [text(x) for x in (r.event.timestamp, r.rule.level, r.rule.title, r.event.computer, r.event.event_id, r.event.record_id, r.event.channel)]
        for r in rows.toLocalIterator()
    ]
    return table(["timestamp", "level", "detection", "computer", "event id", "record id", "channel"], found)
