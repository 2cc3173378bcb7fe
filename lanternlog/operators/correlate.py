"""Correlation of rule matches in event time: counts, distinct counts, sets and sequences over windows.

The only step that depends on the order of all matches is the watermark, the greatest time so far less the allowed
lateness; it comes from running maxima inside stretches of a file and over the stretches' own maxima. After that every
state key is folded by itself, many of them in a task. Keys evict each other only where more of them than max_state could be
alive at once, which counts of keys by time tell; then one ordered fold goes through all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import Field, instant, taken_out, with_taken
from ..plans.sigma import COUNT_OPS, Rule, field_path

LATENESS_US = 120_000_000
MAX_STATE = 100_000
#: Matches that are folded in one task, about, and the fewest tasks.
LANE_ROWS, LANES = 50_000, 16
#: Records of a file, in a power of two, whose running maximum is taken in one go.
STRETCH = 18
ENTRY = "struct<file_path: string, file_seq: int, rec_seq: long, rule_index: int, time_us: long, fields: array<string>>"
OUT = (
    "correlation_index int, scope string, groups array<string>, time_us long, window_start_us long, window_end_us long, "
    f"seqs array<long>, entries array<{ENTRY}>"
)
OUT_NAMES = ["correlation_index", "scope", "groups", "time_us", "window_start_us", "window_end_us", "seqs", "entries"]


def reference(rules: list[Rule], name: str) -> int | None:
    """The first base rule with this name, id or title."""
    return next(
        (i for i, r in enumerate(rules) if r.correlation is None and name in (r.name, r.id, r.title)), None
    )


class Fold:
    """The state of one correlation rule's key: entries in order of time, and whether it has told already."""

    def __init__(self, kind: str, op: str | None, count: int, needed: int, span: int):
        self.kind, self.op, self.count, self.needed, self.span = kind, op, count, needed, span
        self.entries: list[tuple] = []  # (time, position of the reference, value, what is told of it)
        self.seen: Counter = Counter()  # entries by value, or by position
        self.told = False

    def mark(self, entry: tuple):
        return entry[2] if self.kind == "value_count" else entry[1]

    def evict(self, watermark: int) -> None:
        keep = 0
        for e in self.entries:
            if e[0] >= watermark - self.span:
                break
            keep += 1
            self.seen[self.mark(e)] -= 1
            if not self.seen[self.mark(e)]:
                del self.seen[self.mark(e)]
        if keep:
            del self.entries[:keep]
            if not self.entries:
                self.told = False

    def holds(self) -> bool:
        if self.kind == "event_count":
            return COUNT_OPS[self.op](len(self.entries), self.count)
        if self.kind == "value_count":
            return COUNT_OPS[self.op](len(self.seen), self.count)
        if self.kind == "temporal" or len(self.seen) < self.needed:
            return len(self.seen) == self.needed
        step = 0
        for e in self.entries:
            step += e[1] == step
            if step == self.needed:
                return True
        return False

    def observe(self, entry: tuple, watermark: int) -> bool:
        """True if the condition becomes true with this match."""
        self.evict(watermark)
        at = len(self.entries)
        while at and self.entries[at - 1][0] > entry[0]:  # behind those of the same time
            at -= 1
        self.entries.insert(at, entry)
        self.seen[self.mark(entry)] += 1
        now = self.holds()
        told, self.told = self.told, now
        return now and not told


def feed(matches: DataFrame, rules: list[Rule], lateness_us: int = LATENESS_US) -> DataFrame:
    """Matches of referenced rules with a time that are not late, with seq, time_us and watermark."""
    used = sorted(
        {i for r in rules if r.correlation for n in r.correlation.rules if (i := reference(rules, n)) is not None}
    )
    timed = matches.where(F.col("rule_index").isin(used)).withColumn("time_us", F.unix_micros(instant(F.col("timestamp"))))
    timed = timed.where("time_us is not null")
    timed = timed.withColumn("stretch", F.shiftright("rec_seq", STRETCH))
    place = ["file_seq", "stretch"]
    order = Window.partitionBy(*place).orderBy("rec_seq", "rule_index")
    tops = timed.groupBy(*place).agg(F.max("time_us").alias("top"))
    # One row for each stretch of records goes through this window.
    ahead = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*place, F.max("top").over(ahead).alias("top_ahead"))
    inside = F.max("time_us").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = timed.withColumn("inside", inside).join(tops, place)
    mark = F.greatest("inside", F.coalesce("top_ahead", "inside")) - F.lit(lateness_us)
    return marked.withColumn("watermark", mark).where("time_us >= watermark").drop("inside", "top_ahead", "stretch")


def _key(rules: list[Rule], index: int, scope: str) -> Column:
    """What one correlation makes of a match: its key, the rule's position, and the value; null if it takes no part."""
    c = rules[index].correlation
    refs = [reference(rules, n) for n in c.rules]
    if any(r is None for r in refs):
        raise ValueError(f"{rules[index].title}: unknown rule among {c.rules}")
    position = F.coalesce(*(F.when(F.col("rule_index") == r, F.lit(k)) for k, r in enumerate(refs)))
    scopes = {"file": F.col("file_path"), "host": F.coalesce("computer", F.lit("")), "global": F.lit("")}
    keys = [Field(field_path(g)).text for g in c.group_by]
    values = [Field(field_path(n)).text for n in c.fields] if c.kind == "value_count" else []
    complete = F.col("rule_index").isin(refs)
    for part in (*keys, *values):
        complete &= part.isNotNull()
    found = F.struct(
        F.lit(index).alias("correlation_index"),
        scopes[scope].alias("scope"),
        F.array(*keys).cast("array<string>").alias("groups"),
        position.alias("position"),
        F.array(*values).cast("array<string>").alias("value"),
    )
    return F.when(complete, found)


def keyed(matches: DataFrame, rules: list[Rule], scope: str, event_fields: list[str] | None, *more: str) -> DataFrame:
    """A row for each match (with time_us) and correlation that it takes part in, in one pass; more columns stay."""
    if scope not in ("file", "host", "global"):
        raise ValueError(f"scope {scope}")
    kept = ["file_path", "file_seq", "rec_seq", "rule_index", "time_us", *more]
    with taken_out() as columns:
        found = F.array(*(_key(rules, i, scope) for i, r in enumerate(rules) if r.correlation))
        fields = F.array(*(Field(n).text for n in event_fields or [])).cast("array<string>").alias("fields")
    taking = F.explode(F.filter(found, lambda k: k.isNotNull())).alias("key")
    return with_taken(matches, columns).select(*kept, fields, taking).select("key.*", "fields", *kept)


def fold_plans(rules: list[Rule]) -> dict[int, tuple]:
    """What a Fold is made with, by correlation."""
    return {
        i: (c.kind, c.op, c.count, len(c.rules), c.timespan_us)
        for i, r in enumerate(rules)
        if (c := r.correlation) is not None
    }


def _measured(rows: DataFrame, key: list[str], reach_us: int) -> tuple[int, int]:
    """An upper bound of the keys that are alive at once, and the number of rows.

    Live keys have a match within reach_us before the greatest time so far, so in two neighbouring stretches of time of
    that length; the keys of these are counted.
    """
    stretch = F.floor(F.col("time_us") / reach_us)
    keys = rows.groupBy(*key, stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("rows"))
    own = keys.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    here = F.struct(F.col("stretch").alias("stretch"), F.col("rows").alias("rows"))
    after = F.struct((F.col("stretch") + 1).alias("stretch"), F.lit(0).cast("long").alias("rows"))
    both = own.select(F.explode(F.array(here, after)).alias("at"), "n")
    sums = both.groupBy("at.stretch").agg(F.sum("n").alias("n"), F.sum("at.rows").alias("rows"))
    most, total = sums.agg(F.max("n"), F.sum("rows")).first()
    return most or 0, total or 0


def correlate(
    matches: DataFrame,
    rules: list[Rule],
    scope: str = "host",
    lateness_us: int = LATENESS_US,
    max_state: int = MAX_STATE,
    event_fields: list[str] | None = None,
) -> DataFrame:
    """A row whenever a correlation's condition becomes true for its key.

    Windows reach back the timespan from the watermark. entries are all matches in the window, in order of time, with
    the texts of event_fields; seqs are their record numbers. scope: file, host or global. With max_state (0: without
    limit), the key whose latest match is oldest goes whenever more keys than that are alive.
    """
    plans = fold_plans(rules)
    if not plans:
        return matches.sparkSession.createDataFrame([], OUT)
    rows = keyed(feed(matches, rules, lateness_us), rules, scope, event_fields, "watermark")
    key = ["correlation_index", "scope", "groups"]
    reach = max(p[-1] for p in plans.values()) + lateness_us + 1
    most, total = _measured(rows, key, reach)
    alone = bool(max_state) and most > max_state
    # Without mutual eviction keys don't depend on each other; many small ones share a task.
    lane = F.lit(0) if alone else F.pmod(F.xxhash64(*key), F.lit(max(LANES, -(-total // LANE_ROWS))))
    grouped = rows.withColumn("lane", lane).groupBy("lane")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_folded(pdf, plans, max_state if alone else 0)), columns=OUT_NAMES)

    return grouped.applyInPandas(fold, OUT)


def entry(r) -> tuple:
    told = (r.file_path, r.file_seq, r.rec_seq, r.rule_index, r.time_us, list(r.fields))
    return r.time_us, r.position, tuple(r.value), told


def telling(key: tuple, time_us: int, f: Fold) -> tuple:
    """The row that is told, with all that is in the window."""
    entries = [e[3] for e in f.entries]
    return *key[:2], list(key[2]), time_us, f.entries[0][0], f.entries[-1][0], [e[2] for e in entries], entries


def _folded(pdf: pd.DataFrame, plans: dict, max_state: int) -> Iterator[tuple]:
    pdf = pdf.sort_values(["file_seq", "rec_seq", "rule_index", "correlation_index"], kind="stable")
    state: dict[tuple, Fold] = {}
    ends: list[tuple] = []  # (when the key's latest entry leaves the window, key), put right when it is met
    ages: list[tuple] = []  # (time of the key's latest entry, key), likewise
    for r in pdf.itertuples(index=False):
        key = (r.correlation_index, r.scope, tuple(r.groups))
        while max_state and ends and ends[0][0] < r.watermark:
            _, k = heappop(ends)
            if k in state:
                end = state[k].entries[-1][0] + state[k].span
                if end < r.watermark:
                    del state[k]
                else:
                    heappush(ends, (end, k))
        if key not in state:
            f = state[key] = Fold(*plans[r.correlation_index])
            if max_state:
                heappush(ends, (r.time_us + f.span, key))
                heappush(ages, (r.time_us, key))
        f = state[key]
        if f.observe(entry(r), r.watermark):
            yield telling(key, r.time_us, f)
        while max_state and len(state) > max_state:
            age, k = heappop(ages)
            if k not in state:
                continue
            latest = state[k].entries[-1][0]
            if latest != age:
                heappush(ages, (latest, k))
            else:
                del state[k]


def pretty(row, rules: list[Rule], event_fields: list[str] | None = None, event_limit: int = 3) -> str:
    """A correlation's row as lines: the rule, its group and window, and up to event_limit of its events (0: all)."""
    rule = rules[row.correlation_index]
    out = [f"{rule.title} [{rule.level or '-'}]"]
    names = [*rule.correlation.group_by]
    out += [f"  scope: {row.scope}"] if row.scope else []
    out += [f"  {n}: {v}" for n, v in zip(names, row.groups, strict=True)]
    when = [pd.Timestamp(t, unit="us", tz="UTC").isoformat().replace("+00:00", "Z") for t in (row.window_start_us, row.window_end_us)]
    out.append(f"  window: {when[0]} to {when[1]}, {len(row.entries)} events")
    shown = row.entries[: event_limit or None]
    for e in shown:
        fields = " ".join(f"{n}={'' if v is None else v}" for n, v in zip(event_fields or [], e.fields, strict=True))
        out.append(f"  - {e.file_path}#{e.rec_seq} {rules[e.rule_index].title} {fields}".rstrip())
    if len(shown) < len(row.entries):
        out.append(f"  ... {len(row.entries) - len(shown)} more")
    return "\n".join(out)
