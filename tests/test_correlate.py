"""Correlations whose rules the registered queries don't use."""

import json
import random

import pytest

from lanternlog.operators.correlate import correlate, pretty
from lanternlog.plans.sigma import RuleError, parse_correlation, parse_documents

RULES = """
title: Base
name: base
detection: {sel: {EventID: 1}, condition: sel}
---
title: Several pairs
correlation: {type: value_count, rules: [base], timespan: 1h, condition: {gte: 3, field: %s}}
"""
COLUMNS = "file_seq int, rec_seq long, rule_index int, file_path string, computer string, timestamp string, text string"


def told(spark, pairs, field):
    """The record numbers in the window when the condition first holds."""
    rows = []
    for k, (a, b) in enumerate(pairs):
        data = {n: v for n, v in (("A", a), ("B", b)) if v is not None}
        text = json.dumps({"Event": {"EventData": data}})
        rows.append((0, k, 0, "f", "host", f"2024-01-01T00:00:{k:02d}.000000Z", text))
    matches = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "parse_json(text) AS raw")
    return [r.seqs for r in correlate(matches, parse_documents(RULES % field)).collect()]


def test_value_count_counts_tuples_of_a_list_of_fields(spark):
    # Two values of A and two of B, but three pairs; rows without one part, or a repeated pair, do not count.
    pairs = [("x", "1"), ("x", "1"), ("y", None), (None, "3"), ("x", "2"), ("y", "1"), ("y", "2")]
    assert told(spark, pairs, "[A, B]") == [[0, 1, 4, 5]]
    assert told(spark, [("x", "yz"), ("xy", "z"), ("x", "yz")], "[A, B]") == []
    assert told(spark, pairs, "[A]") == told(spark, pairs, "A") == []
    assert told(spark, [*pairs, ("z", None)], "A") == [[0, 1, 2, 4, 5, 6, 7]]


@pytest.mark.parametrize("field", [None, [], "", ["A", ""]])
def test_value_count_needs_fields(field):
    with pytest.raises(RuleError):
        parse_correlation({"type": "value_count", "rules": ["r"], "timespan": "1h", "condition": {"gte": 2, "field": field}})


def brute(rows, kind, needed, count, span, lateness, max_state):
    """Every match against plain lists: (key, time, times in the window) whenever the condition becomes true."""
    top, state, told, out = -1, {}, {}, []
    for key, time, position in rows:
        top = max(top, time)
        if time < top - lateness:
            continue
        for k in list(state):
            state[k] = [e for e in state[k] if e[0] >= top - lateness - span]
            if not state[k]:
                del state[k], told[k]
        entries = state.setdefault(key, [])
        told.setdefault(key, False)
        entries.append((time, position))
        entries.sort(key=lambda e: e[0])
        if kind == "event_count":
            now = len(entries) >= count
        elif kind == "temporal":
            now = len({p for _, p in entries}) == needed
        else:
            step = 0
            for _, p in entries:
                step += p == step
            now = step >= needed
        if now and not told[key]:
            out.append((key, time, [t for t, _ in entries]))
        told[key] = now
        while max_state and len(state) > max_state:
            k = min(state, key=lambda k: (state[k][-1][0], k))
            del state[k], told[k]
    return out


KINDS = """
title: A
name: a
detection: {sel: {EventID: 1}, condition: sel}
---
title: B
name: b
detection: {sel: {EventID: 2}, condition: sel}
---
title: C
correlation: {type: %s, rules: [a, b], group-by: [A], timespan: 30s%s}
"""


@pytest.mark.parametrize("kind", ["event_count", "temporal", "temporal_ordered"])
@pytest.mark.parametrize("max_state", [0, 2, 5, 1000])
def test_folds_against_plain_lists(spark, kind, max_state):
    rng = random.Random(f"{kind}{max_state}")
    rows, now = [], 0
    for _ in range(400):
        now += rng.choice([0, 0, 1, 2, 7])
        rows.append((f"k{rng.randrange(8)}", now - rng.choice([0, 0, 0, 3, 9, 25]) + 30, rng.randrange(2)))
    given = []
    for k, (key, time, position) in enumerate(rows):
        at = f"2024-01-01T{time // 3600:02d}:{time // 60 % 60:02d}:{time % 60:02d}.000000Z"
        given.append((k // 150, k, position, "f", "", at, json.dumps({"Event": {"EventData": {"A": key}}})))
    matches = spark.createDataFrame(given, COLUMNS).selectExpr("*", "parse_json(text) AS raw").repartition(5)
    rules = parse_documents(KINDS % (kind, ", condition: {gte: 3}" if kind == "event_count" else ""))
    found = correlate(matches, rules, "global", 10_000_000, max_state).collect()
    base = 1_704_067_200_000_000
    got = [(r.groups[0], (r.time_us - base) // 10**6, [(e.time_us - base) // 10**6 for e in r.entries]) for r in found]
    assert sorted(got) == sorted(brute(rows, kind, 2, 3, 30, 10, max_state))
    assert got


def test_entries_have_file_and_fields(spark):
    text = json.dumps({"Event": {"EventData": {"A": "x", "B": "y"}}})
    times = [f"2024-01-01T00:00:0{k}.000000Z" for k in range(3)]
    rows = [(k % 2, k // 2, 0, f"f{k % 2}", "h", times[(0, 2, 1)[k]], text) for k in range(3)]
    matches = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "parse_json(text) AS raw")
    rules = parse_documents(KINDS % ("event_count", ", condition: {gte: 3}"))
    row = correlate(matches, rules, "host", event_fields=["Event.EventData.B", "computer"]).first()
    assert [(e.file_path, e.rec_seq, e.fields) for e in row.entries] == [("f0", 0, ["y", "h"]), ("f0", 1, ["y", "h"]), ("f1", 0, ["y", "h"])]
    assert row.scope == "h" and row.groups == ["x"]
    assert correlate(matches, rules, "file").count() == 0
    with pytest.raises(ValueError):
        correlate(matches, rules, "planet")
    text = pretty(row, rules, ["B", "host"], 2)
    assert "- f0#0 A B=y host=h" in text and text.endswith("... 1 more")
