"""Correlation in a stream, against its batch form."""

import json
import os
import random

import pytest

from lanternlog.operators.correlate import correlate
from lanternlog.operators.search import rule_matches
from lanternlog.plans.sigma import parse_documents
from lanternlog.sources.events import discover, read_events
from lanternlog.streaming.hunt import event_stream, streaming_correlate

RULES = """
title: A
name: a
detection: {sel: {EventID: 1}, condition: sel}
---
title: B
name: b
detection: {sel: {EventID: 2}, condition: sel}
---
title: Many
correlation: {type: event_count, rules: [a, b], group-by: [K], timespan: 20s, condition: {gte: 3}}
---
title: Values
correlation: {type: value_count, rules: [a], group-by: [K], timespan: 40s, condition: {gte: 3, field: V}}
---
title: Order
correlation: {type: temporal_ordered, rules: [a, b], group-by: [K], timespan: 5s}
"""


def event(k, second, kind, key, value):
    at = f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.{k % 1000:03d}000Z"
    system = {"EventID": kind, "EventRecordID": k, "Computer": "h", "TimeCreated": {"#attributes": {"SystemTime": at}}}
    data = {"K": key, "V": value} if key else {"V": value}
    return json.dumps({"Event": {"System": system, "EventData": data}})


def arrive(folder, files):
    for n, lines in enumerate(files):
        path = folder / f"{n:02d}.jsonl"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def streamed(spark, folder, name, rules, **options):
    rows = streaming_correlate(event_stream(spark, str(folder), files_at_once=1), rules, "global", **options)
    query = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return spark.table(name).collect(), held
    finally:
        query.stop()


def shape(rows):
    return sorted(
        (r.correlation_index, r.groups, r.time_us, r.window_start_us, r.window_end_us, [(e.time_us, e.rule_index, e.fields) for e in r.entries])
        for r in rows
    )


def test_stream_against_batch(spark, tmp_path):
    rng, now, lines = random.Random(5), 0, []
    for k in range(300):
        now += rng.choice([0, 1, 2, 9])
        lines.append(event(k, now, rng.choice([1, 1, 2, 3]), rng.choice(["x", "y", "z", None]), f"v{rng.randrange(4)}"))
    arrive(tmp_path, [lines[k : k + 60] for k in range(0, 300, 60)])
    rules = parse_documents(RULES)
    found, _ = streamed(spark, tmp_path, "told", rules, lateness_us=3_000_000, event_fields=["Event.EventData.V"])
    events = read_events(spark, discover([str(tmp_path)]))
    batch = correlate(rule_matches(events, rules), rules, "global", 3_000_000, event_fields=["Event.EventData.V"]).collect()
    assert shape(found) == shape(batch)
    assert {r.correlation_index for r in found} == {2, 3, 4}


def test_late_matches_go_and_so_does_old_state(spark, tmp_path):
    near = [event(k, 100 + k, 1, "x", "v") for k in range(2)]
    late = [event(5, 10, 1, "x", "v"), event(6, 101, 1, "q", "v")]  # the first is behind the watermark
    far = [event(k, 5000 + k, 1, "w", "v") for k in range(7, 9)]
    last = [event(9, 5003, 1, "w", "v"), event(10, 102, 1, "x", "v")]
    arrive(tmp_path, [near, late, far, last, [event(11, 5004, 3, "n", "v")]])
    rules = parse_documents(RULES)
    found, held = streamed(spark, tmp_path, "told_late", rules, lateness_us=5_000_000)
    assert [(r.correlation_index, r.groups, len(r.entries)) for r in found] == [(2, ["w"], 3)]
    assert max(held) >= 6 and held[-1] == 3  # the keys of x and q are gone


def test_needs_a_correlation(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming_correlate(event_stream(spark, str(tmp_path)), parse_documents(RULES)[:2])
