"""Searches, hunts and correlations over a stream of raw events: the conditions are the batch ones.

Only counts and correlations keep state, which goes as the watermark moves on.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import instant
from ..operators.correlate import LATENESS_US, OUT, OUT_NAMES, Fold, entry, fold_plans, keyed, telling
from ..operators.search import matching, rule_matches
from ..plans.sigma import Rule
from ..sources.events import with_metadata


def event_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Events of JSON-lines files as they arrive in a folder, up to files_at_once in a batch.

    Records have no number within their file there.
    """
    reader = spark.readStream
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    lines = reader.text(folder).select(
        F.lit(0).alias("file_seq"),
        F.lit(0).cast("long").alias("rec_seq"),
        F.col("_metadata.file_path").alias("file_path"),
        F.lit(folder).alias("collection_root"),
        F.col("value").alias("raw_json"),
    )
    return with_metadata(lines.where(F.try_parse_json("raw_json").isNotNull()))


def streaming_search(events: DataFrame, query: str) -> DataFrame:
    return matching(events, query)


def streaming_counts(events: DataFrame, rules: list[Rule], window: str, lateness: str = "2 minutes") -> DataFrame:
    """Matches of each rule in tumbling windows of event time; later matches than the lateness are dropped."""
    found = rule_matches(events, rules).withColumn("at", instant(F.col("timestamp")))
    return (
        found.withWatermark("at", lateness)
        .groupBy(F.window("at", window), "rule_index", "computer")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("window.start", "window.end", "rule_index", "computer", "n")
    )


def streaming_correlate(
    events: DataFrame,
    rules: list[Rule],
    scope: str = "host",
    lateness_us: int = LATENESS_US,
    event_fields: list[str] | None = None,
) -> DataFrame:
    """The rows of correlate, as soon as a condition becomes true; for output mode append.

    A batch's matches of a key are folded in order of time, onto what its window held before. A window reaches back
    the timespan and the lateness from its key's newest match, so where events come in order of time the rows are those
    of the batch form. Matches behind the stream's watermark are dropped, as are those that are late by their key's
    newest match. A key's state holds its window alone and goes when the watermark has passed it; no number of keys
    makes keys evict each other. A task holds one key's matches of a batch and its window.
    """
    plans = fold_plans(rules)
    if not plans:
        raise ValueError("no correlation among the rules")
    found = rule_matches(events, rules).withColumn("at", instant(F.col("timestamp")))
    timed = found.where("at is not null").withColumn("time_us", F.unix_micros("at"))
    timed = timed.withWatermark("at", f"{lateness_us} microseconds")
    key = F.to_json(F.struct("correlation_index", "scope", "groups")).alias("key")
    rows = keyed(timed, rules, scope, event_fields, "at").withColumn("key", key)

    def fold(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        at = json.loads(group[0])
        name = (at["correlation_index"], at["scope"], at["groups"])
        f = Fold(*plans[name[0]])
        if state.exists:
            f.told, held = state.get
            f.entries = [(t, p, tuple(v), tuple(told)) for t, p, v, told in json.loads(held)]
            f.seen = Counter(map(f.mark, f.entries))
        pdf = pd.concat(frames).sort_values(["time_us", "file_path", "file_seq", "rec_seq", "rule_index"], kind="stable")
        behind, out = state.getCurrentWatermarkMs() * 1000, []
        for r in pdf.itertuples(index=False):
            newest = max(r.time_us, f.entries[-1][0] if f.entries else r.time_us)
            if r.time_us >= max(behind, newest - lateness_us) and f.observe(entry(r), newest - lateness_us):
                out.append(telling(name, r.time_us, f))
        past = (f.entries[-1][0] + f.span + lateness_us) // 1000 + 1 if f.entries else 0
        if past > state.getCurrentWatermarkMs():
            state.update((f.told, json.dumps(f.entries, default=int)))
            state.setTimeoutTimestamp(past)
        elif state.exists:  # no match that is still to come could meet what is in the window
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=OUT_NAMES)

    return rows.groupBy("key").applyInPandasWithState(
        fold, OUT, "told boolean, entries string", "append", "EventTimeTimeout"
    )
