"""Search, projection, grouping, rule hunts and record shapes over event DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import Field, taken_out, with_taken
from ..plans.sigma import Rule
from ..plans.stql import Query, Summarize, condition, parse

META = ("timestamp", "record_id", "channel", "provider", "event_id", "computer")
#: Tasks over which the distinct values of one group are dealt before the first of them are kept.
SPREAD = 16
#: Rules whose hits make up one array; the arrays of all rules stand side by side in one scan.
RULES_AN_ARRAY = 64


def with_hits(events: DataFrame, hits: Callable[[], Column], name: str) -> DataFrame:
    """A row of an event for every element of the array that hits() makes of its fields, with that element.

    The optimizer puts a filter below the projection that parses events, and so parses them anew for each field that
    the filter names. Here fields are taken out once, in a projection of their own, and hits are generated from them;
    a generator that keeps empty rows is the one that no filter is made from.
    """
    with taken_out() as columns:
        found = hits()
    own = events.columns
    return with_taken(events, columns).select(*own, F.explode_outer(found).alias(name)).where(F.col(name).isNotNull())


def matching(events: DataFrame, query: str | Query) -> DataFrame:
    query = parse(query) if isinstance(query, str) else query
    return with_hits(events, lambda: F.when(condition(query.filter), F.array(F.lit(True))), "__hit").drop("__hit")


def projected(names: list[str]) -> Column:
    """A struct of the fields' texts; what is missing or no scalar is null."""
    return F.struct(*(Field(n).text.alias(n) for n in names))


def record_shape(events: DataFrame, fields: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Metadata, source, and either the projected fields or the whole raw event."""
    source = F.struct("file_path", "collection_root").alias("source")
    last = projected(fields).alias("fields") if fields and not raw else F.col("raw")
    return events.select(*META, source, last)


def first_matches(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy("file_seq", "rec_seq").limit(n)


def summarize(events: DataFrame, plan: Summarize) -> DataFrame:
    """One row for each group. make_set keeps the first distinct values in event order, as many as its size, and sorts
    them. Without groups, no event gives no row."""
    last = {g.alias: g for g in plan.by}
    by = [Field(g.field).text.alias(f"g{i}") for i, g in enumerate(last.values())]
    keys = [f"g{i}" for i in range(len(last))]
    sets = [(i, a) for i, a in enumerate(plan.aggregates) if a.kind == "make_set"]
    rows = events.select("file_seq", "rec_seq", *by, *(Field(a.field).text.alias(f"v{i}") for i, a in sets))
    if not plan.aggregates:
        out = rows.select(*keys).distinct()
    else:
        total = F.count(F.lit(1)).alias("total")
        out = rows.groupBy(*keys).agg(total) if keys else rows.agg(total).where("total > 0")
        for i, a in sets:
            first = rows.where(F.col(f"v{i}").isNotNull()).groupBy(*keys, f"v{i}").agg(F.min(F.struct("file_seq", "rec_seq")).alias("at"))
            # In two steps, so that the values of one large group are ranked in several tasks first.
            for dealt in (F.pmod(F.xxhash64(f"v{i}"), F.lit(SPREAD)), F.lit(0)):
                window = Window.partitionBy(*keys, dealt).orderBy("at", f"v{i}")
                first = first.withColumn("r", F.row_number().over(window)).where(F.col("r") <= a.size).drop("r")
            capped = first.groupBy(*keys).agg(F.array_sort(F.collect_list(f"v{i}")).alias(f"a{i}"))
            names = [f"{k}_{i}" for k in keys]
            capped = capped.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), f"a{i}")
            same = [out[k].eqNullSafe(capped[n]) for k, n in zip(keys, names, strict=True)]
            out = (out.join(capped, same, "left") if keys else out.join(capped, F.lit(True), "left")).drop(*names)
            out = out.withColumn(f"a{i}", F.coalesce(f"a{i}", F.array().cast("array<string>")))
    cols = {g: F.col(f"g{i}") for i, g in enumerate(last)}
    for i, a in enumerate(plan.aggregates):
        cols[a.alias] = F.col("total") if a.kind == "count" else F.col(f"a{i}")
    # Groups in order, a missing one first; the keys stand beside the columns, whose names may repeat theirs.
    ordered = out.orderBy(*(F.asc_nulls_first(k) for k in keys)) if keys else out
    return ordered.select(*(c.alias(n) for n, c in cols.items()))


def search(events: DataFrame, text: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The whole search: filter, then limit, then summarize, keep or the full record. fields win over keep."""
    query = parse(text)
    found = matching(events, query)
    if limit is not None:
        found = first_matches(found, limit)
    if query.summarize:
        return summarize(found, query.summarize)
    return record_shape(found, fields or list(query.keep) or None)


def nested_summary(rows: DataFrame, plan: Summarize) -> DataFrame:
    """Summary rows as {"groups": {...}, "aggregates": {...}}."""
    groups = [g.alias for g in plan.by]
    names = [a.alias for a in plan.aggregates]
    empty = F.from_json(F.lit("{}"), "struct<_:string>")
    return rows.select(
        (F.struct(*groups) if groups else empty).alias("groups"), (F.struct(*names) if names else empty).alias("aggregates")
    )


def rule_matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """An event row with rule_index for each rule that it matches; correlation documents match nothing.

    All rules are tested in one scan, and a field that rules name is taken out of the event once. Where all rules name
    their event ids, only those are read, so that a columnar source skips the others.
    """
    numbered = [(i, r) for i, r in enumerate(rules) if r.correlation is None]
    if not numbered:
        return events.withColumn("rule_index", F.lit(0)).where(F.lit(False))
    ids = [r.event_ids() for _, r in numbered]
    rows = events
    if all(i is not None for i in ids):
        rows = rows.where(F.col("event_id").isin(sorted(frozenset().union(*ids))))

    def hits() -> Column:
        arrays = []
        for at in range(0, len(numbered), RULES_AN_ARRAY):
            some = numbered[at : at + RULES_AN_ARRAY]
            arrays.append(F.filter(F.array(*(F.when(r.column(), F.lit(i)) for i, r in some)), lambda x: x.isNotNull()))
        return F.concat(*arrays)

    return with_hits(rows, hits, "rule_index")


def alerts(matches: DataFrame, rules: list[Rule], wanted: list[bool] | None = None) -> DataFrame:
    """Alert rows: type, rule, event. The rules' own columns come from a map of literals, as many as there are rules."""
    wanted = wanted or [r.correlation is None for r in rules]
    kept = matches.where(F.col("rule_index").isin([i for i, w in enumerate(wanted) if w]))
    spark = matches.sparkSession
    rows = [(i, r.title, r.id, r.level, r.status, list(r.tags), r.path) for i, r in enumerate(rules)]
    table = spark.createDataFrame(
        rows, "rule_index int, title string, id string, level string, status string, tags array<string>, path string"
    )
    source = F.struct("file_path", "collection_root").alias("source")
    return kept.join(F.broadcast(table), "rule_index").select(
        F.lit("sigma_match").alias("type"),
        F.struct("title", "id", "level", "status", "tags", "path").alias("rule"),
        F.struct(*META, source).alias("event"),
        "rule_index",
        "file_seq",
        "rec_seq",
    )


def payload() -> Column:
    """Event data, or else event_data, or else the whole event."""
    return F.coalesce(
        F.try_variant_get("raw", '$["Event"]["EventData"]', "variant"), F.try_variant_get("raw", '$["event_data"]', "variant"), F.col("raw")
    )


def explain(text: str) -> str:
    return json.dumps(parse(text), default=lambda x: {type(x).__name__: x.__dict__}, indent=1)
