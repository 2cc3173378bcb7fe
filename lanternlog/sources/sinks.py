"""Writing results: JSON lines, a JSON array, CSV of projected fields, and pretty records.

A single file is written by the driver, to which rows stream; with parts, the executors write a folder of part files.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SinkError(ValueError):
    pass


def json_lines(df: DataFrame) -> DataFrame:
    """One column with each row as JSON, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def _opened(path: str):
    if os.path.dirname(path) and not os.path.isdir(os.path.dirname(path)):
        raise SinkError(f"no such folder: {os.path.dirname(path)}")
    return open(path, "w", encoding="utf-8", newline="")


def write_jsonl(df: DataFrame, path: str, parts: bool = False) -> int:
    if parts:
        return _written(json_lines(df), path)
    n = 0
    with _opened(path) as f:
        for row in json_lines(df).toLocalIterator():
            f.write(row.value + "\n")
            n += 1
    return n


def write_json(df: DataFrame, path: str, pretty: bool = False, compact: bool = False) -> int:
    """One array; compact, also if both are asked for."""
    import json

    n = 0
    with _opened(path) as f:
        f.write("[")
        for row in json_lines(df).toLocalIterator():
            text = row.value if compact or not pretty else "\n" + json.dumps(json.loads(row.value), indent=2, ensure_ascii=False)
            f.write(("," if n else "") + text)
            n += 1
        f.write("\n]\n" if pretty and not compact and n else "]\n")
    return n


def _written(lines: DataFrame, path: str) -> int:
    """Write one column of lines as a folder of text files, and count them on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def csv_line(values: list[Column]) -> Column:
    """Texts side by side; one with a comma, a quote or a line end is quoted, a missing one is empty."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.when(v.rlike('[,"\r\n]'), quoted(v)).otherwise(F.coalesce(v, F.lit(""))) for v in values]
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str, fields: list[str] | None, raw: bool = False, parts: bool = False) -> int:
    """The struct column `fields` of a record shape, under a header; there is no guessing of columns.

    With parts, the header is a file of its own that sorts first, as part files have none.
    """
    if raw or not fields:
        raise SinkError("CSV needs fields")
    spark = df.sparkSession
    kinds = ", ".join(f"c{i} string" for i in range(len(fields)))
    cells = [F.col("fields").getField(n) for n in fields]
    lines = df.select(csv_line(cells).alias("value"))
    header = spark.createDataFrame([tuple(fields)], kinds)
    header = header.select(csv_line([F.col(c) for c in header.columns]).alias("value"))
    if parts:
        _written(header.coalesce(1), f"{path}/header")
        return _written(lines, f"{path}/rows")
    n = 0
    with _opened(path) as f:
        f.write(header.first().value + "\n")
        for row in lines.toLocalIterator():
            f.write(row.value + "\n")
            n += 1
    return n


def dump(df: DataFrame, path: str, form: str = "jsonl", fields: list[str] | None = None, raw: bool = False, pretty: bool = False, compact: bool = False, parts: bool = False) -> int:
    """Rows written. parts: a folder of part files instead of a single file, for JSON lines and CSV."""
    if parts and form == "json":
        raise SinkError("an array is a single file")
    if form == "jsonl":
        return write_jsonl(df, path, parts)
    if form == "json":
        return write_json(df, path, pretty, compact)
    if form == "csv":
        return write_csv(df, path, fields, raw, parts)
    raise SinkError(f"unsupported format {form}")


def pretty_records(df: DataFrame) -> Iterator[str]:
    """Each row as `name: value` lines between rules of dashes."""
    for row in df.toLocalIterator():
        out = io.StringIO()
        for name, value in row.asDict(recursive=True).items():
            if isinstance(value, dict):
                out.write(f"{name}:\n")
                for k, v in value.items():
                    out.write(f"  {k}: {'' if v is None else v}\n")
            else:
                out.write(f"{name}: {'' if value is None else value}\n")
        yield out.getvalue() + "-" * 60
