"""Reading events: discovery of inputs, and the event columns from raw JSON or from source records."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import unsigned, variant_path
from ..functions.globs import GlobError, glob_pattern
from .evtx import CHUNK_BYTES, FILE_HEADER, FILE_MAGIC, decode_chunk

EXTENSIONS = (".evtx", ".jsonl", ".json", ".parquet")


#: How far a value may lie inside objects of #text.
TEXT_DEPTH = 4
#: Bits of a record's number that count records of one part of a file; the others are the part's place in the file.
PART_BITS, PLACE_BITS = 33, 16
#: Bits of a record's number that count records of one chunk; the others are the chunk's place in the file.
CHUNK_BITS = 16
#: Chunks that are cut out of a file at once.
RUN_CHUNKS = 64


class DiscoveryError(ValueError):
    pass


def discover(
    roots: list[str] | None = None,
    paths_from: str | None = None,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    recursive: bool = True,
    extensions: tuple[str, ...] = EXTENSIONS,
) -> list[tuple[str, str]]:
    """(path, collection root), in order of path; duplicates of a list stay. Without roots or a list: the folder `.`."""
    wanted = list(roots or [])
    if paths_from:
        try:
            with open(paths_from, encoding="utf-8") as f:
                wanted += [s for line in f if (s := line.strip()) and not s.startswith("#")]
        except OSError as e:
            raise DiscoveryError(f"unreadable list: {paths_from}") from e
    if not wanted and not paths_from:
        wanted = ["."]
    try:
        yes, no = [glob_pattern(g) for g in include], [glob_pattern(g) for g in exclude]
    except GlobError as e:
        raise DiscoveryError(str(e)) from None

    def unreadable(e: OSError):
        raise DiscoveryError(f"unreadable folder: {e.filename}")

    found = []
    for root in wanted:
        if os.path.isfile(root):
            found.append((root, os.path.dirname(root)))
        elif os.path.isdir(root):
            for folder, folders, names in os.walk(root, onerror=unreadable):
                if not recursive:
                    folders.clear()
                found += [(os.path.join(folder, n), root) for n in names if n.lower().endswith(extensions)]
        else:
            raise DiscoveryError(f"neither file nor folder: {root}")
    return sorted(
        (f for f in found if (not yes or any(p.fullmatch(f[0]) for p in yes)) and not any(p.fullmatch(f[0]) for p in no)),
        key=lambda f: f[0],
    )


def _text(*paths: str) -> Column:
    """The first of the paths whose value is a text or a number; an object stands for its #text, and so on inwards."""

    def inner(path: str, depth: int) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("raw", variant_path(path), "variant"))
        simple = ~kind.rlike(r"\A(ARRAY|OBJECT|VOID|BOOLEAN)")
        found = F.when(simple, F.try_variant_get("raw", variant_path(path), "string"))
        return found.when(kind.startswith("OBJECT"), inner(f"{path}.#text", depth - 1)) if depth else found

    return F.coalesce(*(inner(p, TEXT_DEPTH) for p in paths))


def with_metadata(rows: DataFrame) -> DataFrame:
    """The event columns, from raw_json and what says where it came from (file_seq, rec_seq, file_path, collection_root).

    A column parser_id, if there is one, goes before the event's own record number.
    """
    s = "Event.System."
    parsed = rows.withColumn("raw", F.try_parse_json("raw_json"))
    record_id = unsigned(_text(s + "EventRecordID")).cast("bigint")
    if "parser_id" in rows.columns:
        record_id = F.coalesce("parser_id", record_id)
    return parsed.select(
        "file_seq",
        "rec_seq",
        "file_path",
        "collection_root",
        _text(s + "TimeCreated.SystemTime", s + "TimeCreated.#attributes.SystemTime").alias("timestamp"),
        record_id.alias("record_id"),
        _text(s + "Channel").alias("channel"),
        _text(s + "Provider.Name", s + "Provider.#attributes.Name").alias("provider"),
        unsigned(_text(s + "EventID")).cast("bigint").alias("event_id"),
        _text(s + "Computer").alias("computer"),
        "raw",
        "raw_json",
    )


def lifted(line: Column) -> Column:
    """A source record (flat metadata and event_data) as raw event JSON, its event_data text kept as it stands."""

    def get(name: str) -> Column:
        return F.get_json_object(line, f"$.{name}")

    def quoted(name: str) -> Column:
        wrapped = F.to_json(F.struct(get(name).alias("v")))
        return F.when(get(name).isNull(), F.lit("null")).otherwise(F.regexp_extract(wrapped, r'(?s)\A\{"v":(.*)\}\z', 1))

    return F.concat(
        F.lit('{"Event":{"System":{"Provider":{"#attributes":{"Name":'),
        quoted("provider"),
        F.lit(',"Guid":'),
        quoted("provider_guid"),
        F.lit('}},"EventID":'),
        F.coalesce(get("event_id"), F.lit("null")),
        F.lit(',"EventRecordID":'),
        F.coalesce(get("record_id"), F.lit("null")),
        F.lit(',"Channel":'),
        quoted("channel"),
        F.lit(',"Computer":'),
        quoted("computer"),
        F.lit(',"TimeCreated":{"#attributes":{"SystemTime":'),
        quoted("timestamp"),
        F.lit('}}},"EventData":'),
        F.coalesce(get("event_data"), F.lit("{}")),
        F.lit("}}"),
    )


def read_events(spark: SparkSession, inputs: list[tuple[str, str]], source_records: bool = False, strict: bool = False) -> DataFrame:
    """Events of inputs of one kind, by the extension: event logs (see read_evtx), JSON lines (read_jsonl) or Parquet (read_parquet)."""
    kind = _kind(inputs)
    if kind == ".parquet":
        return read_parquet(spark, inputs)
    if kind == ".evtx":
        return read_evtx(spark, inputs, strict)
    return read_jsonl(spark, inputs, source_records, strict)


def _kind(inputs: list[tuple[str, str]]) -> str:
    kinds = {os.path.splitext(p)[1].lower() for p, _ in inputs}
    if len(kinds) > 1:
        raise DiscoveryError(f"inputs of several kinds: {sorted(kinds)}")
    return kinds.pop() if kinds else ""


def evtx_records(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """file_seq, rec_seq, file_path, collection_root, parser_id, raw_json, error of every record of event log files.

    A record, or a chunk, that can't be decoded has an error in place of raw_json. A file without the signature of an
    event log makes the query fail, as does one over 2 GB, which Spark reads as no single value. An empty file holds no
    records. What follows the last whole chunk is passed over.
    """
    if not inputs:
        columns = "file_seq int, rec_seq long, file_path string, collection_root string, parser_id long, raw_json string, error string"
        return spark.createDataFrame([], columns)
    files = spark.read.format("binaryFile").load(sorted({_uri(p) for p, _ in inputs}))
    magic = F.substring("content", 1, len(FILE_MAGIC)) == F.lit(FILE_MAGIC)
    wrong = F.raise_error(F.concat(F.lit("no event log: "), "path")).cast("binary")
    whole = F.when(magic & (F.length("content") >= FILE_HEADER), F.col("content")).otherwise(wrong)
    # Runs of chunks go to tasks of their own, so that neither a large file nor a batch of rows is held by Python.
    run = RUN_CHUNKS * CHUNK_BYTES
    chunks = F.expr(f"cast((length(content) - {FILE_HEADER}) div {CHUNK_BYTES} as int)")
    runs = F.when(chunks > 0, F.sequence(F.lit(0), F.expr("n - 1").cast("int"), F.lit(RUN_CHUNKS)))
    cut = (
        files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), whole.alias("content"))
        .withColumn("n", chunks)
        .withColumn("parts", F.transform(runs, lambda k: F.struct(
            k.alias("first"),
            F.expr("content").substr(k * CHUNK_BYTES + FILE_HEADER + 1, F.least(F.lit(run), (F.col("n") - k) * CHUNK_BYTES)).alias("data"),
        )))
        .select("uri", F.explode("parts").alias("part"))
        .select("uri", "part.first", "part.data")
    )

    def decoded(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, first, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                uri, first, data = uri.as_py(), first.as_py(), data.as_buffer().to_pybytes()
                for k in range(0, len(data), CHUNK_BYTES):
                    found = decode_chunk(data[k : k + CHUNK_BYTES])
                    place = (first + k // CHUNK_BYTES) << CHUNK_BITS
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uri] * len(found), pa.string()),
                            pa.array([place + i for i in range(len(found))], pa.int64()),
                            pa.array([None if f[0] is None or f[0] >> 63 else f[0] for f in found], pa.int64()),
                            pa.array([f[1] for f in found], pa.string()),
                            pa.array([f[2] for f in found], pa.string()),
                        ],
                        names=["uri", "rec_seq", "parser_id", "raw_json", "error"],
                    )

    found = cut.mapInArrow(decoded, "uri string, rec_seq long, parser_id long, raw_json string, error string")
    return found.join(_manifest(spark, inputs), "uri").drop("uri")


def read_evtx(spark: SparkSession, inputs: list[tuple[str, str]], strict: bool = False) -> DataFrame:
    """Events of event log files, in order of path, chunk and record.

    What can't be decoded is left out (strict: it makes the query fail); `bad_lines` gives it.
    """
    records = evtx_records(spark, inputs)
    good = F.col("error").isNull()
    if strict:
        said = F.raise_error(F.concat(F.lit("bad record in "), "file_path", F.lit(": "), "error")).cast("boolean")
        good = F.when(good, F.lit(True)).otherwise(said)
    return with_metadata(records.where(good))


def read_parquet(spark: SparkSession, inputs: list[tuple[str, str]], column: str = "raw_json") -> DataFrame:
    """Events of Parquet files with a text column of raw event JSON, in order of path and row."""
    if not inputs:
        return read_jsonl(spark, [])
    rows = spark.read.parquet(*sorted({_uri(p) for p, _ in inputs})).select(
        F.col(f"`{column}`").alias("raw_json"), _found_at().alias("uri"), F.col("_metadata.row_index").alias("rec_seq")
    )
    rows = rows.join(_manifest(spark, inputs), "uri")
    return with_metadata(rows.where(F.try_parse_json("raw_json").isNotNull()))


def read_jsonl(spark: SparkSession, inputs: list[tuple[str, str]], source_records: bool = False, strict: bool = False) -> DataFrame:
    """Events of JSON-lines files, one raw event (or one source record) a line, in order of path and line.

    Lines that are no JSON are left out (strict: they make the query fail); `bad_lines` gives them. rec_seq orders the
    lines of a file, with gaps.
    """
    lines = _lines(spark, inputs)
    good = F.try_parse_json("value").isNotNull()
    if strict:
        lines = lines.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad record in "), "file_path")).cast("boolean")))
    else:
        lines = lines.where(good)
    raw = lifted(F.col("value")) if source_records else F.col("value")
    return with_metadata(lines.select("file_seq", "rec_seq", "file_path", "collection_root", raw.alias("raw_json")))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _found_at() -> Column:
    """The file that a row is from, spelled as _uri does. Spark encodes the path."""
    return F.regexp_replace(F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def _manifest(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """One row for each input that the caller listed; Spark broadcasts it only while it is small."""
    return spark.createDataFrame(
        [(i, _uri(p), p, r) for i, (p, r) in enumerate(inputs)],
        "file_seq int, uri string, file_path string, collection_root string",
    )


def _lines(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    for path, _ in inputs:
        if path.lower().endswith((".evtx", ".parquet")):
            raise DiscoveryError(f"no lines of text: {path}")
    if not inputs:
        return spark.createDataFrame([], "file_seq int, rec_seq long, file_path string, collection_root string, value string")
    # A part of a file is read in order by one task, whose rows count up; parts are told apart by where they begin.
    count = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PART_BITS) - 1))
    part = F.shiftright(F.col("_metadata.file_block_start"), PLACE_BITS)
    read = spark.read.text(sorted({_uri(p) for p, _ in inputs})).select(
        "value", _found_at().alias("uri"), (F.shiftleft(part, PART_BITS) + count).alias("rec_seq")
    )
    return read.where(F.trim("value") != "").join(_manifest(spark, inputs), "uri").drop("uri")


def records_and_errors(spark: SparkSession, inputs: list[tuple[str, str]], source_records: bool = False) -> DataFrame:
    """file_seq, rec_seq, file_path, collection_root, raw_json (null for what is no record), error; parser_id of event logs."""
    if _kind(inputs) == ".evtx":
        return evtx_records(spark, inputs)
    raw = lifted(F.col("value")) if source_records else F.col("value")
    good = F.try_parse_json("value").isNotNull()
    error = F.concat(F.lit("invalid JSON record: "), F.substring("value", 1, 80))
    return _lines(spark, inputs).select(
        "file_seq", "rec_seq", "file_path", "collection_root", F.when(good, raw).alias("raw_json"), F.when(~good, error).alias("error")
    )


def bad_lines(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """file_path, error of lines that are no JSON, or of records of event logs that can't be decoded."""
    found = records_and_errors(spark, inputs).where("error is not null")
    return found.select("file_path", "error", "file_seq", "rec_seq")


def write_errors(spark: SparkSession, inputs: list[tuple[str, str]], path: str) -> int:
    """The bad lines as JSON lines of file_path and error, in order; how many there are."""
    from .sinks import write_jsonl

    return write_jsonl(bad_lines(spark, inputs).orderBy("file_seq", "rec_seq").select("file_path", "error"), path)
