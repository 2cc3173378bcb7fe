"""What several of the operators share: the written-table cut of a lineage, and splitting texts into blocks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset (local runs and tests) a temporary folder is made once for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lanternlog.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="lanternlog-")
        spark.conf.set("lanternlog.scratch", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors.

    Tables lie under lanternlog-<application id>; `clean` removes them once results are saved.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lanternlog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of what made them."""
    import gc

    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete this application's written tables. Call it after the results that read them are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lanternlog-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, with as many underscores before them as no column of df has (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return tuple(names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lanes(amount: int, each: int) -> int:
    """How many groups to deal `amount` into by a hash, so that one holds about `each` however large the input is."""
    return max(24, -(-amount // each))


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts, from a scan of their lengths, to deal them into as many groups as there is data."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def remainder(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def doc_batches(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) blocks of about block_bytes, whole texts only; a null text is an empty one.

    A block ends as soon as its texts reach block_bytes, so that memory depends on that figure and the
    longest single text, not on how many rows a partition or an Arrow batch holds.
    """
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        names = batch.schema.names
        col = batch.column(names.index("text"))
        for doc_id, text in zip(batch.column(names.index("doc_id")).to_pylist(), col, strict=True):
            text = text.as_py() or ""
            ids.append(doc_id)
            texts.append(text)
            held += len(text) + 64
            if held >= block_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def byte_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, data, offsets): like doc_batches, but the texts stay one run of UTF-8 bytes, text i at offsets[i].

    A block lies in one Arrow batch and has at most block_bytes, or a single text.
    """
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        if not ids:
            continue
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(ids) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        start = 0
        while start < len(ids):
            fit = int(np.searchsorted(offsets, offsets[start] + block_bytes, "right")) - 1
            stop = min(max(fit, start + 1), len(ids))
            yield ids[start:stop], data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text alone, so that other columns of any name do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file: in folder if given, else where the installed package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
