"""Sharding: contiguous balanced shards by global byte-size prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import read_table, shuffle_partitions, written


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Contiguous shards (in order of doc_id) whose byte totals are as equal as whole rows allow.

    A row's size is the UTF-8 length of its text (null: none) plus 1. Rows are dealt by range into pieces,
    each piece's total is summed, the totals' prefix sums (a table of 4 rows a shuffle partition, so of
    bounded size) are broadcast, and a running sum inside the piece gives every row its global byte offset.
    A row goes to the shard in whose equal share of all bytes its middle lies.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, byte_offset.
    Ties and repeated rows: equal ids follow each other by size, checksum, then place of reading, so they may
    be parted by a cut; a hot id is spread over pieces. Null ids come first. Null and empty texts have size 1.
    An empty table gives no rows. Other columns of the input are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "shard-sizes",
    )
    order = ["doc_id", "size", "text_crc32", "tie"]
    pieces = max(64, 4 * shuffle_partitions(docs.sparkSession))
    ranged = written(
        rows.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()), "shard-pieces"
    )
    totals = ranged.groupBy("piece").agg(F.sum("size").alias("piece_bytes"), F.count(F.lit(1)).alias("piece_rows"))
    ahead = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    starts = totals.select(
        "piece",
        F.coalesce(F.sum("piece_bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("piece_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("piece_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("piece").orderBy(*order)
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.select("*", before.alias("within"), F.row_number().over(inside).alias("row_in_piece")).join(
        F.broadcast(starts), "piece"
    )
    offset = F.col("bytes_ahead") + F.col("within")
    middle = F.floor((F.lit(2) * offset + F.col("size")) * F.lit(shards) / (F.lit(2) * F.col("all_bytes")))
    sharded = written(
        placed.select(
            "doc_id",
            "size",
            "text_crc32",
            offset.alias("byte_offset"),
            (F.col("rows_ahead") + F.col("row_in_piece") - 1).alias("row"),
            F.least(F.lit(shards - 1), middle).cast("int").alias("shard"),
        ),
        "shard-rows",
    )
    first = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "byte_offset",
    )


def op9_byte_shards(spark, sf_dir):
    return shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)
