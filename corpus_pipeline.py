"""A training-corpus pipeline: language ID, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents. Null and empty texts, repeated rows, empty tables and
further columns are handled as the operators say; rows of one doc_id and text count as one document in the second
stage, with a null doc_id as with any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.llm import language_id, packing
from lanternlog.llm.jaccard_join import near_duplicates, text_hash
from lanternlog.llm.shared import free_names, read_table, tokenizer_path, written
from lanternlog.llm.suffix_dedup import without_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a text without a letter (or without a text) is rejected.

    Nothing else is rejected, however far from all profiles: scores of clean and of other texts overlap (see README).
    Without any labelled row there is no profile to compare with; then texts with a letter stay.
    """
    profiles = language_id.fit(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (predicted,) = free_names(docs, "lang_pred")
    found = language_id.with_language(docs, profiles, predicted)
    return found.where(F.col(predicted) != language_id.UNDETERMINED).drop(predicted)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id (null last), once.

    A document is a doc_id and a text, so texts of null or repeated ids go only if a near duplicate stays. Texts
    without a word are in no group; they stay. Texts and groups are told apart by 64-bit hashes.
    """
    key = list(free_names(docs, "near_no_id", "near_id", "near_text"))

    def keyed(df: DataFrame, text_hash: Column) -> DataFrame:
        doc_id = F.col("doc_id").cast("long")
        keys = (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text_hash)
        return df.select("*", *(c.alias(k) for c, k in zip(keys, key, strict=True)))

    found = keyed(near_duplicates(docs, words=5, percent=80), F.col("text_hash"))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    stays = first.union(found.where("root is null").select(*key)).distinct()
    once = keyed(docs, text_hash(F.col("text"))).dropDuplicates(key)
    return once.join(stays, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 200-byte string covers which occurs twice; those left without text go."""
    cut = without_repeats(docs)
    return cut.where(F.col("text") != "")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and its place there."""
    return packing.pack_documents(docs, tokenizer_path(packing.VOCABULARY)).drop("uid")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: The packing's search and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
