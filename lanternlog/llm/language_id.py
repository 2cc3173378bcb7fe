"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import doc_batches, documents, id_remainder, read_table, written

#: Ranks that a profile holds, and the longest n-gram.
PROFILE = 300
LONGEST = 3
BLOCK_BYTES = 2 << 20
#: Languages that a profile table may hold: more than ISO 639-3 has codes. It bounds what is broadcast.
MOST_LANGUAGES = 8192
UNDETERMINED = "und"
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams of lower-cased letters, 1 to LONGEST long, and their counts.

    Anything that is no letter parts words; a word stands between single blanks. An n-gram is its characters'
    code points, 21 bits each. The n-gram of one blank is left out. Without letters there are none.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 32) if len(points) else points
    points = np.concatenate([[32], points, [32]])
    points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, every = points, [points[points != 32]]
    for n in range(2, LONGEST + 1):
        codes = (codes[:-1] << 21) | points[n - 1 :]
        every.append(codes)
    return np.unique(np.concatenate(every), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most first; ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0) of every language: counts over all rows with a text and a lang.

    Counts are summed in blocks first, so that a language that holds most rows costs no more than another. The
    first ranks are taken in 64 parts of each language's n-grams, then over what the parts kept.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                by: dict[str, list] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    by.setdefault(lang, []).append(grams(text.as_py()))
                for lang, found in by.items():
                    codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([x for _, x in found]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], schema=GRAMS
                    )

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = (
        rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    first = [F.desc("n"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    kept = (
        counted.withColumn("part", part)
        .withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*first)))
        .where(F.col("r") <= size)
        .drop("r", "part")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*first)) - 1
    return kept.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """All languages' ranks of each n-gram that any profile holds."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.codes = np.unique(np.array([r["gram"] for r in rows] or [-1], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        for r in rows:
            self.ranks[at[r["lang"]], np.searchsorted(self.codes, r["gram"])] = r["rank"]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        theirs = np.where(self.codes[at] == top, self.ranks[:, at], -1)
        away = np.where(theirs >= 0, np.abs(theirs - np.arange(len(top))), self.size).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.size * len(top))


def collected_profiles(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    rows = profiles.limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles(rows, size)


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of each row's whole text.

    score is 1 less the out-of-place distance over the largest possible one. `und`, 0: null or empty text, no letter,
    or no language learned. Ties go to the language that sorts first. Repeated rows: a row each; empty table: no rows.
    """

    def run(batches):
        for ids, texts in doc_batches(batches, BLOCK_BYTES):
            found = [profiles.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                schema=PREDICTED,
            )

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: Profiles, into: str = "_lang_pred") -> DataFrame:
    """All columns of docs with one more, which docs must not have: lang_pred of predict_languages, without a join."""

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = batch.column(at)
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [profiles.predict(t.as_py())[0] for t in texts.slice(k, 512)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, into]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(into, T.StringType())]))


def fit(docs: DataFrame) -> Profiles:
    """Profiles of all labelled rows whose crc32(doc_id) mod 4 is not 2."""
    labelled = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text")
    ).where(id_remainder(F.col("doc_id"), 4) != 2)
    return collected_profiles(written(learn_profiles(labelled), "profiles"))


def op10_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs)).select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )
