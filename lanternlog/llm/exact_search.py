"""Exact top-k by inner product: a KD-tree per shard, best-first traversal, and a kth score that is carried along."""

from __future__ import annotations

import io
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import read_table, written

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEAF = 64
#: Parts over which the shards are dealt, and to each of which every block of queries goes: one for so many shards, and
#: from the first to the second number of them. A lane's shards pass one by one, so their number bounds no memory.
LANE_SHARDS = 64
LANES = (64, 4096)
PACKED = pa.schema([("part", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)
FOUND_DDL = "block long, place int, query_id long, vec_id long, score long"


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Median splits along the widest side; every node has its tight box. Rows are put in the order of the leaves."""
    order = np.arange(len(ids))
    spans, children, low, high = [], [], [], []

    def node(a: int, b: int) -> int:
        me = len(spans)
        rows = vectors[order[a:b]]
        spans.append((a, b))
        children.append((-1, -1))
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        if b - a > leaf:
            side = int((high[me] - low[me]).argmax())
            if high[me][side] > low[me][side]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, side], mid)]
                children[me] = (node(a, a + mid), node(a + mid, b))
        return me

    if len(ids):
        node(0, len(ids))
    dim = vectors.shape[1]
    return {
        "ids": ids[order],
        "vectors": vectors[order],
        "spans": np.array(spans, np.int64).reshape(-1, 2),
        "children": np.array(children, np.int64).reshape(-1, 2),
        "low": np.array(low, np.int64).reshape(-1, dim),
        "high": np.array(high, np.int64).reshape(-1, dim),
    }


def search_tree(tree: dict, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple]]:
    """Per query the (score, -vec_id) of its k best rows in the tree with another id than its own, best first.

    floors: a kth score known from elsewhere; rows below it are not wanted. Nodes are opened best bound first, until
    the best bound is below the kth score so far; a bound equal to it is still opened, for its smaller ids.
    """
    width = max(queries.shape[1], tree["vectors"].shape[1])
    q, vectors, low, high = (
        np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, tree["vectors"], tree["low"], tree["high"])
    )
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    spans, children = tree["spans"].tolist(), tree["children"].tolist()
    out = []
    for i, own in enumerate(ids.tolist()):
        row, best, least = bounds[i].tolist(), [], int(floors[i])
        frontier = [(-row[0], 0)] if row else []
        while frontier:
            bound, at = heappop(frontier)
            if -bound < least:
                break
            left, right = children[at]
            if left >= 0:
                for child in (left, right):
                    if row[child] >= least:
                        heappush(frontier, (-row[child], child))
                continue
            a, b = spans[at]
            scores = vectors[a:b] @ q[i]
            near = np.flatnonzero(scores >= least)
            for s, v in zip(scores[near].tolist(), tree["ids"][a:b][near].tolist(), strict=True):
                if v == own:
                    continue
                if len(best) < k:
                    heappush(best, (s, -v))
                elif (s, -v) > best[0]:
                    heappushpop(best, (s, -v))
                if len(best) == k:
                    least = max(least, best[0][0])
        out.append(sorted(best, reverse=True))
    return out


def _packed(rows: DataFrame, most: int, trees: bool) -> DataFrame:
    """Rows in blocks of `most`, each packed into one value; a block is numbered by its partition and place there."""

    def run(batches):
        from pyspark import TaskContext

        part, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def block():
            dim = max(map(len, vectors))
            matrix = np.zeros((len(ids), dim), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = np.floor(np.asarray(v, np.float64) * 1024)
            key = np.array(ids, np.int64)
            data = pack(**build_tree(key, matrix)) if trees else pack(ids=key, vectors=matrix)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([data], pa.binary())], schema=PACKED)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == most:
                    yield block()
                    part, ids, vectors = part + 1, [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, "part long, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of `vectors` with the highest integer inner product with each row of `queries` (all, if fewer).

    Both have vec_id and embedding; a component x counts as floor(1024 x). Rows of the query's own vec_id are no
    candidates. Ties go to the smaller vec_id. Vectors null or holding null or non-finite components, and rows
    without an id, take no part; an empty vector does (score 0), and of two lengths the shorter is filled with 0.
    A query that occurs twice is answered twice. Empty tables give no rows.

    Rows are packed into shards of SHARD_ROWS with a KD-tree each, queries into blocks of BLOCK_QUERIES. A first
    round searches one shard per block; the kth scores it finds go with the block to all other shards as floors,
    and each shard sends on its k best that reach them. The last merge is by query, in two steps.
    """
    component = F.col("embedding")
    sound = (
        component.isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )

    def clean(df):
        return df.select(
            F.col("vec_id").cast("long").alias("vec_id"), component.cast("array<double>").alias("embedding")
        ).where(sound)

    shards = _packed(clean(vectors), SHARD_ROWS, True)
    blocks = _packed(clean(queries), BLOCK_QUERIES, False)
    shards = written(shards, "kd-shards")
    n_lanes = min(LANES[1], max(LANES[0], -(-shards.count() // LANE_SHARDS)))
    shards = shards.select(F.pmod(F.xxhash64("part"), F.lit(n_lanes)).alias("lane"), "part", "data")
    blocks = written(blocks.select(F.col("part").alias("block"), F.col("data").alias("asked")), "kd-queries")

    def run(batches, floors_given):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                asked = unpack(cols["asked"][r].as_py())
                floors = np.full(len(asked["ids"]), np.iinfo(np.int64).min)
                if floors_given and cols["places"][r].is_valid:
                    floors[np.array(cols["places"][r].as_py(), np.int64)] = cols["floors"][r].as_py()
                found = search_tree(unpack(cols["data"][r].as_py()), asked["ids"], asked["vectors"], k, floors)
                block = cols["block"][r].as_py()
                rows = [(block, i, asked["ids"][i], -v, s) for i, x in enumerate(found) for s, v in x]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FOUND.types, strict=True)], schema=FOUND
                    )

    # One shard for each block: the shard of the smallest number in the block's lane, or else in any.
    lanes = shards.groupBy("lane").agg(F.min("part").alias("part"))
    number = F.row_number().over(Window.orderBy("lane")) - 1  # at most LANES[1] rows
    lanes = lanes.select(number.alias("turn"), "part", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("of"))
    turns = F.broadcast(lanes)
    chosen = blocks.join(turns, F.pmod(F.xxhash64("block"), F.col("of")) == F.col("turn"))
    seeds = (
        chosen.join(shards.select("part", "data"), "part")
        .select("block", "asked", "data")
        .mapInArrow(lambda b: run(b, False), FOUND_DDL)
    )
    floors = (
        seeds.groupBy("block", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
        .where(F.col("n") == k)
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "floor")).alias("f"))  # at most BLOCK_QUERIES entries
        .select("block", F.col("f.place").alias("places"), F.col("f.floor").alias("floors"))
    )
    asked = blocks.join(floors, "block", "left").withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lanes - 1).cast("long")))
    )
    found = (
        asked.join(shards, "lane")
        .select("block", "asked", "data", "places", "floors", "part")
        .mapInArrow(lambda b: run(b, True), FOUND_DDL)
    )
    best = [F.desc("score"), F.asc("vec_id")]
    some = Window.partitionBy("block", "place", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(*best)
    some_kept = found.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k).drop("r")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(*best))
    return (
        some_kept.withColumn("rank", rank.cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_exact_search(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)
