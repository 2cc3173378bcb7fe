"""Connected components of an edge table: union-find within partitions, then a shuffle, until each node has one parent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lanes, written

#: Edges that a lane holds at once, about.
LANE_EDGES = 1 << 19
STARS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) that aren't the smallest of their component, and that smallest node of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _starred(table: pa.Table) -> pa.Table:
    """A lane's edges as stars; open: a node of it came with several parents, which others have yet to hear of."""
    given = np.unique(np.stack([table["a"].to_numpy(), table["b"].to_numpy()], axis=1), axis=0)
    several = bool((given[1:, 0] == given[:-1, 0]).any())
    a, b = stars(given[:, 0], given[:, 1])
    return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), several))], schema=STARS)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node that has an edge (a, b) to another.

    Edges go to the lane of their larger end, which joins all it has and gives each node its smallest. Where a node
    had several parents there, these are joined in the next round; a round without any leaves a forest, whose paths are
    then halved until they end. A node comes to its lane at most once for each lane of the round before, so one with
    very many neighbours, which is the smaller end of most of them, needs no more memory there than another. The number
    of lanes follows the number of edges. `edges` is read twice, so it should be a written table.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    count = now.count()
    for _ in range(most_rounds):
        lane = F.pmod(F.xxhash64("a"), F.lit(lanes(count, LANE_EDGES)))
        starred = now.groupBy(lane.alias("lane")).applyInArrow(_starred, "a long, b long, open boolean")
        after = written(starred, "component-edges")
        now = after.select("a", "b")
        open_, count = after.agg(F.max("open"), F.count(F.lit(1))).first()
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    for _ in range(most_rounds):
        up = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        open_ = F.col("c").isNotNull().alias("open")
        after = written(now.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), open_), "component-paths")
        now = after.select("a", "b")
        if not after.agg(F.max("open")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.union(roots)
