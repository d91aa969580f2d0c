"""Connected components by alternating large-star and small-star contraction.

Before each round every task contracts the edges it holds, at most about ``TASK_EDGES``; once
all that are left fit one task, that settles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint, give_back

#: Edges that a task contracts.
TASK_EDGES = 100_000


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each task's edges as stars on the smallest node of each of their components."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        stars = np.array([(x, top(x)) for x in root if top(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])
        root.clear()
        give_back()

    return edges.coalesce(tasks).mapInArrow(kernel, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, with its smaller neighbours, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Self-loops and repeated edges count once; null ends are dropped; no edges, no rows.
    Both stars only use grouped minima and equi-joins, so that a hub's rows are summed
    before the shuffle and its join partitions can be split.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        tasks = -(-state[0] // TASK_EDGES)
        now = checkpoint(_contracted(now, tasks))
        if tasks == 1:
            break
        now = checkpoint(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
