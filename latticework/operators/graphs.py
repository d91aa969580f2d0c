"""Graph operators over (group_key, frame_index, u, v) edges of all frames at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.checkpoints import checkpoint

K = ["group_key", "frame_index"]


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """(K, a, b) for both directions of every edge."""
    return _swapped(edges, "u", "v", *extra)


def _swapped(edges: DataFrame, a: str, b: str, *extra: str) -> DataFrame:
    """Both directions in one pass; a union would read the edges twice."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))
    return edges.select(*K, ends.alias("_e"), *extra).select(*K, "_e.a", "_e.b", *extra)


def canonical_edges(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Distinct undirected edges, smaller end first, no self-loops."""
    return pairs.select(*K, F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(K, node, neighbors): sorted; isolated nodes have an empty array."""
    found = both_ways(edges).groupBy(*K, F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("neighbors"))
    return nodes.select(*K, "node").join(found, [*K, "node"], "left").withColumn("neighbors", F.coalesce("neighbors", F.expr("array()").cast("array<bigint>")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = both_ways(edges).groupBy(*K, F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select(*K, "node").join(found, [*K, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours above (large) or at and below (small) a node move to the least of its neighbourhood."""
    if large:
        two = _swapped(edges, "a", "b")
        least = two.groupBy(*K, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return two.where("b > a").join(least, [*K, "a"]).select(*K, F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy(*K, "a").agg(F.min("b").alias("m"))
    moved = F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return edges.join(least, [*K, "a"]).select(*K, moved.alias("_e")).select(*K, "_e.a", "_e.b").where("a <> b")


#: Nodes that a task holds while it contracts edges before the first shuffle.
HELD = 2_000_000


def _tops(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of edges, but for those that are the least themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    top = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(top, high[open_], low[open_])
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _stars(table: pa.Table) -> pa.Table:
    """(K, a, b) of the same schema: the components of the edges, frame by frame."""
    group = pc.fill_null(pc.dictionary_encode(table.column("group_key").combine_chunks(), null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    frame = table.column("frame_index").to_numpy()
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    order = np.lexsort((frame, group))
    group, frame, a, b = group[order], frame[order], a[order], b[order]
    first = np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(frame) != 0)) + 1])
    made = [(order[i], *_tops(a[i:j], b[i:j])) for i, j in zip(first, [*first[1:], len(a)], strict=True)]
    keys = table.select(K).take(pa.array(np.repeat([m[0] for m in made], [len(m[1]) for m in made])))
    columns = [*keys.columns, *(pa.array(np.concatenate([m[k] for m in made]), pa.int64()) for k in (1, 2))]
    return pa.Table.from_arrays(columns, names=table.schema.names).cast(table.schema)


def _contract(edges: DataFrame) -> DataFrame:
    """(K, a, b): each partition's edges as stars on the least node; about HELD nodes are held at a time."""

    held = HELD

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = 0, []
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows > held:
                made = _stars(pa.Table.from_batches(parts))
                if 2 * made.num_rows > held:
                    yield from made.to_batches()
                    parts = []
                else:
                    parts = made.to_batches()
                rows = sum(p.num_rows for p in parts)
        if rows:
            yield from _stars(pa.Table.from_batches(parts)).to_batches()

    return edges.mapInArrow(kernel, edges.schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(K, node, component): component is the least node that edges reach; isolated nodes are their own.

    Alternating star contraction over all frames at once: rounds grow with the logarithm
    of the largest component. Once no more edges are left than a task may hold, one task
    settles them; until then no component is gathered in one place.
    """
    loops_left_out = edges.select(*K, F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b")
    now = checkpoint(_contract(loops_left_out).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*K, "a", "b"))).first())
    before = None
    while (state := mark(now)) != before and state[0]:
        if state[0] <= HELD // 2:
            now = _contract(now.coalesce(1))
            break
        before = state
        now = checkpoint(_star(_star(now, large=True).distinct(), large=False).distinct())
    tops = now.select(*K, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select(*K, "node").join(tops, [*K, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def _cored(table: pa.Table) -> pa.Table:
    """The edges of (K, u, v) that are left when nodes with one edge are peeled off, frame by frame."""
    coded = lambda *names: pc.dictionary_encode(pa.concat_arrays([c for n in names for c in table.column(n).chunks]), null_encoding="encode").indices.to_numpy().astype(np.int64)
    n = table.num_rows
    ends = np.column_stack([np.tile(coded("group_key"), 2), np.tile(coded("frame_index"), 2), coded("u", "v")])
    order = np.lexsort(ends.T[::-1])
    code = np.empty(2 * n, dtype=np.int64)
    code[order] = np.cumsum(np.concatenate([[0], (np.diff(ends[order], axis=0) != 0).any(1)]))
    by, degree = np.argsort(code, kind="stable") % n, np.bincount(code)
    first = np.cumsum(degree) - degree
    u, v, count, left = code[:n], code[n:], degree.copy(), np.ones(n, dtype=bool)
    weak = np.flatnonzero(count == 1)
    while len(weak):  # only what hangs on nodes just peeled is looked at again
        at = np.arange(degree[weak].sum()) + np.repeat(first[weak] - (np.cumsum(degree[weak]) - degree[weak]), degree[weak])
        gone = np.unique(by[at])
        gone = gone[left[gone]]
        left[gone] = False
        near = np.concatenate([u[gone], v[gone]])
        np.subtract.at(count, near, 1)
        near = np.unique(near)
        weak = near[count[near] == 1]
    return table.filter(pa.array(left))


def two_core(edges: DataFrame) -> DataFrame:
    """Edges that remain when nodes of degree one are taken away again and again.

    Once no more edges are left than a task may hold, one task settles them.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from _cored(pa.Table.from_batches(held)).to_batches()

    now = checkpoint(edges.select(*K, "u", "v"))
    while True:
        if now.count() <= HELD // 2:
            return now.coalesce(1).mapInArrow(kernel, now.schema)
        weak = checkpoint(both_ways(now).groupBy(*K, F.col("a").alias("node")).count().where("count < 2").drop("count"))
        if weak.isEmpty():
            return now
        for end in "uv":
            now = now.join(weak.withColumnRenamed("node", end), [*K, end], "left_anti")
        now = checkpoint(now)


def core_within(points: DataFrame, cutoff: float) -> DataFrame:
    """(K, u, v): two_core of all points at a distance up to the cutoff.

    Points are peeled off by their numbers of neighbours, so edges are neither stored nor shuffled until few are left;
    after the first search only what is near the points just peeled is searched again.
    """
    from latticework.operators import neighbors

    now, found = points, checkpoint(neighbors.degrees_within(points, cutoff))
    while True:
        weak, ends = found.agg(F.count_if(F.col("degree") == 1), F.sum("degree")).first()
        if not weak or ends <= HELD:
            edges = neighbors.oo_edges(now, cutoff).select(*K, "u", "v")
            return two_core(edges) if weak else edges
        marked = now.join(found.select(*K, "node", (F.col("degree") == 1).alias("begins")), [*K, "node"])
        lost = neighbors.degrees_within(marked, cutoff, around=True).groupBy(*K, "node").agg(F.sum("degree").alias("lost"))
        found = found.where("degree > 1").join(lost, [*K, "node"], "left").select(*K, "node", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree"))
        found = checkpoint(found.where("degree > 0"))
        now = checkpoint(now.join(found.select(*K, "node"), [*K, "node"], "left_semi"))


def largest_component(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(K, size, members): the largest component of each frame; of equal ones that of the least node."""
    keys = keys or K
    sizes = labels.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*keys).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"), F.max("size").alias("size"))
    members = labels.join(best, [*keys, "component"]).groupBy(*keys, "size").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return members.select(*keys, "size", "members")


def joined(values: Column | str) -> Column:
    """An array as text, elements parted by blanks."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")) if isinstance(values, Column) else F.transform(F.col(values), lambda x: x.cast("string")), " ")
