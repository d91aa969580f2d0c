"""Bounded rings by search in pieces of the graph.

A ring's least node is its start; no node of a ring of n is farther from it than n // 2
steps. Starts are dealt out by blocks of node numbers, and a block is sent the neighbours of
all nodes within (n - 1) // 2 steps of its starts, which are all edges and chords that its rings
can have. There paths grow node by node, many at a time: a step that meets a neighbour of an inner
node would have a chord; one that meets a neighbour of the start closes a ring. What is shuffled
are neighbourhoods and rings, never paths, and the paths held at a time are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.pbc import delta, vec
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, both_ways

SIZES = (4, 5, 6)
#: Node numbers that are starts in one block, starts searched at a time, steps tried at a time, and nodes up to which a block has a table of its edges.
BLOCK, STARTS, STEPS, TABLE = 1024, 256, 1 << 18, 6000
#: Neighbours up to which a task searches small blocks of a frame together, and cells of a table of steps held at a time.
TOGETHER, CELLS = 1 << 14, 1 << 22


def _neighbor_arrays(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(*K, F.col("a").alias("last")).agg(F.array_sort(F.collect_set("b")).alias("around"))


def _graph(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """(ids, first, to, linked) of rows of (nodes, numbers of neighbours, neighbours): both ways of every edge, by places in the sorted ids."""
    here = np.concatenate([np.repeat(n, k) for n, k, _ in rows])
    there = np.concatenate([x for _, _, x in rows])
    ids = np.unique(np.concatenate([here, there]))
    n = len(ids)
    a, b = np.searchsorted(ids, here), np.searchsorted(ids, there)
    keys = np.unique(np.concatenate([a * n + b, b * n + a]))
    first = np.searchsorted(keys, np.arange(n + 1) * n)
    if n <= TABLE:
        table = np.zeros(n * n, dtype=bool)
        table[keys] = True
        return ids, first, keys % n, lambda x, y: table[x * n + y]

    def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * n + y
        return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key

    return ids, first, keys % n, linked


def _onward(at: np.ndarray, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, next) of every step from the places at."""
    count = first[at + 1] - first[at]
    row = np.repeat(np.arange(len(at)), count)
    return row, to[np.arange(len(row)) + np.repeat(first[at] - (np.cumsum(count) - count), count)]


def _search(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], starts: np.ndarray, sizes: tuple[int, ...], chordless: bool) -> Iterator[np.ndarray]:
    """Rings with these starts, as arrays with a ring a line, some at a time."""
    ids, first, to, linked = _graph(rows)
    most = max(sizes)
    starts = np.searchsorted(ids, starts)
    for k in range(0, len(starts), STARTS):
        some = starts[k : k + STARTS]
        one = np.zeros((len(some), len(ids)), dtype=bool)
        row, near = _onward(some, first, to)
        one[row, near] = True
        two = np.zeros_like(one)
        upto, k0 = np.cumsum(first[near + 1] - first[near]), 0
        while k0 < len(near):
            cut = max(k0 + 1, int(np.searchsorted(upto, (upto[k0 - 1] if k0 else 0) + STEPS, side="right")))
            step, far = _onward(near[k0:cut], first, to)
            two[row[k0:cut][step], far] = True
            k0 = cut
        held = [(np.arange(len(some)), some[:, None])]
        while held:
            own, paths = held.pop()
            steps = np.cumsum(first[paths[:, -1] + 1] - first[paths[:, -1]])
            if steps[-1] > STEPS and len(own) > 1:  # the last pieces first, so that few are held
                cut = min(max(1, int(np.searchsorted(steps, STEPS))), len(own) - 1)
                held += [(own[cut:], paths[cut:]), (own[:cut], paths[:cut])]
                continue
            size = paths.shape[1] + 1
            row, new = _onward(paths[:, -1], first, to)
            keep = new > paths[row, 0]
            if size == most:
                keep &= one[own[row], new]
            elif size == most - 1:  # one more node has to lead back
                keep &= two[own[row], new] | one[own[row], new]
            row, new = row[keep], new[keep]
            for j in range(1, size - 1):
                keep = paths[row, j] != new
                if chordless and j < size - 2:
                    keep &= ~linked(paths[row, j], new)
                row, new = row[keep], new[keep]
            closes = one[own[row], new] if size > 2 else np.zeros(len(new), dtype=bool)
            if size in sizes:
                ring = closes & (paths[row, 1] < new)
                if ring.any():
                    yield ids[np.column_stack([paths[row[ring]], new[ring]])]
            if chordless:
                row, new = row[~closes], new[~closes]
            if size < most and len(new):
                held.append((own[row], np.column_stack([paths[row], new])))


def _on_six(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], starts: np.ndarray) -> np.ndarray:
    """The starts that lie on a chordless ring of six; a start's search ends with its first ring.

    A ring is start, a, c, d, e, b. For two neighbours a and b of the start, c and e are what may follow them, and
    d what both may meet: a product of tables tells all c and e with a d between, so no paths are listed.
    """
    ids, first, to, linked = _graph(rows)
    far = lambda x, *others: np.logical_and.reduce([~linked(x, y) for y in others])

    def ring(v: int, a: int, b: int) -> bool:
        ends = []
        for p, q in ((a, b), (b, a)):
            after = to[first[p] : first[p + 1]]
            after = after[(after != v) & far(after, v, q)]
            row, new = _onward(after, first, to)
            keep = far(new, v, a, b)
            ends.append((after, row[keep], new[keep]))
        (c, c_row, c_new), (e, e_row, e_new) = ends
        middle = np.intersect1d(c_new, e_new)
        if not len(middle):
            return False
        some, wide = max(1, CELLS // len(c)), max(1, CELLS // len(middle))
        for k in range(0, len(e), min(some, wide)):
            own = slice(k, k + min(some, wide))
            met = np.zeros((len(c), len(e[own])), dtype=bool)
            step = max(1, CELLS // max(len(c), len(e[own])))
            for m in range(0, len(middle), step):
                part = middle[m : m + step]
                tables = []
                for n, row, new, low in ((len(c), c_row, c_new, 0), (len(e[own]), e_row, e_new, k)):
                    at = np.minimum(np.searchsorted(part, new), len(part) - 1)
                    keep = (part[at] == new) & (row >= low) & (row < low + n)
                    table = np.zeros((n, len(part)), dtype=np.float32)
                    table[row[keep] - low, at[keep]] = 1.0
                    tables.append(table)
                met |= tables[0] @ tables[1].T > 0
            one, two = np.nonzero(met)
            if len(one) and not linked(c[one], e[own][two]).all():
                return True
        return False

    found = []
    for v in np.searchsorted(ids, starts).tolist():
        near = to[first[v] : first[v + 1]].tolist()
        if any(not linked(a, b) and ring(v, a, b) for a, b in combinations(near, 2)):
            found.append(v)
    return ids[np.array(found, dtype=np.int64)]


def _blocks(around: DataFrame, hops: int, starts: Column | None = None) -> DataFrame:
    """(K, block, last, around, start): what lies within so many steps of a block's starts; whether a node is one of those.

    starts tells which nodes are starts; all are without it.
    """
    block = F.floor(F.col("last") / BLOCK).cast("long")
    edge = around.where(F.lit(True) if starts is None else starts).select(*K, block.alias("block"), "last", F.lit(True).alias("start"), "around")
    reached = edge.select(*K, "block", "last", "start")
    for _ in range(hops):
        more = edge.select(*K, "block", F.explode("around").alias("last"), F.lit(False).alias("start"))
        reached = reached.unionByName(more).groupBy(*K, "block", "last").agg(F.max("start").alias("start"))
        edge = reached.join(around, [*K, "last"])
    return edge.select(*K, "block", "last", "start", "around")


def _by_block(blocks: DataFrame, close: Callable[[tuple, list, np.ndarray], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """What close(key, rows, starts) makes of the blocks; those of a frame that follow each other go together up to TOGETHER neighbours."""
    together = TOGETHER

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, starts, held = None, [], [], 0
        for batch in batches:
            last, start = batch.column("last").to_numpy(), batch.column("start").to_numpy(zero_copy_only=False)
            lists = batch.column("around")
            ends, flat = np.asarray(lists.offsets), lists.values.to_numpy()
            block, frame, group = batch.column("block").to_numpy(), batch.column("frame_index").to_numpy(), batch.column("group_key")
            codes = pc.dictionary_encode(group)
            code = codes.indices.to_numpy()
            turns = np.flatnonzero((np.diff(block) != 0) | (np.diff(frame) != 0) | (np.diff(code) != 0)) + 1
            bounds = [0, *turns.tolist(), batch.num_rows] if batch.num_rows else [0]
            for i, j in zip(bounds, bounds[1:], strict=False):
                now = (group[i].as_py(), int(frame[i]), int(block[i]))
                if now != key:
                    if rows and (now[:2] != key[:2] or held > together):
                        yield from close(key, rows, np.concatenate(starts))
                        rows, starts, held = [], [], 0
                    key = now
                rows.append((last[i:j].copy(), np.diff(ends[i : j + 1]), flat[ends[i] : ends[j]].copy()))
                starts.append(last[i:j][start[i:j]])
                held += int(ends[j] - ends[i])
        if rows:
            yield from close(key, rows, np.concatenate(starts))

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*K, "block"]
    return blocks.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(kernel, out)


def on_six_rings(edges: DataFrame, degree: int = 4) -> DataFrame:
    """(K, node): nodes with so many neighbours that lie on a chordless ring of six; rings are not listed."""

    def close(key: tuple, rows: list, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = _on_six(rows, starts)
        columns = [pa.array([key[0]] * len(found), pa.string()), pa.array(np.full(len(found), key[1], dtype=np.int32)), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*K, "node"])

    blocks = _blocks(_neighbor_arrays(edges), 2, F.size("around") == degree)
    return _by_block(blocks, close, "group_key string, frame_index int, node bigint")


def find_rings(edges: DataFrame, sizes: tuple[int, ...] = SIZES, chordless: bool = True, shortest: bool = False) -> DataFrame:
    """(K, ring_id, size, nodes): rings in canonical form (least node first, smaller neighbour second).

    shortest keeps rings in which no two nodes are closer in the graph than along the ring.
    """
    sizes = tuple(sorted({n for n in sizes if n >= 3}))
    out = "group_key string, frame_index int, size int, nodes array<bigint>"

    def close(key: tuple, rows: list, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found in _search(rows, starts, sizes, chordless) if sizes else ():
            n, size = found.shape
            ends = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32))
            columns = [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], dtype=np.int32)), pa.array(np.full(n, size, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["group_key", "frame_index", "size", "nodes"])

    blocks = _blocks(_neighbor_arrays(edges), (max(sizes, default=3) - 1) // 2)
    rings = _by_block(blocks, close, out)
    if shortest:
        rings = _shortest(checkpoint(rings), edges)
    order = Window.partitionBy(*K, "size").orderBy("nodes")
    number = F.row_number().over(order)
    return rings.select(*K, F.format_string("ring%d_%05d", "size", number).alias("ring_id"), F.col("size").cast("int").alias("size"), "nodes")


def _shortest(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """Without rings that a common neighbour of two nodes three steps apart shortens."""
    pair = F.expr("filter(flatten(transform(nodes, (a, i) -> transform(nodes, (b, j) -> struct(a, b, j - i AS gap)))), p -> p.gap = 3 OR (p.gap > 3 AND size - p.gap = 3))")
    far = rings.where("size >= 6").withColumn("p", F.explode(pair)).select(*K, "size", "nodes", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    way = both_ways(edges)
    two = far.join(way.select(*K, "a", F.col("b").alias("mid")), [*K, "a"]).join(way.select(*K, F.col("a").alias("mid"), "b"), [*K, "mid", "b"], "left_semi")
    return rings.join(two.select(*K, "size", "nodes").distinct(), [*K, "size", "nodes"], "left_anti")


def ring_edges(rings: DataFrame) -> DataFrame:
    """(K, ring_id, size, u, v): each side of each ring, smaller node first."""
    sides = F.expr("transform(nodes, (a, i) -> struct(a AS p, get(nodes, pmod(i + 1, size(nodes))) AS q))")
    out = rings.withColumn("side", F.explode(sides))
    return out.select(*K, "ring_id", "size", F.least("side.p", "side.q").alias("u"), F.greatest("side.p", "side.q").alias("v"))


def ring_nodes(rings: DataFrame) -> DataFrame:
    return rings.select(*K, "ring_id", "size", F.posexplode("nodes").alias("place", "node"))


def ring_centers(rings: DataFrame, points: DataFrame) -> DataFrame:
    """(K, ring_id, size, cx, cy, cz): mean of the nodes, unwrapped step by step along the ring."""
    places = ring_nodes(rings).join(points, [*K, "node"])
    walk = Window.partitionBy(*K, "ring_id").orderBy("place")
    back = {c: F.lag(c).over(walk) for c in "xyz"}
    moved = places.select("*", *[back[c].alias(f"b{c}") for c in "xyz"])
    steps = delta(vec("b"), vec(""), vec("l"))
    sums = moved.select("*", *[F.coalesce(s, F.lit(0.0)).alias(f"s{c}") for c, s in zip("xyz", steps, strict=True)])
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    whole = sums.select(*K, "ring_id", "size", *[(F.first(c).over(upto) + F.sum(f"s{c}").over(upto)).alias(c) for c in "xyz"])
    return whole.groupBy(*K, "ring_id", "size").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])


def free_rings(rings: DataFrame, used: DataFrame) -> DataFrame:
    """Rings of no patch and no detected cage; used is (K, ring_id)."""
    return rings.join(used.select(*K, "ring_id"), [*K, "ring_id"], "left_anti")
