"""Cutoff joins: the theta joins of the engine, as equi-joins on grid cells.

Points are (group_key, frame_index, node, x, y, z, lx, ly, lz); null lengths mean no period.
Between two sets each point goes to its own cell on one side and to the 27 cells around it on the other, so
that candidates meet in a hash or sort join; distances are settled afterwards. Cells are at
least a cutoff wide; in boxes of fewer than three cells a side, wrapped cells count once.

Within one set, points go to their own block of space and to those within reach. A task has all neighbours of a
block's own points at hand, so points are shuffled and never pairs, and what is asked of a
point's neighbours is settled there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.pbc import delta, dot, norm, vec
from latticework.operators.graphs import K

BOX = ["lx", "ly", "lz"]


def _cells(length: Column, cutoff: float) -> Column:
    return F.greatest(F.lit(1), F.floor(length / cutoff)).cast("long")


def _cell(x: Column, length: Column, cutoff: float) -> Column:
    n = _cells(length, cutoff)
    share = x / length - F.floor(x / length)
    return F.when(length.isNull(), F.floor(x / cutoff)).otherwise(F.least(n - 1, F.floor(share * n))).cast("long")


def _around(cell: Column, length: Column, cutoff: float) -> Column:
    open_ = F.array(cell - 1, cell, cell + 1)
    n = _cells(length, cutoff)
    return F.when(length.isNull(), open_).otherwise(F.array_distinct(F.transform(open_, lambda c: F.pmod(c, n))))


def _candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    home = right.select(*K, F.col("node").alias("v"), *[F.col(c).alias(f"v{c}") for c in "xyz"], *[_cell(F.col(c), F.col(f"l{c}"), cutoff).alias(f"c{c}") for c in "xyz"])
    near = left.select(*K, F.col("node").alias("u"), *[F.col(c).alias(f"u{c}") for c in "xyz"], *BOX)
    for c in "xyz":
        near = near.withColumn(f"c{c}", F.explode(_around(_cell(F.col(f"u{c}"), F.col(f"l{c}"), cutoff), F.col(f"l{c}"), cutoff)))
    met = near.join(home, [*K, "cx", "cy", "cz"])
    d = delta(vec("u"), vec("v"), vec("l"))
    return met.select(*K, "u", "v", *[x.alias(f"d{c}") for c, x in zip("xyz", d, strict=True)], *BOX)


#: Width of a block in cutoffs, points held before blocks are settled, own points looked up together in crowded blocks, and pairs tried at a time.
WIDE, POINTS, LEAF, TRIED = 2, 1 << 16, 64, 1 << 19


class Block:
    """Points at hand in a task: columns by name, as arrays, and which of them pairs may begin from."""

    def __init__(self, table: pa.Table, leaf: int = LEAF, tried: int = TRIED) -> None:
        self.table, self.leaf, self.most = table, leaf, tried
        self.node = table.column("node").to_numpy()
        self.at, self.box = (np.column_stack([table.column(c).to_numpy().astype(float) for c in names]) for names in (("x", "y", "z"), BOX))
        self.endless = np.isnan(self.box).any()
        codes = [table.column("group_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), *(table.column(c).to_numpy() for c in ("frame_index", "bx", "by", "bz"))]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in codes]) if table.num_rows else np.zeros(0, bool)
        self.first = np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])
        self.far = table.column("far").to_numpy()

    def keys(self, rows: np.ndarray) -> list[pa.Array]:
        return [self.table.column(c).take(pa.array(rows)).combine_chunks() for c in (*K, "node")]

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Minimum image of the way from the points i to the points j, in the boxes of i."""
        d, box = self.at[j] - self.at[i], self.box[i]
        image = d - box * np.rint(d / box)
        return np.where(np.isnan(box), d, image) if self.endless else image

    def tried(self, cutoff: float, farthest: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of points that may be within the cutoff: i block by block, up to farthest (0: the block's own), all j of an i together."""
        n = np.diff(self.first)
        own = np.add.reduceat(self.far <= farthest, self.first[:-1]) if len(n) else n
        crowded = own * n > self.leaf * self.leaf
        begin = np.flatnonzero((self.far <= farthest) & np.repeat(~crowded, n))
        count, start = np.repeat(n, n)[begin], np.repeat(self.first[:-1], n)[begin]
        upto = np.cumsum(count)
        k = 0
        while k < len(begin):
            cut = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + self.most, side="right")))
            c = count[k:cut]
            yield np.repeat(begin[k:cut], c), np.arange(c.sum()) + np.repeat(start[k:cut] - (np.cumsum(c) - c), c)
            k = cut
        for b in np.flatnonzero(crowded):
            every = np.arange(self.first[b], self.first[b + 1])
            held = [(every[self.far[every] <= farthest], every)]
            while held:
                some, near = held.pop()
                middle = np.full(len(some), some[0])
                place = self.between(middle, some)
                low, high = place.min(0), place.max(0)
                away = np.abs(self.between(np.full(len(near), some[0]), near) - (low + high) / 2)
                box = self.box[some[0]]
                away = np.fmin(away, np.abs(box - away))  # the other way round; NaN without a period
                near = near[(away <= (high - low) / 2 + cutoff * (1 + 1e-9) + 1e-12 * (1 + np.abs(self.at[some[0]]))).all(1)]
                if len(some) > self.leaf:
                    axis = int(np.argmax(high - low))
                    order = np.argsort(place[:, axis], kind="stable")
                    held += [(some[order[len(some) // 2 :]], near), (some[order[: len(some) // 2]], near)]
                    continue
                step = max(1, self.most // max(1, len(near)))
                for k in range(0, len(some), step):
                    yield np.repeat(some[k : k + step], len(near)), np.tile(near, len(some[k : k + step]))


def _dealt(points: DataFrame, cutoff: float, reach: float, extra: tuple[str, ...]) -> DataFrame:
    """Points in every block within reach of them; far is 0 in their own, 1 within a cutoff of it (or so), 2 beyond."""
    width, out = WIDE * cutoff, points.select(*K, "node", "x", "y", "z", *BOX, *extra)
    own, near = F.lit(True), F.lit(True)
    for c in "xyz":
        x, length = F.col(c), F.col(f"l{c}")
        n = F.greatest(F.lit(1), F.floor(length / width)).cast("long")
        share = x / length

        def touched(r: float, x=x, length=length, n=n, share=share) -> Column:
            wide = F.lit(r * (1 + 1e-9)) + F.abs(x) * 1e-14
            open_ = F.sequence(F.floor((x - wide) / width).cast("long"), F.floor((x + wide) / width).cast("long"))
            r = wide / length + 1e-12
            period = F.sequence(F.floor((share - r) * n).cast("long"), F.floor((share + r) * n).cast("long"))
            return F.when(length.isNull(), open_).otherwise(F.array_distinct(F.transform(period, lambda k: F.pmod(k, n))))

        home = F.when(length.isNull(), F.floor(x / width)).otherwise(F.least(n - 1, F.floor((share - F.floor(share)) * n))).cast("long")
        out = out.withColumn(f"b{c}", F.explode(touched(reach)))
        own &= F.col(f"b{c}") == home
        if reach > cutoff:
            near &= F.array_contains(touched(cutoff), F.col(f"b{c}"))
    return out.withColumn("far", F.when(own, 0).when(near, 1).otherwise(2).cast("int"))


def in_blocks(points: DataFrame, cutoff: float, settle: Callable[[Block], Iterator[pa.RecordBatch]], out: str, extra: tuple[str, ...] = (), reach: float | None = None) -> DataFrame:
    """What settle makes of blocks of space, each with all points within reach (the cutoff) of it; some blocks at a time."""

    hold, sizes = POINTS, (LEAF, TRIED)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, due = [], 0, hold
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= due:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(Block(table).first[-2])  # the last block may go on
                if cut:
                    yield from settle(Block(table.slice(0, cut).combine_chunks(), *sizes))
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
                due = max(hold, 2 * rows)
        if rows:
            yield from settle(Block(pa.Table.from_batches(held).combine_chunks(), *sizes))

    order = [*K, "bx", "by", "bz"]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(points, cutoff, reach or cutoff, extra).repartition(parts, *order).sortWithinPartitions(*order, "far").mapInArrow(kernel, out)


def near_pairs(block: Block, cutoff: float, farthest: int = 0, rooted: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d, dist) of a block's neighbours at a distance up to the cutoff (not rooted: at its square), both ways; all of a point together."""
    for i, j in block.tried(cutoff, farthest):
        d = block.between(i, j)
        square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        dist = np.sqrt(square)
        keep = (dist <= cutoff if rooted else square <= cutoff * cutoff) & (block.node[i] != block.node[j])
        yield i[keep], j[keep], d[keep], dist[keep]


_HYDROGENS = tuple(f"h{k}{c}" for k in range(2) for c in "xyz")


def with_hydrogens(waters: DataFrame) -> DataFrame:
    """waters with the parts of their first two hydrogens as columns, null where there is none."""
    return waters.select("*", *[F.get("hydrogens", F.lit(int(n[1])))[n[2]].cast("double").alias(n) for n in _HYDROGENS])


def hydrogens_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(vectors by point, hydrogen and axis; which there are)."""
    columns = [block.table.column(n) for n in _HYDROGENS]
    there = np.column_stack([columns[k].is_valid().to_numpy() for k in (0, 3)])
    return np.column_stack([c.to_numpy() for c in columns]).astype(float).reshape(-1, 2, 3), there


def _pair_schema(points: DataFrame) -> str:
    types = dict(points.dtypes)
    return ", ".join([f"group_key {types['group_key']}, frame_index {types['frame_index']}", *(f"{n} {types['node']}" for n in "uv"), *(f"{n} double" for n in ("dx", "dy", "dz", *BOX, "dist"))])


def _pairs(points: DataFrame, cutoff: float, rooted: bool) -> DataFrame:
    def settle(block: Block) -> Iterator[pa.RecordBatch]:
        for i, j in block.tried(cutoff):
            below = block.node[j] < block.node[i]
            v, u = i[below], j[below]
            d = block.between(u, v)
            square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            dist = np.sqrt(square)
            keep = dist <= cutoff if rooted else square <= cutoff * cutoff
            u, v, d = u[keep], v[keep], d[keep]
            first = block.keys(u)
            box = [pa.array(block.box[u, k], from_pandas=True) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*first, pa.array(block.node[v]), *(pa.array(d[:, k]) for k in range(3)), *box, pa.array(dist[keep])], names=[*K, "u", "v", "dx", "dy", "dz", *BOX, "dist"])

    return in_blocks(points, cutoff, settle, _pair_schema(points))


def self_cutoff_pairs(points: DataFrame, cutoff: float) -> DataFrame:
    """(K, u, v, dx, dy, dz, dist) with u < v and squared distance up to the cutoff's square."""
    return _pairs(points, cutoff, rooted=False)


def cross_cutoff_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """As self_cutoff_pairs, u from left and v from right."""
    return _candidates(left, right, cutoff).where(dot(vec("d"), vec("d")) <= cutoff * cutoff).withColumn("dist", norm(vec("d")))


def oo_edges(waters: DataFrame, cutoff: float = 0.35) -> DataFrame:
    """Edges between waters at a distance (after the square root) up to the cutoff."""
    return _pairs(waters, cutoff, rooted=True)


def degrees_within(points: DataFrame, cutoff: float, around: bool = False) -> DataFrame:
    """(K, node, degree): numbers of points at a distance (after the square root) up to the cutoff, but for those without any.

    around: numbers of those neighbours whose column begins is true, in parts to be added up.
    """

    def settle(block: Block) -> Iterator[pa.RecordBatch]:
        if around:
            block.far = np.where(block.table.column("begins").to_numpy(), block.far, 3)
        for i, j, _, _ in near_pairs(block, cutoff):
            rows, counts = np.unique(j if around else i, return_counts=True)
            yield pa.RecordBatch.from_arrays([*block.keys(rows), pa.array(counts, pa.int64())], names=[*K, "node", "degree"])

    schema = ", ".join([*(f"{c} {dict(points.dtypes)[c]}" for c in (*K, "node")), "degree bigint"])
    return in_blocks(points, cutoff, settle, schema, ("begins",) if around else ())


def hbond_edges(waters: DataFrame, cutoff: float = 0.35, angle: float = 30.0) -> DataFrame:
    """Edges up to the cutoff where one end donates: an O-H vector within the angle of the O-O vector.

    waters also have hydrogens, an array of struct<x, y, z> O-H vectors, of which the first
    two count.
    """
    limit = math.cos(math.radians(angle))

    def settle(block: Block) -> Iterator[pa.RecordBatch]:
        h, there = hydrogens_of(block)
        size = np.sqrt(h[..., 0] * h[..., 0] + h[..., 1] * h[..., 1] + h[..., 2] * h[..., 2])
        at_least = lambda x, y: (x >= y) | np.isnan(x)  # noqa: E731  # NaN is above all, as in SQL
        for v, u, back, dist in near_pairs(block, cutoff):
            below = block.node[u] < block.node[v]
            u, v, d, dist = u[below], v[below], -back[below], dist[below]
            bound = np.zeros(len(u), dtype=bool)
            for end, sign in ((u, 1), (v, -1)):
                for k in range(2):
                    along = (h[end, k, 0] * d[:, 0] + h[end, k, 1] * d[:, 1] + h[end, k, 2] * d[:, 2]) * sign
                    bound |= there[end, k] & (at_least(size[end, k], 1e-12) & (size[end, k] != 1e-12)) & at_least(along, dist * size[end, k] * limit)
            u, v, d, dist = u[bound], v[bound], d[bound], dist[bound]
            box = [pa.array(block.box[u, k], from_pandas=True) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*block.keys(u), pa.array(block.node[v]), *(pa.array(d[:, k]) for k in range(3)), *box, pa.array(dist)], names=[*K, "u", "v", "dx", "dy", "dz", *BOX, "dist"])

    return in_blocks(with_hydrogens(waters), cutoff, settle, _pair_schema(waters), _HYDROGENS)
