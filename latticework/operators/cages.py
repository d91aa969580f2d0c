"""Closed cages of rings: exact shell search, identity, isomers, occupancy, clusters and phase evidence."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.pbc import cross, delta, dot, norm, vec
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, components
from latticework.operators.neighbors import cross_cutoff_pairs
from latticework.operators.rings import ring_edges

MAX_FACES = 20
# Names of cage types by their faces of four, five and six.
NAMES = {(0, 12, 0): "512", (0, 12, 2): "51262", (0, 12, 3): "51263", (0, 12, 4): "51264", (0, 12, 8): "51268", (3, 6, 3): "435663"}
# Groups of cage types by the name under which a report asks for them.
GROUPS = {
    "I": ("512", "51262"), "II": ("512", "51264"), "H": ("512", "51268", "435663"), "HS-I": ("512", "51262", "51263"), "TS-I": ("512", "51262", "51263"), "I2II": ("51263",),
}
# Isomer labels by the sorted degrees of the graph of touching six-faces.
ISOMERS = {
    "0": "6single", "11": "6adj", "110": "6pair+single", "211": "6chain3", "222": "6tri3", "1100": "6pair+2single", "1111": "2x6pair", "2110": "6chain3+single",
    "3111": "6star3", "2211": "6chain4", "2220": "6tri3+single", "2222": "6cycle4", "3221": "6tri3+tail", "3322": "6K4-e", "3333": "6K4",
}
# Ideal neighbours, as type and face size, of each cage type in the three phases.
TEMPLATES = {
    ("sI", "512"): {("51262", 5): 12},
    ("sI", "51262"): {("512", 5): 4, ("51262", 5): 8, ("51262", 6): 2},
    ("sII", "512"): {("512", 5): 6, ("51264", 5): 6},
    ("sII", "51264"): {("512", 5): 12, ("51264", 6): 4},
    ("sH", "512"): {("512", 5): 4, ("435663", 5): 4, ("51268", 5): 4},
    ("sH", "435663"): {("435663", 4): 3, ("512", 5): 6, ("51268", 6): 3},
    ("sH", "51268"): {("512", 5): 12, ("435663", 6): 6, ("51268", 6): 2},
}


def type_name(four: int, five: int, six: int) -> str:
    plain = "-".join(f"{n}^{k}" for n, k in ((4, four), (5, five), (6, six)) if k)
    return NAMES.get((four, five, six), plain)


def face_counts(label: str) -> tuple[int, int, int]:
    """Faces of four, five and six of a cage type: a name such as 51262, counts such as 1-10-2, or faces such as 4^1-5^10-6^2."""
    text = label.strip()
    for counts, name in NAMES.items():
        if text == name:
            return counts
    parts = [x.strip() for x in text.replace("_", "-").split("-") if x.strip()]
    if len(parts) == 3 and all(x.isdigit() for x in parts):
        return int(parts[0]), int(parts[1]), int(parts[2])
    found = dict.fromkeys((4, 5, 6), 0)
    for part in parts:
        size, mark, count = part.partition("^")
        if not mark or not size.isdigit() or not count.isdigit() or int(size) not in found:
            raise ValueError(f"no cage type: {label!r}; use a name such as 51268 or faces such as 4^1-5^10-6^2")
        found[int(size)] = int(count)
    if not parts:
        raise ValueError("an empty cage type")
    return found[4], found[5], found[6]


def report_types(wanted: str | Iterable[str], sizes: Iterable[int] = (4, 5, 6), max_faces: int = 20) -> tuple[str, ...] | None:
    """Cage types of a list of groups and types; None, for all of them, if it is auto or all."""
    items = [x.strip() for x in (wanted.split(",") if isinstance(wanted, str) else map(str, wanted)) if x.strip()]
    if not items:
        raise ValueError("a report needs at least one cage type")
    if {x.lower() for x in items} & {"auto", "all"}:
        if len(items) > 1:
            raise ValueError("auto and all stand alone")
        return None
    out: list[str] = []
    for item in items:
        for label in GROUPS.get(item.upper(), (item,)):
            counts = face_counts(label)
            if absent := [n for n, k in zip((4, 5, 6), counts, strict=True) if k and n not in set(sizes)]:
                raise ValueError(f"cage type {label} needs rings of {absent}, which are not searched")
            if sum(counts) > max_faces:
                raise ValueError(f"cage type {label} has more than {max_faces} faces")
            if (name := type_name(*counts)) not in out:
                out.append(name)
    return tuple(out)


def reported(cages: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    """Cages of the types that a report shows; what is found, shared and free does not depend on them."""
    return cages if types is None else cages.where(F.col("cage_type").isin(*types))


class SearchLimitError(RuntimeError):
    """A search that met its guard; no part of its result may be used."""


def closed_shells(rings: list[tuple[int, ...]], max_faces: int = MAX_FACES, seeds: list[int] | None = None, max_states: int = 0) -> Iterator[tuple[int, ...]]:
    """Sets of rings (as sorted positions) that close into trivalent polyhedra of 4-, 5- and 6-faces.

    Rings come in canonical order. A shell is grown from its first ring, which is one of
    seeds, on the open side with the fewest rings that still fit; each set of faces is
    visited once. max_states, if not 0, bounds the sets that a seed may visit.
    """
    sides = [[(min(a, b), max(a, b)) for a, b in zip(r, (*r[1:], r[0]), strict=True)] for r in rings]
    by_side: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, own in enumerate(sides):
        for side in own:
            by_side[side].append(k)
    most = {4: 6, 5: 12, 6: max_faces}
    for seed in range(len(rings)) if seeds is None else seeds:
        if any(len(by_side[s]) < 2 for s in sides[seed]):
            continue
        seen: set[frozenset[int]] = set()
        stack: list[frozenset[int]] = [frozenset((seed,))]
        while stack:
            faces = stack.pop()
            if faces in seen:
                continue
            seen.add(faces)
            if max_states and len(seen) > max_states:
                raise SearchLimitError(f"more than {max_states} sets of faces from one ring")
            used = Counter(s for f in faces for s in sides[f])
            corners = Counter(n for f in faces for n in rings[f])
            sizes = Counter(len(rings[f]) for f in faces)

            def fits(k: int, faces=faces, used=used, corners=corners, sizes=sizes) -> bool:
                return k > seed and k not in faces and sizes[len(rings[k])] < most[len(rings[k])] and all(used[s] < 2 for s in sides[k]) and all(corners[n] < 3 for n in rings[k])

            options = None
            for side, n in used.items():
                if n == 1:
                    found = [k for k in by_side[side] if fits(k)]
                    if options is None or len(found) < len(options):
                        options = found
                        if not found:
                            break
            if options is None:
                if _polyhedron(faces, used, corners, sizes):
                    yield tuple(sorted(faces))
            elif len(faces) < max_faces:
                stack += [faces | {k} for k in reversed(options)]


def _polyhedron(faces: frozenset[int], used: Counter, corners: Counter, sizes: Counter) -> bool:
    """Of a connected set whose every side has two faces: trivalent, spherical, and of a possible composition."""
    return all(n == 3 for n in corners.values()) and len(corners) - len(used) + len(faces) == 2 and sizes[5] == 12 - 2 * sizes[4]


#: Rings up to which a component's shells are kept for others of the same form, and components that a worker keeps.
FORM_RINGS, FORMS = 64, 4096
_FORMS: dict[tuple, list] = {}


def _shells(rings: list[tuple[int, ...]], seeds: list[int], max_faces: int, max_states: int) -> list[tuple[str, list[int], tuple[int, ...]]]:
    """(type, waters, positions of the rings) of closed_shells; of shells with the same type and waters the first.

    What is found depends on the order of the waters alone, so a small component that has the
    form of another one, its waters told by their ranks, is not searched again.
    """
    small = len(rings) <= FORM_RINGS
    if small:
        names = sorted({n for r in rings for n in r})
        rank = {n: k for k, n in enumerate(names)}
        rings = [tuple([rank[n] for n in r]) for r in rings]
        form = (tuple(rings), tuple(seeds), max_faces, max_states)
    made = _FORMS.get(form) if small else None
    if made is None:
        found: dict[tuple, tuple] = {}
        for shell in closed_shells(rings, max_faces, seeds, max_states):
            sizes = Counter(len(rings[k]) for k in shell)
            waters = tuple(sorted({n for k in shell for n in rings[k]}))
            found.setdefault((type_name(sizes[4], sizes[5], sizes[6]), waters), shell)
        made = [(kind, waters, shell) for (kind, waters), shell in found.items()]
        if small:
            if len(_FORMS) >= FORMS:
                _FORMS.clear()
            _FORMS[form] = made
    return [(kind, [names[n] for n in waters] if small else list(waters), shell) for kind, waters, shell in made]


#: Rings of a connected component that one task searches whole; larger ones are cut into blocks.
BLOCK_RINGS = 20_000


#: Rings of a component whose adjacency one task holds, as numbers, to find what surrounds its blocks; beyond it the steps are joins.
RIM_RINGS = 1_000_000


def _rims(seeds: DataFrame, near: DataFrame, steps: int) -> DataFrame:
    """(K, component, block, node): the seeds(K, component, block, node) of each block and all nodes within so many steps over near(K, node, next)."""
    group = [*K, "component"]
    links = near.join(seeds.select(*group, "node"), [*K, "node"]).select(*group, F.lit(0).alias("kind"), F.col("node").alias("p"), F.col("next").alias("q"))
    both = links.unionByName(seeds.select(*group, F.lit(1).alias("kind"), F.col("block").alias("p"), F.col("node").alias("q")))

    def around(key: tuple, links: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = np.unique(own[:, 1])
        at, to = np.searchsorted(nodes, links[:, 0]), np.searchsorted(nodes, links[:, 1])
        order = np.argsort(at, kind="stable")
        to, first = to[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(nodes)))])
        for block in np.unique(own[:, 0]).tolist():
            rim = np.searchsorted(nodes, own[own[:, 0] == block, 1])
            seen = np.zeros(len(nodes), bool)
            seen[rim] = True
            for _ in range(steps):
                n = first[rim + 1] - first[rim]
                reach = np.unique(to[np.arange(n.sum()) + np.repeat(first[rim] - np.cumsum(n) + n, n)])
                rim = reach[~seen[reach]]
                seen[rim] = True
            found = nodes[seen]
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(found), t) for k, t in zip(key, (pa.string(), pa.int32(), pa.int64()), strict=True)), pa.array(np.full(len(found), block)), pa.array(found)], names=[*group, "block", "node"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if parts[1]:
                yield from around(key, np.concatenate(parts[0] or [np.zeros((0, 2), np.int64)]), np.concatenate(parts[1]))

        for batch in batches:
            table = batch.to_pandas()
            for k, rows in table.groupby(group, sort=False):
                if k != key:
                    yield from close()
                    key, parts = k, ([], [])
                for kind in (0, 1):
                    parts[kind].append(rows.loc[rows["kind"] == kind, ["p", "q"]].to_numpy(np.int64))
        yield from close()

    dealt = both.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(kernel, "group_key string, frame_index int, component long, block long, node long")


def _cut(rows: DataFrame, touch: DataFrame, points: DataFrame, max_faces: int, block_rings: int) -> DataFrame:
    """rows of large components as blocks: (K, component, block, node, ring_id, nodes, seed).

    A component's extent is cut into as many cells as it has block_rings. A block has the
    rings that begin in its cell as seeds, and with them all rings within half of max_faces
    steps over shared sides: in a closed shell every side has two faces, so no face is
    farther from another than that.
    """
    first = rows.withColumn("first", F.get("nodes", F.lit(0))).join(points.select(*K, F.col("node").alias("first"), "x", "y", "z", "lx", "ly", "lz"), [*K, "first"])
    group = [*K, "component"]
    span = first.groupBy(*group).agg(F.count("*").alias("n"), *[F.min(c).alias(f"a{c}") for c in "xyz"], *[F.max(c).alias(f"b{c}") for c in "xyz"])
    side = F.ceil(F.pow(F.col("n") / block_rings, F.lit(1 / 3)))
    placed = first.join(span, group)

    def cell(c: str) -> Column:
        inside = F.when(F.col(f"l{c}").isNull(), (F.col(c) - F.col(f"a{c}")) / F.greatest(F.col(f"b{c}") - F.col(f"a{c}"), F.lit(1e-9)))
        share = inside.otherwise(F.col(c) / F.col(f"l{c}") - F.floor(F.col(c) / F.col(f"l{c}")))
        return F.least(side - 1, F.floor(share * side))

    block = ((cell("x") * side + cell("y")) * side + cell("z")).cast("long")
    seeds = checkpoint(placed.select(*group, block.alias("block"), "node"))
    near = touch.select(*K, F.col("u").alias("node"), F.col("v").alias("next"))
    near = near.union(near.select(*K, "next", "node")).distinct()
    if span.agg(F.max("n")).first()[0] <= RIM_RINGS:
        held = checkpoint(_rims(seeds, near, max_faces // 2))
    else:
        near, held, rim = checkpoint(near), seeds, seeds
        for _ in range(max_faces // 2):
            rim = checkpoint(rim.join(near, [*K, "node"]).select(*group, "block", F.col("next").alias("node")).distinct().join(held, [*group, "block", "node"], "left_anti"))
            held = held.unionByName(rim)
    marked = held.join(seeds.withColumn("seed", F.lit(True)), [*group, "block", "node"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    return marked.join(rows.select(*K, "node", "ring_id", "nodes"), [*K, "node"]).select(*group, "block", "node", "ring_id", "nodes", "seed")


def _search(blocks: DataFrame, max_faces: int, max_states: int) -> DataFrame:
    """(K, seed, cage_type, rings, waters) of blocks(K, component, block, node, ring_id, nodes, seed), a block at a time."""
    out = "group_key string, frame_index int, seed long, cage_type string, rings array<string>, waters array<bigint>"
    # a block is much work for few rows, so blocks are dealt finely
    parts = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("group_key", pa.string()), ("frame_index", pa.int32()), ("seed", pa.int64()), ("cage_type", pa.string()), ("rings", pa.list_(pa.string())), ("waters", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def close() -> None:
            made = _shells([tuple(r[2]) for r in held], [k for k, r in enumerate(held) if r[3]], max_faces, max_states)
            done.extend((key[0], key[1], held[shell[0]][0], kind, [held[k][1] for k in shell], waters) for kind, waters, shell in made)

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            for g, f, component, block, *ring in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, f, component, block) != key:
                    if held:
                        close()
                    key, held = (g, f, component, block), []
                held.append(ring)
            if len(done) > 10_000:
                yield rows()
        if held:
            close()
        if done:
            yield rows()

    order = [*K, "component", "block"]
    return blocks.select(*order, "node", "ring_id", "nodes", "seed").repartition(parts, *order).sortWithinPartitions(*order, "node").mapInArrow(kernel, out)


def find_cages(rings: DataFrame, max_faces: int = MAX_FACES, points: DataFrame | None = None, block_rings: int = BLOCK_RINGS, max_states: int = 0) -> DataFrame:
    """(K, cage_id, cage_type, rings, waters) of all closed cages; one for each type and set of waters.

    The search runs on one connected component of rings (by shared sides) at a time, as a
    shell never leaves its component. With points, components of more than block_rings are
    cut into blocks of space, with the same result. max_states, if not 0, is a guard: a ring
    with more sets of faces to visit fails the search.
    """
    order = Window.partitionBy(*K).orderBy("size", "nodes")
    numbered = checkpoint(rings.select(*K, F.row_number().over(order).cast("long").alias("node"), "ring_id", "size", "nodes"))
    places = F.expr("transform(nodes, (a, i) -> struct(least(a, get(nodes, pmod(i + 1, size(nodes)))) AS u, greatest(a, get(nodes, pmod(i + 1, size(nodes)))) AS v))")
    sides = numbered.select(*K, "node", F.explode(places).alias("side")).select(*K, "node", "side.u", "side.v")
    first = F.min("node").over(Window.partitionBy(*K, "u", "v"))
    star = sides.withColumn("first", first).where("node <> first").select(*K, F.col("first").alias("u"), F.col("node").alias("v"))
    grouped = numbered.join(components(numbered, star), [*K, "node"])
    whole = grouped.select(*K, "component", F.lit(0).cast("long").alias("block"), "node", "ring_id", "nodes", F.lit(True).alias("seed"))
    if points is not None:
        grouped = checkpoint(grouped)
        large = grouped.groupBy(*K, "component").agg(F.count("*").alias("n")).where(F.col("n") > block_rings).drop("n")
        if large.limit(1).count():
            one, two = (sides.select(*K, "u", "v", F.col("node").alias(n)) for n in ("p", "q"))
            touch = one.join(two, [*K, "u", "v"]).where("p < q").select(*K, F.col("p").alias("u"), F.col("q").alias("v"))
            blocks = _cut(grouped.join(large, [*K, "component"], "left_semi"), touch, points, max_faces, block_rings)
            whole = grouped.join(large, [*K, "component"], "left_anti").select(*K, "component", F.lit(0).cast("long").alias("block"), "node", "ring_id", "nodes", F.lit(True).alias("seed")).unionByName(blocks)
    found = _search(whole, max_faces, max_states)
    if points is not None:  # blocks may know one set of waters by different rings
        found = found.groupBy(*K, "cage_type", "waters").agg(F.min_by("rings", "seed").alias("rings"))
    number = F.row_number().over(Window.partitionBy(*K, "cage_type").orderBy("waters", "rings"))
    return found.select(*K, F.format_string("%s_%05d", "cage_type", number).alias("cage_id"), "cage_type", "rings", "waters")


def cage_centers(cages: DataFrame, points: DataFrame) -> DataFrame:
    """(K, cage_id, cx, cy, cz, lx, ly, lz, reach): mean of the waters near the first one, and the largest distance from it."""
    members = cages.select(*K, "cage_id", F.explode("waters").alias("node"), F.get("waters", F.lit(0)).alias("anchor")).join(points, [*K, "node"])
    own = Window.partitionBy(*K, "cage_id")
    placed = members.select("*", *[F.max(F.when(F.col("node") == F.col("anchor"), F.col(c))).over(own).alias(f"a{c}") for c in "xyz"]).where("ax IS NOT NULL")
    near = delta(vec("a"), vec(""), vec("l"))
    placed = placed.select(*K, "cage_id", "lx", "ly", "lz", *[(F.col(f"a{c}") + d).alias(f"p{c}") for c, d in zip("xyz", near, strict=True)])
    mean = Window.partitionBy(*K, "cage_id")
    placed = placed.select("*", *[F.avg(f"p{c}").over(mean).alias(f"c{c}") for c in "xyz"])
    away = tuple(F.col(f"p{c}") - F.col(f"c{c}") for c in "xyz")
    return placed.groupBy(*K, "cage_id").agg(*[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"], *[F.first(f"l{c}").alias(f"l{c}") for c in "xyz"], F.max(norm(away)).alias("reach"))


def _triangles(cages: DataFrame, rings: DataFrame, points: DataFrame, centers: DataFrame) -> DataFrame:
    """(K, cage_id, p.., q.., r..): fans of all faces, as vectors from the cage's centre, pointing outwards."""
    corners = rings.select(*K, "ring_id", F.posexplode("nodes").alias("place", "node")).join(points.select(*K, "node", *"xyz"), [*K, "node"], "left")
    placed = corners.groupBy(*K, "ring_id").agg(F.array_sort(F.collect_list(F.struct("place", *"xyz"))).alias("at"))
    faces = cages.select(*K, "cage_id", F.explode("rings").alias("ring_id")).join(placed, [*K, "ring_id"]).join(centers, [*K, "cage_id"])
    fans = faces.select("*", F.explode(F.sequence(F.lit(1), F.size("at") - 2)).alias("k"))
    for n, place in (("p", F.lit(0)), ("q", F.col("k")), ("r", F.col("k") + 1)):
        corner = F.get("at", place)
        fans = fans.select("*", *[corner[c].alias(f"o{c}") for c in "xyz"])
        d = delta(vec("c"), vec("o"), vec("l"))
        fans = fans.select("*", *[x.alias(f"{n}{c}") for c, x in zip("xyz", d, strict=True)]).drop("ox", "oy", "oz")
    fans = fans.where("px IS NOT NULL AND qx IS NOT NULL AND rx IS NOT NULL")
    p, q, r = vec("p"), vec("q"), vec("r")
    edge = lambda a, b: tuple(y - x for x, y in zip(a, b, strict=True))
    outward = dot(cross(edge(p, q), edge(p, r)), tuple((a + b + c) for a, b, c in zip(p, q, r, strict=True))) >= 0
    swap = [F.when(outward, F.col(f"{a}{c}")).otherwise(F.col(f"{b}{c}")).alias(f"{a}{c}") for a, b in (("q", "r"), ("r", "q")) for c in "xyz"]
    return fans.select(*K, "cage_id", "px", "py", "pz", *swap)


def occupancy(cages: DataFrame, rings: DataFrame, points: DataFrame, guests: DataFrame, mode: str = "polyhedron", radius: float = 0.5) -> DataFrame:
    """(K, cage_id, guest): guests within the cage; a guest may be in several.

    mode is polyhedron (the solid angles of the faces, seen from the guest, sum to more
    than half a sphere), center (within radius of the centre) or auto (either). The search
    goes as far as the mode asks for: the radius, or 0.25 nm beyond the widest cage.
    """
    centers = checkpoint(cage_centers(cages, points))
    reach = (centers.agg(F.max("reach")).first()[0] or 0.0) + 0.25
    widest = radius if mode == "center" else reach if mode == "polyhedron" else max(radius, reach)
    number = centers.select(*K, "cage_id", F.xxhash64("cage_id").alias("node"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "lx", "ly", "lz", "reach")
    near = cross_cutoff_pairs(number, guests, widest).select(*K, F.col("u").alias("node"), F.col("v").alias("guest"), "dx", "dy", "dz", "dist").join(number.select(*K, "cage_id", "node", "reach"), [*K, "node"])
    close = near.where(F.col("dist") <= radius).select(*K, "cage_id", "guest")
    if mode == "center":
        return close
    inside = near.where(F.col("dist") <= F.col("reach") + 0.25).join(_triangles(cages, rings, points, centers), [*K, "cage_id"])
    a, b, c = (tuple(F.col(f"{n}{x}") - F.col(f"d{x}") for x in "xyz") for n in "pqr")
    size = [norm(v) for v in (a, b, c)]
    whole = size[0] * size[1] * size[2] + dot(a, b) * size[2] + dot(a, c) * size[1] + dot(b, c) * size[0]
    angle = 2 * F.atan2(dot(a, cross(b, c)), whole)
    within = inside.groupBy(*K, "cage_id", "guest").agg(F.sum(angle).alias("angle")).where(F.abs("angle") > 2 * math.pi).select(*K, "cage_id", "guest")
    return within if mode == "polyhedron" else within.union(close).distinct()


def compositions(cages: DataFrame, held: DataFrame, guests: DataFrame) -> DataFrame:
    """(K, cage_id, cage_type, occupancy, composition): empty, single or multi, and guests such as CH4x2+ETH."""
    names = held.join(guests.select(*K, F.col("node").alias("guest"), "resname"), [*K, "guest"]).groupBy(*K, "cage_id", "resname").agg(F.count("*").alias("n"), F.min("guest").alias("first"))
    part = F.when(F.col("n") > 1, F.concat("resname", F.lit("x"), F.col("n").cast("string"))).otherwise(F.col("resname"))
    label = names.groupBy(*K, "cage_id").agg(F.sum("n").alias("held"), F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("parts"))
    found = cages.join(label, [*K, "cage_id"], "left")
    kind = F.when(F.col("held").isNull(), "empty").when(F.col("held") == 1, "single").otherwise("multi")
    return found.select(*K, "cage_id", "cage_type", kind.alias("occupancy"), F.coalesce(F.array_join("parts.part", "+"), F.lit("empty")).alias("composition"))


def isomers(cages: DataFrame, rings: DataFrame) -> DataFrame:
    """(K, cage_id, cage_type, isomer): the pattern of touching six-faces; null without a six-face."""
    faces = cages.select(*K, "cage_id", F.explode("rings").alias("ring_id"))
    six = faces.join(ring_edges(rings.where("size = 6")), [*K, "ring_id"])
    pairs = six.alias("a").join(six.alias("b"), [*K, "cage_id", "u", "v"]).where("a.ring_id <> b.ring_id").select(*K, "cage_id", F.col("a.ring_id").alias("ring_id"), F.col("b.ring_id").alias("other")).distinct()
    degree = six.select(*K, "cage_id", "ring_id").distinct().join(pairs.groupBy(*K, "cage_id", "ring_id").agg(F.count("*").alias("d")), [*K, "cage_id", "ring_id"], "left")
    stats = degree.groupBy(*K, "cage_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("d", F.lit(0))).alias("twice"), F.sort_array(F.collect_list(F.coalesce("d", F.lit(0))), False).alias("degrees"))
    text = F.array_join(F.transform("degrees", lambda d: d.cast("string")), "")
    known = F.create_map(*[F.lit(x) for pair in ISOMERS.items() for x in pair])
    plain = F.concat(F.lit("6n"), F.col("n"), F.lit("e"), (F.col("twice") / 2).cast("long"), F.lit("d"), text)
    apart = F.when((F.col("twice") == 0) & (F.col("n") > 1), F.concat(F.col("n").cast("string"), F.lit("x6sep")))
    label = stats.select(*K, "cage_id", F.coalesce(apart, F.try_element_at(known, text), plain).alias("isomer"))
    return cages.select(*K, "cage_id", "cage_type").join(label, [*K, "cage_id"], "left")


def shared_faces(cages: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, ring_id, a, b): rings between two cages, and those cages; a face never parts more than two.

    Without sides, of face_sides, only rings that exactly two cages have are told. With
    them, the best cage on either side of the ring's plane is taken, however many have the
    ring, and a ring whose cages all lie on one side parts none.
    """
    faces = cages.select(*K, "cage_id", F.explode("rings").alias("ring_id"))
    if sides is None:
        two = faces.groupBy(*K, "ring_id").agg(F.count("*").alias("n"), F.min("cage_id").alias("a"), F.max("cage_id").alias("b"))
        return two.where("n = 2").select(*K, "ring_id", "a", "b")
    seen = faces.join(sides, [*K, "cage_id", "ring_id"])
    best = F.struct(-F.col("alignment"), "lateral", -F.abs("signed"), "cage_id")
    pick = lambda above: F.min_by(F.when(F.col("signed") > 0 if above else F.col("signed") < 0, F.col("cage_id")), F.when(F.col("signed") > 0 if above else F.col("signed") < 0, best))
    both = seen.groupBy(*K, "ring_id").agg(pick(False).alias("below"), pick(True).alias("above")).where("below IS NOT NULL AND above IS NOT NULL")
    return both.select(*K, "ring_id", F.least("below", "above").alias("a"), F.greatest("below", "above").alias("b"))


def face_sides(cages: DataFrame, rings: DataFrame, points: DataFrame) -> DataFrame:
    """(K, cage_id, ring_id, signed, alignment, lateral): where a cage's centre lies from each of its faces' planes.

    Centres that lie on a plane, or on a face's centre, have no side and are left out.
    """
    from latticework.operators.geometry import ring_geometry
    from latticework.operators.rings import ring_centers

    plane = ring_geometry(rings, points).select(*K, "ring_id", "nx", "ny", "nz").join(ring_centers(rings, points).select(*K, "ring_id", *[F.col(f"c{c}").alias(f"r{c}") for c in "xyz"]), [*K, "ring_id"])
    middle = cage_centers(cages, points).select(*K, "cage_id", *[F.col(f"c{c}").alias(f"m{c}") for c in "xyz"], "lx", "ly", "lz")
    rows = cages.select(*K, "cage_id", F.explode("rings").alias("ring_id")).join(plane, [*K, "ring_id"]).join(middle, [*K, "cage_id"])
    d = delta(vec("r"), vec("m"), vec("l"))
    rows = rows.select(*K, "cage_id", "ring_id", dot(d, vec("n")).alias("signed"), norm(d).alias("far")).where((F.col("far") > 1e-12) & (F.abs("signed") > 1e-5))
    lateral = F.sqrt(F.greatest(F.col("far") * F.col("far") - F.col("signed") * F.col("signed"), F.lit(0.0)))
    return rows.select(*K, "cage_id", "ring_id", "signed", (F.abs("signed") / F.col("far")).alias("alignment"), lateral.alias("lateral"))


def clusters(cages: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, cage_id, cluster, size): cages tied by shared faces; cluster is named after its first cage."""
    number = checkpoint(cages.select(*K, "cage_id", F.row_number().over(Window.partitionBy(*K).orderBy("cage_type", "waters", "cage_id")).cast("long").alias("node")))
    one = lambda c, n: number.select(*K, F.col("cage_id").alias(c), F.col("node").alias(n))
    ties = shared_faces(cages, sides).join(one("a", "u"), [*K, "a"]).join(one("b", "v"), [*K, "b"]).select(*K, "u", "v")
    labels = number.join(components(number, ties), [*K, "node"]).join(number.select(*K, F.col("node").alias("component"), F.col("cage_id").alias("cluster")), [*K, "component"])
    return labels.select(*K, "cage_id", "cluster", F.count("*").over(Window.partitionBy(*K, "cluster")).alias("size"))


def fingerprints(cages: DataFrame, rings: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, cage_id, cage_type, neighbor, face, n): how often a cage meets each neighbour type over each face size."""
    faces = shared_faces(cages, sides).join(rings.select(*K, "ring_id", F.col("size").alias("face")), [*K, "ring_id"])
    two = faces.select(*K, F.col("a").alias("cage_id"), F.col("b").alias("other"), "face").union(faces.select(*K, F.col("b"), F.col("a"), "face"))
    kind = cages.select(*K, "cage_id", "cage_type")
    named = two.join(kind, [*K, "cage_id"]).join(kind.select(*K, F.col("cage_id").alias("other"), F.col("cage_type").alias("neighbor")), [*K, "other"])
    return named.groupBy(*K, "cage_id", "cage_type", "neighbor", "face").agg(F.count("*").alias("n"))


def phase_support(cages: DataFrame, rings: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, cage_id, cage_type, phase, coverage, purity, score, strict): a cage's neighbours against each phase's ideal ones.

    strict: all ideal neighbours are there, no others, and each count is within one.
    """
    spark = cages.sparkSession
    ideal = F.broadcast(spark.createDataFrame([(p, t, n, f, k) for (p, t), v in TEMPLATES.items() for (n, f), k in v.items()], "phase string, cage_type string, neighbor string, face int, ideal int"))
    seen = fingerprints(cages, rings, sides)
    total = seen.groupBy(*K, "cage_id").agg(F.sum("n").alias("observed"))
    wanted = cages.select(*K, "cage_id", "cage_type").join(ideal, "cage_type")
    met = wanted.join(seen, [*K, "cage_id", "cage_type", "neighbor", "face"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy(*K, "cage_id", "cage_type", "phase").agg(F.sum(F.least("n", "ideal")).alias("matched"), F.sum("ideal").alias("expected"), F.sum("n").alias("known"), F.bool_and((F.col("n") > 0) & (F.abs(F.col("n") - F.col("ideal")) <= 1)).alias("close"))
    rows = sums.join(total, [*K, "cage_id"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    coverage: Column = F.col("matched") / F.col("expected")
    purity = F.when(F.col("observed") > 0, F.col("matched") / F.col("observed")).otherwise(0.0)
    score = F.when(F.col("matched") > 0, 2 * coverage * purity / (coverage + purity)).otherwise(0.0)
    return rows.select(*K, "cage_id", "cage_type", "phase", coverage.alias("coverage"), purity.alias("purity"), score.alias("score"), (F.col("close") & (F.col("known") == F.col("observed"))).alias("strict"))
