"""Open patches of rings: half cages and quasi cages of one closed side wall and further layers.

A wall has a ring on every side of a base ring, each sharing just that side with the base
and just one other side with its neighbours. Walls grow by equi-joins on a relation of
touching candidates, one side of the base at a time.

A further layer is a connected set of rings on the open sides of the layer before it. Which
rings may belong to it is settled by joins, for all patches at once; the sets of a patch are
made in a task from its few candidates.

Patches never leave a connected component of rings. Components of few rings, such as single
cages, are therefore searched whole in a task, with the same result and no joins.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.pbc import delta, norm, vec
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, components
from latticework.operators.rings import ring_edges

PER_SIDE = 4
#: Most rings of a further layer, sets of a patch, and candidates they are made of.
LAYER_RINGS, LAYER_STATES, LAYER_CANDIDATES = 6, 200, 24
#: Rings of a connected component that a task searches whole; components whose patches a worker keeps for others of the same form; patches sent on at a time.
WHOLE_RINGS, FORMS, SENT = 64, 4096, 1 << 16
_FORMS: dict[tuple, tuple] = {}


def _sides(rings: DataFrame) -> DataFrame:
    """(K, ring_id, size, place, u, v): sides in cyclic order."""
    sides = F.expr("transform(nodes, (a, i) -> struct(a AS p, get(nodes, pmod(i + 1, size(nodes))) AS q))")
    return rings.select(*K, "ring_id", "size", F.posexplode(sides).alias("place", "s")).select(*K, "ring_id", "size", "place", F.least("s.p", "s.q").alias("u"), F.greatest("s.p", "s.q").alias("v"))


def side_candidates(rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...] = (5, 6), side_sizes: tuple[int, ...] = (5, 6), per_side: int = PER_SIDE) -> DataFrame:
    """(K, base, base_size, place, ring_id, size): for each side of a base ring its nearest rings that share that side alone."""
    sides = _sides(rings)
    base = sides.where(F.col("size").isin(*base_sizes)).select(*K, F.col("ring_id").alias("base"), F.col("size").alias("base_size"), "place", "u", "v")
    met = base.join(sides.where(F.col("size").isin(*side_sizes)).drop("place"), [*K, "u", "v"]).where("ring_id <> base")
    alone = met.withColumn("common", F.count("*").over(Window.partitionBy(*K, "base", "ring_id"))).where("common = 1")
    at = lambda name, p: centers.select(*K, F.col("ring_id").alias(name), *[F.col(f"c{c}").alias(f"{p}{c}") for c in "xyz"], *[F.col(f"l{c}").alias(f"{p}l{c}") for c in "xyz"])
    near = alone.join(at("base", "b"), [*K, "base"]).join(at("ring_id", "r"), [*K, "ring_id"])
    away = norm(delta(vec("b"), vec("r"), vec("bl")))
    order = Window.partitionBy(*K, "base", "place").orderBy(away, "ring_id")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_side).select(*K, "base", "base_size", "place", "ring_id", "size")


def closed_walls(rings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(K, base, base_size, wall): rings around the base in the order of its sides."""
    sides = ring_edges(rings).select(*K, "ring_id", "u", "v")
    base_sides = sides.select(*K, F.col("ring_id").alias("base"), "u", "v")
    walls = candidates.join(sides, [*K, "ring_id"]).join(base_sides, [*K, "base", "u", "v"], "left_anti")
    one = walls.select(*K, "base", "base_size", F.col("place").alias("place"), F.col("ring_id").alias("p"), "u", "v")
    two = walls.select(*K, "base", F.pmod(F.col("place") - 1, F.col("base_size")).alias("place"), F.col("ring_id").alias("q"), "u", "v")
    touch = one.join(two, [*K, "base", "place", "u", "v"]).where("p <> q").groupBy(*K, "base", "base_size", "place", "p", "q").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    touch = checkpoint(touch)
    out = None
    for size in [r[0] for r in candidates.select("base_size").distinct().orderBy("base_size").collect()]:  # at most four ring sizes
        own = touch.where(F.col("base_size") == size).drop("base_size")
        paths = own.where("place = 0").select(*K, "base", F.array("p", "q").alias("wall"), F.col("q").alias("p"))
        for place in range(1, size - 1):
            paths = paths.join(own.where(F.col("place") == place).drop("place"), [*K, "base", "p"]).where(~F.array_contains("wall", F.col("q"))).select(*K, "base", F.concat("wall", F.array("q")).alias("wall"), F.col("q").alias("p"))
        last = own.where(F.col("place") == size - 1).select(*K, "base", "p", F.col("q").alias("first"))
        done = paths.withColumn("first", F.get("wall", F.lit(0))).join(last, [*K, "base", "p", "first"], "left_semi").select(*K, "base", F.lit(size).alias("base_size"), "wall")
        out = done if out is None else out.unionByName(done)
    return out if out is not None else candidates.select(*K, "base", "base_size", F.array("ring_id").alias("wall")).limit(0)


def _sequence(sizes: Column) -> Column:
    """Least rotation of the sizes or of their reverse, as digits."""
    n = F.size(sizes)
    turn = lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice(a, i + 1, n), F.slice(a, F.lit(1), i)))
    return F.array_join(F.transform(F.array_min(F.concat(turn(sizes), turn(F.reverse(sizes)))), lambda s: s.cast("string")), "")


def _layer_label(sequence: Column) -> Column:
    up, down = ("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), ("0123456789", "₀₁₂₃₄₅₆₇₈₉")
    part = lambda d: F.when(F.contains(sequence, F.lit(d)), F.concat(F.lit(d), F.translate(F.length(F.regexp_replace(sequence, f"[^{d}]", "")).cast("string"), *up))).otherwise("")
    return F.concat(*[part(d) for d in "4567"], F.translate(sequence, *down))


def _label(base: Column, sequence: Column) -> Column:
    return F.concat(F.lit("qc_"), base.cast("string"), F.lit("r_"), _layer_label(sequence))


def layer_candidates(states: DataFrame, rings: DataFrame, centers: DataFrame, side_sizes: tuple[int, ...]) -> DataFrame:
    """(K, state, ring_id, size, place): rings on the open sides of a state's frontier, nearest first.

    states are (K, state, rings, frontier). A ring that shares a side with the inner layers
    is no candidate.
    """
    sides = checkpoint(ring_edges(rings))
    own = states.select(*K, "state", "frontier", F.explode("rings").alias("ring_id")).join(sides.drop("size"), [*K, "ring_id"])
    own = own.withColumn("outer", F.array_contains("frontier", F.col("ring_id")))
    per = own.groupBy(*K, "state", "u", "v").agg(F.count("*").alias("n"), F.bool_or("outer").alias("outer"), F.bool_or(~F.col("outer")).alias("lower"))
    there = sides.where(F.col("size").isin(*side_sizes))
    met = per.join(there, [*K, "u", "v"])
    held = states.select(*K, "state", F.explode("rings").alias("ring_id"))
    grown = met.where("n = 1 AND outer").select(*K, "state", "ring_id", "size").distinct()
    blocked = met.where("lower").select(*K, "state", "ring_id").distinct()
    open_ = grown.join(held, [*K, "state", "ring_id"], "left_anti").join(blocked, [*K, "state", "ring_id"], "left_anti")
    at = lambda name, p: centers.select(*K, F.col("ring_id").alias(name), *[F.col(f"c{c}").alias(f"{p}{c}") for c in "xyz"], *[F.col(f"l{c}").alias(f"{p}l{c}") for c in "xyz"])
    rim = states.select(*K, "state", F.explode("frontier").alias("near"))
    far = open_.join(rim, [*K, "state"]).join(at("ring_id", "r"), [*K, "ring_id"]).join(at("near", "b"), [*K, "near"])
    away = far.groupBy(*K, "state", "ring_id", "size").agg(F.min(norm(delta(vec("b"), vec("r"), vec("bl")))).alias("far"))
    order = Window.partitionBy(*K, "state").orderBy("far", "ring_id")
    return away.select(*K, "state", "ring_id", "size", F.row_number().over(order).alias("place"))


def connected_units(links: dict[str, set[str]], most: int, states: int, exact: bool) -> tuple[list[tuple[str, ...]], bool]:
    """Connected sets of at most so many candidates, and whether more than states were left out.

    exact takes all of them. Otherwise a component that is small enough is one unit, and a
    larger one gives each of its members alone and with its nearest.
    """
    found: dict[tuple[str, ...], None] = {}
    if exact:
        for start in sorted(links):
            fresh = [frozenset((start,))]
            known = set(fresh)
            while fresh:
                unit = fresh.pop()
                if len(found) == states:
                    return list(found), True
                found[tuple(sorted(unit))] = None
                if len(unit) < most:
                    for other in sorted(set().union(*(links[r] for r in unit)) - unit, reverse=True):
                        more = unit | {other}
                        if other > start and more not in known:
                            known.add(more)
                            fresh.append(more)
        return list(found), False
    left = set(links)
    while left:
        part, stack = set(), [min(left)]
        while stack:
            r = stack.pop()
            if r not in part:
                part.add(r)
                stack += links[r] - part
        left -= part
        if len(part) <= most:
            units = [part]
        else:
            units = [{r} for r in sorted(part)]
            for r in sorted(part):
                near, queue = [r], [r]
                while queue and len(near) < most:
                    for other in sorted(links[queue.pop(0)]):
                        if other not in near and len(near) < most:
                            near.append(other)
                            queue.append(other)
                units.append(set(near))
        for unit in units:
            if len(found) == states and tuple(sorted(unit)) not in found:
                return list(found), True
            found[tuple(sorted(unit))] = None
    return list(found), False


def next_layer(states: DataFrame, rings: DataFrame, centers: DataFrame, side_sizes: tuple[int, ...], layer_rings: int, layer_states: int, most: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(states, limits): (K, base_size, label, rings, frontier) with one more layer; limits(K, warning) tells which bounds were met."""
    near = checkpoint(layer_candidates(states, rings, centers, side_sizes))
    kept = near.where(F.col("place") <= most)
    sides = ring_edges(rings).select(*K, "ring_id", "u", "v")
    ends = kept.select(*K, "state", "ring_id").join(sides, [*K, "ring_id"])
    ties = ends.join(ends.withColumnRenamed("ring_id", "other"), [*K, "state", "u", "v"]).where("ring_id <> other").groupBy(*K, "state", "ring_id").agg(F.collect_set("other").alias("others"))
    rows = kept.join(ties, [*K, "state", "ring_id"], "left").groupBy(*K, "state").agg(F.array_sort(F.collect_list(F.struct("ring_id", "size", "others"))).alias("near"))  # at most most candidates
    out = "group_key string, frame_index int, state long, unit array<string>, sizes string, limited boolean"
    schema = pa.schema([("group_key", pa.string()), ("frame_index", pa.int32()), ("state", pa.int64()), ("unit", pa.list_(pa.string())), ("sizes", pa.string()), ("limited", pa.bool_())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for g, f, state, candidates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = {c["ring_id"]: c["size"] for c in candidates}
                units, limited = connected_units({c["ring_id"]: set(c["others"] or ()) for c in candidates}, layer_rings, layer_states, exact)
                made += [(g, f, state, list(u), "".join(map(str, sorted(size[r] for r in u))), limited) for u in units]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t.type) for k, t in enumerate(schema)], schema=schema)

    units = checkpoint(rows.mapInArrow(kernel, out))
    grown = states.join(units, [*K, "state"]).select(
        *K, "base_size", F.concat_ws("_", "label", _layer_label(F.col("sizes"))).alias("label"), F.array_sort(F.array_union("rings", "unit")).alias("rings"), F.col("unit").alias("frontier")
    )
    keys = [*K, "rings", "frontier"] if exact else [*K, "rings"]
    one = grown.groupBy(*keys).agg(F.min(F.struct("label", "base_size", "frontier")).alias("s")).select(*K, "s.base_size", "s.label", "rings", "s.frontier")
    limits = near.where(F.col("place") > most).select(*K, F.lit("layer candidates").alias("warning")).union(units.where("limited").select(*K, F.lit("layer states").alias("warning")))
    return one, limits.distinct()


def patch_warnings(rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...] = (5, 6), side_sizes: tuple[int, ...] = (5, 6), per_side: int = PER_SIDE) -> DataFrame:
    """(K, warning): frames in which a side of a base ring has more candidates than are tried."""
    every = side_candidates(rings, centers, base_sizes, side_sizes, per_side + 1)
    many = every.groupBy(*K, "base", "place").agg(F.count("*").alias("n")).where(F.col("n") > per_side)
    return many.select(*K, F.lit("side candidates").alias("warning")).distinct()


def find_patches(
    rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...] = (5, 6), side_sizes: tuple[int, ...] = (5, 6), per_side: int = PER_SIDE, layers: int = 1,
    layer_rings: int = LAYER_RINGS, layer_states: int = LAYER_STATES, layer_candidates: int = LAYER_CANDIDATES, exact: bool = False,
) -> DataFrame:
    """The patches of patches_and_warnings."""
    made, _ = _searched(rings, centers, base_sizes, side_sizes, per_side, layers, layer_rings, layer_states, layer_candidates, exact, None)
    return _named(made)


def patches_and_warnings(
    rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...] = (5, 6), side_sizes: tuple[int, ...] = (5, 6), per_side: int = PER_SIDE, layers: int = 1,
    layer_rings: int = LAYER_RINGS, layer_states: int = LAYER_STATES, layer_candidates: int = LAYER_CANDIDATES, exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """((K, patch_id, patch_type, kind, rings), (K, warning)).

    One patch for each set of rings; half cages that lie within others are left out. layers
    counts the wall and what grows on it. Searches are bounded by a few nearest candidates
    and sets; frames where a bound was met have a warning, naming which. exact takes all
    connected sets of candidates.
    """
    made, warnings = _searched(rings, centers, base_sizes, side_sizes, per_side, layers, layer_rings, layer_states, layer_candidates, exact, checkpoint)
    return _named(made), warnings.distinct()


def _named(made: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*K, "patch_type").orderBy("rings"))
    return made.select(*K, F.format_string("%s_%05d", "patch_type", number).alias("patch_id"), "patch_type", "kind", "rings")


def _searched(
    rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...], side_sizes: tuple[int, ...], per_side: int, layers: int, layer_rings: int, layer_states: int, layer_candidates: int, exact: bool,
    keep: Callable[[DataFrame], DataFrame] | None,
) -> tuple[DataFrame, DataFrame]:
    """((K, patch_type, kind, rings), (K, warning)): components of up to WHOLE_RINGS each in a task, larger ones by joins. keep holds what both are read from."""
    if not 1 <= layers <= 3:
        raise ValueError("a quasi cage has one to three layers")
    bounds = (tuple(base_sizes), tuple(side_sizes), per_side, layers, layer_rings, layer_states, layer_candidates, exact)
    rings = checkpoint(rings)
    node = F.get("nodes", F.lit(0))
    ties = rings.select(*K, node.alias("u"), F.explode(F.slice("nodes", 2, F.size("nodes"))).alias("v"))
    firsts = rings.select(*K, node.alias("node")).distinct()
    labels = components(firsts, ties)
    grouped = checkpoint(rings.withColumn("node", node).join(labels, [*K, "node"]).drop("node"))
    large = grouped.groupBy(*K, "component").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_RINGS).drop("n")
    large = checkpoint(large)
    whole = grouped.join(large, [*K, "component"], "left_anti")
    made = _by_component(whole, centers, bounds)
    if keep is not None:
        made = keep(made)
    found, warnings = made.where("warning IS NULL").drop("warning"), made.where("warning IS NOT NULL").select(*K, "warning")
    if not large.isEmpty():
        wide, limits = _by_joins(checkpoint(grouped.join(large, [*K, "component"], "left_semi").drop("component")), centers, *bounds)
        found, warnings = found.unionByName(wide), warnings.unionByName(limits)
    return found, warnings


_UP, _DOWN = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")


def _layer_text(sequence: str) -> str:
    """As _layer_label."""
    return "".join(d + str(sequence.count(d)).translate(_UP) for d in "4567" if d in sequence) + sequence.translate(_DOWN)


def _patches_of(
    rings: list[tuple[int, ...]], placed: tuple[bool, ...], distance: Callable[[int, int], float], base_sizes: tuple[int, ...], side_sizes: tuple[int, ...], per_side: int, layers: int, layer_rings: int, layer_states: int, layer_candidates: int, exact: bool,
) -> tuple[list[tuple[str, str, tuple[int, ...]]], set[str]]:
    """((patch_type, kind, rings), warnings) of one component, rings as positions in the order of their ids.

    The steps are those of _by_joins; what is not placed has no centre and is no base and no candidate. Distances are asked for only where more candidates than are tried have to be ranked.
    """
    warnings: set[str] = set()
    sides = [[(min(a, b), max(a, b)) for a, b in zip(r, (*r[1:], r[0]), strict=True)] for r in rings]
    of = [set(s) for s in sides]
    by_side: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, own in enumerate(sides):
        if placed[k] and len(rings[k]) in side_sizes:
            for side in own:
                by_side[side].append(k)
    flat: list[tuple[int, str, str, str, tuple[int, ...], tuple[int, ...]]] = []  # base, patch_type, kind, label, rings, wall
    for base, around in enumerate(rings):
        n = len(around)
        if n not in base_sizes or not placed[base]:
            continue
        near = []
        for side in sides[base]:
            some = [k for k in by_side[side] if k != base and len(of[k] & of[base]) == 1]
            if len(some) > per_side:
                warnings.add("side candidates")
                some = sorted(some, key=lambda k: (distance(base, k), k))[:per_side]
            near.append(some)
        touch = [{p: [q for q in near[(place + 1) % n] if p != q and len((of[p] & of[q]) - of[base]) == 1] for p in near[place]} for place in range(n)]
        walls = [(p, q) for p in near[0] for q in touch[0][p]]
        for place in range(1, n - 1):
            walls = [(*w, q) for w in walls for q in touch[place][w[-1]] if q not in w]
        for wall in walls:
            if wall[0] not in touch[n - 1][wall[-1]]:
                continue
            sizes = [len(rings[k]) for k in wall]
            if len({x for k in wall for x in rings[k]} | set(around)) != sum(sizes) - 2 * n:
                continue
            turns = [[*a[i:], *a[:i]] for a in (sizes, sizes[::-1]) for i in range(n)]
            sequence = "".join(map(str, min(turns)))
            label = f"qc_{n}r_{_layer_text(sequence)}"
            half = {(5, "55555"): "hc_5r_5⁵", (6, "555555"): "hc_6r_5⁶"}.get((n, sequence))
            flat.append((base, half or label, "half" if half else "quasi", label, tuple(sorted({*wall, base})), tuple(sorted(wall))))
    single: dict[tuple[tuple[int, ...], str], str] = {}

    def add(patch_type: str, kind: str, held: tuple[int, ...]) -> None:
        single[held, kind] = min(patch_type, single.get((held, kind), patch_type))

    six: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, own in enumerate(sides):
        if len(rings[k]) == 6:
            for side in own:
                six[side].append(k)
    for base, patch_type, kind, _, held, _ in flat:
        add(patch_type, kind, held)
        if patch_type == "hc_6r_5⁶":
            count = Counter(s for k in held for s in sides[k])
            for cap in sorted({c for s, n in count.items() if n == 1 for c in six[s]} - set(held)):
                if not of[cap] & of[base]:
                    add("hc_6r_5⁶_6¹", "half", tuple(sorted({*held, cap})))
    states = [(label, len(rings[base]), held, wall) for base, _, _, label, held, wall in flat]
    for _ in range(1, layers):
        grown: dict[tuple, tuple] = {}
        for label, n, held, frontier in states:
            outer = set(frontier)
            count, lower = Counter(s for k in held for s in sides[k]), {s for k in held if k not in outer for s in sides[k]}
            rim = {s for k in frontier for s in sides[k] if count[s] == 1}
            near = sorted({c for s in rim for c in by_side[s]} - set(held) - {c for s in lower for c in by_side[s]})
            if len(near) > layer_candidates:
                warnings.add("layer candidates")
                near = sorted(sorted(near, key=lambda c: (min(distance(k, c) for k in frontier), c))[:layer_candidates])
            if not near:
                continue
            links = {c: {o for s in sides[c] for o in by_side[s] if o != c and o in near} for c in near}
            units, limited = connected_units(links, layer_rings, layer_states, exact)
            if limited:
                warnings.add("layer states")
            for unit in units:
                wide = tuple(sorted({*held, *unit}))
                text = f"{label}_{_layer_text(''.join(map(str, sorted(len(rings[c]) for c in unit))))}"
                key, state = (wide, unit) if exact else (wide,), (text, n, unit)
                if key not in grown or state < grown[key][:3]:
                    grown[key] = (*state, wide)
        states = [(text, n, wide, unit) for text, n, unit, wide in grown.values()]
        for label, _, held, _ in states:
            add(label, "quasi", held)
    halves = {held for held, kind in single if kind == "half"}
    halves = {h for h in halves if not any(len(h) < len(o) and set(h) <= set(o) for o in halves)}
    return [(t, kind, held) for (held, kind), t in sorted(single.items()) if (held in halves) == (kind == "half")], warnings


def _by_component(rings: DataFrame, centers: DataFrame, bounds: tuple) -> DataFrame:
    """(K, patch_type, kind, rings, warning) of rings with their component; a row is a patch or a warning."""
    places = [*(f"c{c}" for c in "xyz"), *(f"l{c}" for c in "xyz")]
    rows = rings.join(centers.select(*K, "ring_id", *places), [*K, "ring_id"], "left")
    schema = pa.schema([("group_key", pa.string()), ("frame_index", pa.int32()), ("patch_type", pa.string()), ("kind", pa.string()), ("rings", pa.list_(pa.string())), ("warning", pa.string())])

    def settle(nodes: list[tuple[int, ...]], at: list[list]) -> tuple:
        """(types, kinds, ends, positions, warnings) of a component."""
        rank = {n: k for k, n in enumerate(sorted({n for r in nodes for n in r}))}
        form = (tuple(tuple([rank[n] for n in r]) for r in nodes), tuple(None not in a[:3] for a in at), bounds)
        if form in _FORMS:
            return _FORMS[form]
        ranked = []

        def distance(i: int, j: int) -> float:
            ranked.append(True)
            total = 0.0
            for k in range(3):
                d, box = at[j][k] - at[i][k], at[i][k + 3]
                if box is not None:
                    d -= box * np.rint(d / box)
                total += d * d
            return math.sqrt(total)

        found, warnings = _patches_of(*form[:2], distance, *bounds)
        made = ([f[0] for f in found], [f[1] for f in found], np.cumsum([len(f[2]) for f in found], dtype=np.int64), np.array([k for f in found for k in f[2]], dtype=np.int64), sorted(warnings))
        if not ranked:
            if len(_FORMS) >= FORMS:
                _FORMS.clear()
            _FORMS[form] = made
        return made

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done, size = None, [], [], 0

        def close() -> int:
            made = settle([tuple(r[1]) for r in held], [r[2:] for r in held])
            done.append((key[0], key[1], [r[0] for r in held], *made))
            return len(made[0]) + len(made[4])

        def sent() -> pa.RecordBatch:
            groups, frames, types, kinds, names, flat, ends, warned = [], [], [], [], [], [], [np.zeros(1, np.int64)], []
            last = 0
            for g, f, ids, t, k, end, at, warnings in done:
                n = len(t) + len(warnings)
                groups += [g] * n
                frames.append(np.full(n, f, np.int32))
                types += t + [None] * len(warnings)
                kinds += k + [None] * len(warnings)
                warned += [None] * len(t) + warnings
                flat.append(at + len(names))
                names += ids
                ends += [end + last, np.full(len(warnings), last + len(at))]
                last += len(at)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(names, pa.string()).take(pa.array(np.concatenate(flat))))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(np.concatenate(frames)), pa.array(types, pa.string()), pa.array(kinds, pa.string()), lists, pa.array(warned, pa.string())], schema=schema)

        for batch in batches:
            for g, f, component, *ring in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, f, component) != key:
                    if held:
                        size += close()
                    key, held = (g, f, component), []
                    if size > SENT:
                        yield sent()
                        size = 0
                held.append(ring)
        if held:
            close()
        if done:
            yield sent()

    order = [*K, "component"]
    parts = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*order, "ring_id", "nodes", *places).repartition(parts, *order).sortWithinPartitions(*order, "ring_id")
    return dealt.mapInArrow(kernel, "group_key string, frame_index int, patch_type string, kind string, rings array<string>, warning string")


def _by_joins(
    rings: DataFrame, centers: DataFrame, base_sizes: tuple[int, ...], side_sizes: tuple[int, ...], per_side: int, layers: int, layer_rings: int, layer_states: int, layer_candidates: int, exact: bool,
) -> tuple[DataFrame, DataFrame]:
    """_searched for components of any size."""
    walls = closed_walls(rings, checkpoint(side_candidates(rings, centers, base_sizes, side_sizes, per_side)))
    walls = checkpoint(walls.withColumn("wall_key", F.xxhash64("base", "wall")))
    size = rings.select(*K, "ring_id", "size", "nodes")
    parts = walls.select(*K, "base", "base_size", "wall_key", F.posexplode("wall").alias("place", "ring_id")).join(size, [*K, "ring_id"])
    base_nodes = size.select(*K, F.col("ring_id").alias("base"), F.col("nodes").alias("base_nodes"))
    whole = parts.groupBy(*K, "base", "base_size", "wall_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "size"))), lambda s: s["size"]).alias("sizes"), F.flatten(F.collect_list("nodes")).alias("nodes"), F.collect_list("ring_id").alias("side_ids"))
    whole = whole.join(base_nodes, [*K, "base"]).where(F.size(F.array_union("nodes", "base_nodes")) == F.aggregate("sizes", F.lit(0), lambda a, s: a + s) - 2 * F.col("base_size"))
    found = whole.select(*K, "base", "base_size", "side_ids", _sequence(F.col("sizes")).alias("sequence"))
    half = F.when((F.col("base_size") == 5) & (F.col("sequence") == "55555"), "hc_5r_5⁵").when((F.col("base_size") == 6) & (F.col("sequence") == "555555"), "hc_6r_5⁶")
    flat = found.select(*K, F.array_sort(F.array_union("side_ids", F.array("base"))).alias("rings"), F.coalesce(half, _label(F.col("base_size"), F.col("sequence"))).alias("patch_type"), F.when(half.isNotNull(), "half").otherwise("quasi").alias("kind"), "base", "base_size", _label(F.col("base_size"), F.col("sequence")).alias("label"), "side_ids")
    flat = checkpoint(flat)
    warnings = patch_warnings(rings, centers, base_sizes, side_sizes, per_side)
    wanted = ["rings", "patch_type", "kind", "base"]
    capped = flat.select(*K, *wanted).unionByName(_capped(flat, rings))
    states = flat.select(*K, "base_size", "label", "rings", F.array_sort("side_ids").alias("frontier"))
    for _ in range(1, layers):
        states = checkpoint(states.withColumn("state", F.monotonically_increasing_id()))
        states, limits = next_layer(states, rings, centers, side_sizes, layer_rings, layer_states, layer_candidates, exact)
        states, warnings = checkpoint(states), warnings.union(limits)
        more = states.select(*K, "rings", F.col("label").alias("patch_type"), F.lit("quasi").alias("kind"), F.lit(None).cast("string").alias("base"))
        capped = capped.unionByName(more)
    capped = checkpoint(capped)
    single = capped.groupBy(*K, "rings", "kind").agg(F.min("patch_type").alias("patch_type"))
    halves = single.where("kind = 'half'")
    sets = halves.select(*K, "rings", F.explode("rings").alias("ring_id"))
    over = sets.alias("a").join(sets.alias("b"), [*K, "ring_id"]).where("a.rings <> b.rings AND size(a.rings) < size(b.rings)").groupBy(*K, F.col("a.rings").alias("rings"), F.col("b.rings").alias("other")).agg(F.count("*").alias("n")).where("n = size(rings)").select(*K, "rings").distinct()
    halves = halves.join(over, [*K, "rings"], "left_anti")
    quasi = single.where("kind = 'quasi'").join(halves.select(*K, "rings"), [*K, "rings"], "left_anti")
    return halves.unionByName(quasi).select(*K, "patch_type", "kind", "rings"), warnings.distinct()


def _capped(flat: DataFrame, rings: DataFrame) -> DataFrame:
    """The one two-layer half cage: six five-rings about a six-ring, with one more six-ring on their rim."""
    domes = flat.where("patch_type = 'hc_6r_5⁶'")
    sides = ring_edges(rings)
    faces = domes.select(*K, "rings", "base", F.explode("rings").alias("ring_id")).join(sides.drop("size"), [*K, "ring_id"])
    rim = faces.groupBy(*K, "rings", "base", "u", "v").agg(F.count("*").alias("n")).where("n = 1")
    six = sides.where("size = 6").select(*K, F.col("ring_id").alias("cap"), "u", "v")
    caps = rim.join(six, [*K, "u", "v"]).where(~F.array_contains("rings", F.col("cap"))).select(*K, "rings", "base", "cap").distinct()
    closed = caps.join(faces.where("ring_id = base").select(*K, "rings", "u", "v"), [*K, "rings"]).join(six, [*K, "cap", "u", "v"], "left_semi").select(*K, "rings", "base", "cap").distinct()
    caps = caps.join(closed, [*K, "rings", "base", "cap"], "left_anti")
    return caps.select(*K, F.array_sort(F.array_union("rings", F.array("cap"))).alias("rings"), F.lit("hc_6r_5⁶_6¹").alias("patch_type"), F.lit("half").alias("kind"), "base")


def free_patches(patches: DataFrame, cages: DataFrame) -> DataFrame:
    """Patches whose rings are not all part of one cage; half cages that lie within a quasi cage are left out as well."""
    own = patches.select(*K, "patch_id", "kind", F.size("rings").alias("n"), F.explode("rings").alias("ring_id"))
    inside = lambda other, name: own.join(other, [*K, "ring_id"]).groupBy(*K, "patch_id", name, "n").agg(F.count("*").alias("met")).where("met = n").select(*K, "patch_id")
    within = inside(cages.select(*K, "cage_id", F.explode("rings").alias("ring_id")), "cage_id")
    quasi = patches.where("kind = 'quasi'").select(*K, F.col("patch_id").alias("quasi"), F.size("rings").alias("wide"), F.explode("rings").alias("ring_id"))
    covered = own.where("kind = 'half'").join(quasi, [*K, "ring_id"]).groupBy(*K, "patch_id", "quasi", "n", "wide").agg(F.count("*").alias("met")).where("met = n AND n < wide").select(*K, "patch_id")
    return patches.join(within.union(covered).distinct(), [*K, "patch_id"], "left_anti")


def closed_pairs(patches: DataFrame, rings: DataFrame) -> DataFrame:
    """(K, left, right, rings): two patches whose open sides are the same close into a shell; the other way to seed cages.

    Patches of equal boundary meet by its digest; they share no ring. Shells that cages
    makes of single rings include all of these.
    """
    sides = ring_edges(rings)
    own = patches.select(*K, "patch_id", "rings", F.explode("rings").alias("ring_id")).join(sides.drop("size"), [*K, "ring_id"])
    rim = own.groupBy(*K, "patch_id", "rings", "u", "v").agg(F.count("*").alias("n")).where("n = 1")
    edge = rim.groupBy(*K, "patch_id", "rings").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("u", "v")))), 256).alias("rim"))
    edge = checkpoint(edge)  # joined with itself
    one, two = (edge.select(*K, "rim", F.col("patch_id").alias(n), F.col("rings").alias(f"{n}_rings")) for n in ("left", "right"))
    both = one.join(two, [*K, "rim"]).where((F.col("left") < F.col("right")) & ~F.arrays_overlap("left_rings", "right_rings"))
    return both.select(*K, "left", "right", F.array_sort(F.concat("left_rings", "right_rings")).alias("rings"))
