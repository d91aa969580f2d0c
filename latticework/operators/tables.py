"""The summary, one wide row a frame, and the report tables that are cut from it.

Each family of columns is a table by frame; ``summary`` joins them to all frames, so that a
frame without water, ring or cage has a row as well. Counts are 0 there, means are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.cages import NAMES
from latticework.operators.graphs import K, degrees

#: Cage types that have a column whether they occur or not.
KNOWN = tuple(NAMES.values())
SIZES = (4, 5, 6, 7)
_PHASES = ("sI", "sII", "sH")


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*K).agg(F.count("*").alias(name))


def connection_columns(points: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """Edges by the graph's mode, and how many neighbours waters have."""
    rows = degrees(points, edges)
    count = {k: F.count_if(F.col("degree") == k) for k in range(5)} | {"gt4": F.count_if(F.col("degree") > 4)}
    whole = F.count("*")
    made = rows.groupBy(*K).agg(
        F.avg("degree").alias("mean_coordination"), *[c.alias(f"coordination_{k}") for k, c in count.items()], *[(c / whole).alias(f"coordination_{k}_fraction") for k, c in count.items()],
        (F.count_if(F.col("degree") <= 2) / whole).alias("degree_le2_fraction"), (count[4] / whole).alias("degree4_fraction"), (count["gt4"] / whole).alias("over4_fraction"),
    )
    names = {"hbond": "hbond_count", "oo": "oo_connection_count", "pairs": "pair_connection_count"}
    links = _counts(edges, "connection_count")
    out = made.join(links, K, "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0)).cast("long")).withColumn("connection_mode", F.lit(mode))
    return out.select("*", *[(F.col("connection_count") if m == mode else F.lit(None).cast("long")).alias(n) for m, n in names.items()])


def ring_columns(rings: DataFrame, used: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Rings by size, and those that no patch and no detected cage uses; used is (K, ring_id)."""
    free = rings.join(used.select(*K, "ring_id").distinct().withColumn("taken", F.lit(True)), [*K, "ring_id"], "left")
    return free.groupBy(*K).agg(*[F.count_if(F.col("size") == n).alias(f"ring{n}") for n in sizes], *[F.count_if((F.col("size") == n) & F.col("taken").isNull()).alias(f"free_ring{n}") for n in sizes])


def breakdown(df: DataFrame, label: str, name: str, by: str = "; ") -> DataFrame:
    """(K, name): label:count of every label of a frame, in order."""
    rows = df.groupBy(*K, label).agg(F.count("*").alias("n"))
    part = F.transform(F.array_sort(F.collect_list(F.struct(label, "n"))), lambda s: F.concat_ws(":", s[label].cast("string"), s["n"].cast("string")))
    return rows.groupBy(*K).agg(F.array_join(part, by).alias(name))


def patch_columns(patches: DataFrame) -> DataFrame:
    """Half and quasi cages: how many, and of which types."""
    out = patches.groupBy(*K).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_cage_total") for k in ("half", "quasi")])
    for kind in ("half", "quasi"):
        out = out.join(breakdown(patches.where(F.col("kind") == kind), "patch_type", f"{kind}_cage_breakdown"), K, "left")
    return out


def cage_columns(kinds: DataFrame) -> DataFrame:
    """Cages of KNOWN types, in all, empty and occupied; kinds has (K, cage_type, occupancy)."""
    return kinds.groupBy(*K).agg(
        *[F.count_if(F.col("cage_type") == t).alias(f"cage_{t}") for t in KNOWN], F.count("*").alias("cage_total"),
        F.count_if(F.col("occupancy") == "empty").alias("cage_empty"), F.count_if(F.col("occupancy") != "empty").alias("cage_occupied"),
    )


def cluster_columns(clusters: DataFrame, domains: DataFrame, members: DataFrame, cages: DataFrame, min_cage: int = 2) -> DataFrame:
    """Clusters and domains by phase, their cages by status, the largest cluster, and how many clusters have how many cages.

    clusters and domains are those of cluster_table and domain_table, members of clusters.
    """
    kinds = (*_PHASES, "mixed", "unclassified")
    states = ("classified", "boundary", "ambiguous", "unclassified")
    out = clusters.groupBy(*K).agg(F.count("*").alias("hydrate_cluster_count"), *[F.count_if(F.col("cluster_type") == k).alias(f"{k}_cluster_count") for k in kinds], *[F.sum(s).alias(f"{s}_cage_count") for s in states], F.max("cages").alias("largest_cluster_cage_count"))
    per = domains.groupBy(*K).agg(F.count("*").alias("hydrate_domain_count"), *[F.count_if(F.col("phase") == p).alias(f"{p}_domain_count") for p in _PHASES])
    alone = members.where(F.col("size") < min_cage).groupBy(*K).agg(F.count("*").alias("isolated_cage_count"))
    first = clusters.groupBy(*K).agg(F.max_by("cluster", "cages").alias("cluster"))
    water = first.join(members, [*K, "cluster"]).join(cages.select(*K, "cage_id", F.explode("waters").alias("water")), [*K, "cage_id"]).groupBy(*K).agg(F.countDistinct("water").alias("largest_cluster_water_count"))
    frames = members.select(*K).distinct()
    parts = [out, per, alone, water, breakdown(clusters, "cages", "cluster_size_distribution", ";")]
    return reduce(lambda a, b: a.join(b, K, "left"), parts, frames)


def mean_columns(values: DataFrame, column: str, name: str, focus: DataFrame | None = None) -> DataFrame:
    """Mean and count of the values of all waters, and of those of focus(K, node)."""
    rows = values if focus is None else values.join(focus.select(*K, "node", F.lit(True).alias("focused")), [*K, "node"], "left")
    near = F.when(F.col("focused"), F.col(column)) if focus is not None else F.lit(None).cast("double")
    return rows.groupBy(*K).agg(F.avg(column).alias(f"{name}_mean"), F.count(column).alias(f"{name}_count"), F.avg(near).alias(f"{name}_focus_mean"), F.count(near).alias(f"{name}_focus_count"))


def ice_columns(ice: DataFrame) -> DataFrame:
    at = lambda *names: F.count_if(F.col("ice").isin(*names))
    return ice.groupBy(*K).agg(at("ice_i", "interfacial").alias("ice_like_waters"), at("ice_i").alias("ice_i_waters"), at("interfacial").alias("interfacial_ice_waters"))


def molecule_columns(atoms: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Atoms by residue name, mol_NAME, in the order of the names' first atoms; names spares a pass that looks for them."""
    if names is None:
        found = atoms.groupBy("resname").agg(F.min("atom").alias("first")).orderBy("first", "resname").limit(1000).collect()  # a column each
        names = [r[0] for r in found]
    return atoms.groupBy(*K).agg(*[F.count_if(F.col("resname") == n).alias(f"mol_{n}") for n in names], F.count("*").alias("mol_TOTAL"))


def guest_order(guests: DataFrame) -> DataFrame:
    """(K, guest_order): names of guests by their first atom."""
    first = guests.groupBy(*K, "resname").agg(F.min("node").alias("first"))
    return first.groupBy(*K).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "resname"))), lambda s: s["resname"]), ";").alias("guest_order"))


def summary(frames: DataFrame, *parts: DataFrame) -> DataFrame:
    """A row for each of frames(K, frame, time_ps, source), with the columns of all parts; absent counts are 0, absent texts empty."""
    out = frames.withColumn("status", F.lit("ok")).withColumn("error", F.lit(""))
    for part in parts:
        out = out.join(part, K, "left")
    zero = [n for n, t in out.dtypes if t in ("int", "bigint") and n not in (*K, "hbond_count", "oo_connection_count", "pair_connection_count")]
    blank = [n for n, t in out.dtypes if t == "string" and n not in (*K, "frame", "source")]
    return out.na.fill(0, zero).na.fill("", blank)


def with_failures(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Summary rows, and a row of status failed for each of failed(K, frame, time_ps, source, error)."""
    return rows.unionByName(failed.withColumn("status", F.lit("failed")), allowMissingColumns=True)


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'failed'").select(*K, "frame", "time_ps", "source", "status", "error")


def columns_of(rows: DataFrame, *names: str) -> DataFrame:
    """Frame, time and those of the named columns that there are."""
    return rows.select(*K, *[c for c in ("frame", "time_ps", *names) if c in rows.columns])


def connection_table(rows: DataFrame) -> DataFrame:
    kinds = [*range(5), "gt4"]
    return columns_of(rows, "connection_mode", "connection_count", "hbond_count", "oo_connection_count", "pair_connection_count", "mean_coordination", *[f"coordination_{k}" for k in kinds], *[f"coordination_{k}_fraction" for k in kinds], "degree_le2_fraction", "degree4_fraction", "over4_fraction")


def ring_table(rows: DataFrame, sizes: tuple[int, ...] = (4, 5, 6)) -> DataFrame:
    """Rings of the sizes that a report shows, which may be fewer than those searched."""
    return columns_of(rows, *[f"{p}{n}" for n in sizes for p in ("ring", "free_ring")])


def ice_table(rows: DataFrame) -> DataFrame:
    return columns_of(rows, "ice_like_waters", "ice_i_waters", "interfacial_ice_waters")


def molecule_table(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c.startswith("mol_")]
    return rows.select(*K, "frame", "time_ps", *[F.col(c).alias(c[4:]) for c in names])


def hydrate_table(rows: DataFrame) -> DataFrame:
    kinds = [f"{k}_cluster_count" for k in (*_PHASES, "mixed", "unclassified")]
    cages = [f"{s}_cage_count" for s in ("classified", "boundary", "ambiguous", "unclassified", "isolated")]
    return columns_of(rows, "hydrate_cluster_count", *kinds, "hydrate_domain_count", *[f"{p}_domain_count" for p in _PHASES], *cages, "largest_cluster_cage_count", "largest_cluster_water_count", "cluster_size_distribution")


def order_table(rows: DataFrame, parameters: tuple[str, ...], focus: bool = False) -> DataFrame:
    """Means and counts of the chosen parameters; cluster sizes that were not asked for in a frame read N/A."""
    wide = {"f3": "F3", "f4": "F4"}
    largest = {"mcg1": "MCG-1", "mcg3": "MCG-3", "dhop35": "DHOP35", "dhop30": "DHOP30"}
    out: list[Column] = []
    for part in ("", "_focus") if focus else ("",):
        for name in parameters:
            if name in largest and not part:
                source = f"{name.upper()}_largest_cluster"
                value = F.col(source).cast("string") if source in rows.columns else F.lit(None).cast("string")
                out.append(F.coalesce(value, F.lit("N/A")).alias(largest[name]))
            elif name not in largest:
                out += [F.col(f"{wide.get(name, name)}{part}_{c}") for c in ("mean", "count")]
    return rows.select(*K, "frame", "time_ps", *out)


def composition_label(label: Column) -> Column:
    """A patch's type without its prefix and without the subscript digits that tell isomers apart."""
    return F.regexp_replace(F.regexp_replace(label, "^(?:hc|qc)_", ""), "[₀₁₂₃₄₅₆₇₈₉]", "")


def patch_table(patches: DataFrame, kind: str, labels: list[str] | None = None) -> DataFrame:
    """A column for each type of half cage, or each composition of quasi cages, and their total."""
    label = composition_label(F.col("patch_type")) if kind == "quasi" else F.col("patch_type")
    rows = patches.where(F.col("kind") == kind).select(*K, label.alias("label"))
    labels = labels or [r[0] for r in rows.select("label").distinct().orderBy("label").limit(1000).collect()]  # a column each
    return rows.groupBy(*K).agg(*[F.count_if(F.col("label") == x).alias(x) for x in labels], F.count("*").alias("total"))


def quasi_isomers(patches: DataFrame) -> DataFrame:
    """(K, quasi_cage_type, isomer, count) in long form."""
    label = F.regexp_replace("patch_type", "^qc_", "")
    return patches.where("kind = 'quasi'").groupBy(*K, composition_label(F.col("patch_type")).alias("quasi_cage_type"), label.alias("isomer")).agg(F.count("*").alias("count"))


def cage_table(cages: DataFrame, types: list[str]) -> DataFrame:
    """Cages of each of the types, and in all."""
    shown = cages.where(F.col("cage_type").isin(*types))
    return shown.groupBy(*K).agg(*[F.count_if(F.col("cage_type") == t).alias(t) for t in types], F.count("*").alias("total"))


def isomer_table(isomers: DataFrame, types: list[str], zero_rows: bool = False) -> DataFrame:
    """(K, isomer, a text for each type, total): cages of each isomer, "-" for a type that has no such isomer anywhere, and a total row.

    zero_rows shows isomers of the whole run in frames that have none of them.
    """
    named = isomers.where(F.col("cage_type").isin(*types)).select(*K, "cage_type", F.coalesce("isomer", F.lit("plain")).alias("isomer"))
    counts = named.groupBy(*K, "isomer").agg(*[F.count_if(F.col("cage_type") == t).alias(t) for t in types])
    known = named.groupBy("isomer").agg(*[F.bool_or(F.col("cage_type") == t).alias(f"has {t}") for t in types])  # a row for each isomer
    frames = named.select(*K).distinct()
    every = frames.join(F.broadcast(known), how="cross") if zero_rows else counts.select(*K, "isomer").join(known, "isomer")
    rows = every.join(counts, [*K, "isomer"], "left")
    cell = lambda t: F.when(F.col(f"has {t}"), F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("string")).otherwise("-")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{t}`"), F.lit(0)) for t in types])
    shown = rows.select(*K, "isomer", *[cell(t).alias(t) for t in types], total.cast("long").alias("total"))
    whole = named.groupBy(*K).agg(*[F.count_if(F.col("cage_type") == t).cast("string").alias(t) for t in types], F.count("*").alias("total"))
    return shown.unionByName(whole.withColumn("isomer", F.lit("total")).select(*shown.columns))


def per_water(points: DataFrame, **values: DataFrame) -> DataFrame:
    """(K, node, x, y, z, a column or more for each of values(K, node, ...)): one row a water."""
    out = points.select(*K, "node", "x", "y", "z")
    for table in values.values():
        out = out.join(table, [*K, "node"], "left")
    return out


def markdown_lines(df: DataFrame, digits: int = 6) -> DataFrame:
    """(place, line) of a Markdown table: a header, a rule and a line for each row, to be ordered by place."""
    def cell(name: str, kind: str) -> Column:
        value = F.format_number(F.col(f"`{name}`"), digits) if kind == "double" else F.col(f"`{name}`").cast("string")
        return F.regexp_replace(F.coalesce(value, F.lit("")), r"\|", r"\\|")

    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "---|" * len(df.columns)
    top = df.sparkSession.createDataFrame([(-2, head), (-1, rule)], "place long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n, t) for n, t in df.dtypes]), F.lit(" |"))
    return top.unionByName(df.select(F.monotonically_increasing_id().alias("place"), line.alias("line")))


def info_lines(rows: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """(K, place, line): a document for each frame, the named columns of a summary by section."""
    parts = [F.concat(F.lit("# "), F.coalesce("frame", F.lit("")))]
    for title, names in sections.items():
        parts += [F.lit(""), F.lit(f"## {title}")]
        parts += [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("N/A"))) for n in names if n in rows.columns]
    return rows.select(*K, F.posexplode(F.array(*parts)).alias("place", "line"))


def flattened(config: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(key, value) of nested settings, keys joined by dots."""
    out = []
    for key, value in config.items():
        name = f"{prefix}{key}"
        out += flattened(value, f"{name}.") if isinstance(value, dict) else [(name, ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else "" if value is None else str(value))]
    return out


def renamed_members(members: DataFrame, seen: DataFrame) -> DataFrame:
    """A membership table whose cages are named by their track: object_id of cages becomes tN, by frame, id and type."""
    names = seen.select(*K, F.col("cage_id").alias("object_id"), F.col("cage_type").alias("kind"), "track")
    out = members.join(names, [*K, "object_id", "kind"], "left")
    cage = F.col("record").isin("M", "C")
    missing = F.raise_error(F.concat(F.lit("no track for cage "), "object_id")).cast("string")
    return out.select(*[F.when(cage, F.coalesce("track", missing)).otherwise(F.col("object_id")).alias(c) if c == "object_id" else F.col(c) for c in members.columns])


def render_members(frames: DataFrame, centers: DataFrame, statuses: DataFrame, clusters: DataFrame, cages: DataFrame, held: DataFrame, guests: DataFrame, atoms: DataFrame, roles: DataFrame, mode: str) -> DataFrame:
    """The fifteen columns of a membership file: F frames, C cage centres (in angstrom), G guest molecules, P components of the first frame, M members.

    frames are (K, time_ps); roles are (K, atom, role, resname); atoms are counted from 0 within a frame.
    """
    number = F.dense_rank().over(Window.orderBy(*K)) - 1  # a row for each frame
    order = frames.select(*K, "time_ps", number.alias("render_frame"))
    dash = F.lit("-")
    tag = statuses.join(clusters.select(*K, "cage_id", "cluster"), [*K, "cage_id"]).select(*K, "cage_id", "cage_type", F.coalesce("phase", "status").alias("phase"), F.coalesce(F.col("domain").cast("string"), dash).alias("domain"), "cluster")

    def rows(df: DataFrame, record: str, **given: Column) -> DataFrame:
        names = ["source_frame", "time_ps", "graph_mode", "family", "cage_id", "cage_type", "phase", "domain", "cluster", "atom_indices", "center_x_angstrom", "center_y_angstrom", "center_z_angstrom"]
        return df.select(F.lit(record).alias("record"), "render_frame", *[given.get(n, dash).cast("string").alias(n) for n in names])

    own = {n: F.col(n) for n in ("cage_id", "cage_type", "phase", "domain", "cluster")}
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    at = {f"center_{c}_angstrom": F.format_number(F.col(f"c{c}") * 10, 6) for c in "xyz"}
    out = rows(order, "F", source_frame=F.col("frame_index"), time_ps=F.coalesce(F.col("time_ps").cast("string"), dash), graph_mode=F.lit(mode))
    out = out.unionByName(rows(centers.join(tag, [*K, "cage_id"]).join(order, K), "C", family=F.lit("cage"), **own, **at))
    inside = held.join(guests.select(*K, F.col("node").alias("guest"), "resname"), [*K, "guest"]).join(tag, [*K, "cage_id"]).join(order, K)
    out = out.unionByName(rows(inside, "G", family=F.col("resname"), atom_indices=F.col("guest"), **own))
    first = order.where("render_frame = 0").select(*K, "render_frame")
    kinds = roles.join(first, K).groupBy("render_frame", "role", "resname").agg(listed("atom").alias("atoms"))
    out = out.unionByName(rows(kinds, "P", family=F.lit("component"), cage_id=F.col("role"), cage_type=F.col("resname"), atom_indices=F.col("atoms")))
    members = cages.select(*K, "cage_id", F.lit("cage").alias("family"), F.explode("waters").alias("atom")).unionByName(held.select(*K, "cage_id", F.lit("guest").alias("family"), F.col("guest").alias("atom")))
    grouped = members.join(tag, [*K, "cage_id"]).groupBy(*K, "family", *own).agg(listed("atom").alias("atoms")).join(order, K)
    return out.unionByName(rows(grouped, "M", family=F.col("family"), atom_indices=F.col("atoms"), **own))
