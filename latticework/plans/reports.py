"""Reports, patches and further neighbour modes over the placed polyhedra and the point frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import cages, neighbors, order, patches, rings, select
from latticework.operators import tables as report
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K
from latticework.plans import points, polyhedra
from latticework.plans.polyhedra import _found, _rings
from latticework.sources import adapters, structures

_TYPES = ["4^6", "4^6-6^2", "512", "4^6-6^8"]
#: Radius of the neighbour modes that don't follow the graph.
WIDE = 0.15


def _site(node: Column) -> Column:
    return F.floor(node / 64)


def _shape(found: DataFrame, shape: int) -> DataFrame:
    """Rings of the sites of one shape."""
    return checkpoint(found.where(_site(F.get("nodes", F.lit(0))) % 4 == shape))


def _centers(found: DataFrame, waters: DataFrame) -> DataFrame:
    return rings.ring_centers(found, waters).select("*", *[F.lit(None).cast("double").alias(f"l{c}") for c in "xyz"])


def quasi_cages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls about the faces of truncated octahedra; those of every other site's cage are free."""
    waters, _, found, shells = _found(spark, sf_dir)
    own = _shape(found, 3)
    open_ = checkpoint(patches.find_patches(own, _centers(own, waters), base_sizes=(4, 6), side_sizes=(4, 6)))
    known = shells.where(F.floor(_site(F.get("waters", F.lit(0))) / 4) % 2 == 0)
    free = patches.free_patches(open_, known).select(*K, "patch_id", F.lit(1).alias("free"))
    return open_.join(free, [*K, "patch_id"], "left").groupBy("frame_index", "kind", "patch_type").agg(F.count("*").alias("patches"), F.count("free").alias("free"))


def layered_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half cages of dodecahedra, and all ways to grow them by one or two rings that touch."""
    waters, _, found = _rings(spark, sf_dir)
    own = _shape(found, 2)
    open_ = patches.find_patches(own, _centers(own, waters), layers=2, layer_rings=2, layer_states=10_000, exact=True)
    return open_.groupBy("frame_index", "kind", "patch_type").agg(F.count("*").alias("patches"))


def patch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose layers were cut off at two sets a patch."""
    waters, _, found = _rings(spark, sf_dir)
    own = _shape(found, 2)
    return patches.patches_and_warnings(own, _centers(own, waters), layers=2, layer_rings=2, layer_states=2, exact=True)[1].select("frame_index", "warning")


def closed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of half cages with the same rim: six for each dodecahedron."""
    waters, _, found = _rings(spark, sf_dir)
    own = _shape(found, 2)
    made = patches.closed_pairs(checkpoint(patches.find_patches(own, _centers(own, waters))), own)
    return made.groupBy("frame_index", F.size("rings").alias("faces")).agg(F.count("*").alias("pairs"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide summary of frames: connections, rings, cages, guests."""
    waters, guests, found, shells = _found(spark, sf_dir)
    edges = checkpoint(neighbors.oo_edges(waters))
    held = checkpoint(cages.occupancy(shells, found, waters, guests))
    kinds = cages.compositions(shells, held, guests)
    heads = waters.select(*K).distinct().select(*K, F.format_string("frame %d", "frame_index").alias("frame"), F.col("frame_index").cast("double").alias("time_ps"), F.lit("supplier").alias("source"))
    used = shells.select(*K, F.explode("rings").alias("ring_id"))
    parts = [report.connection_columns(waters, edges, "oo"), report.ring_columns(found, used), report.cage_columns(kinds), report.breakdown(kinds, "cage_type", "cage_types", ";"), report.guest_order(guests)]
    rows = report.summary(heads, *parts)
    names = ["connection_count", "oo_connection_count", "coordination_3", "coordination_gt4", "ring4", "ring5", "ring6", "ring7", "free_ring6", "cage_512", "cage_51262", "cage_total", "cage_empty", "cage_occupied", "cage_types", "guest_order", "status"]
    return rows.select("frame_index", "frame", "time_ps", "source", F.round("mean_coordination", 6).alias("mean_coordination"), F.round("coordination_3_fraction", 6).alias("coordination_3_fraction"), *names)


def report_isomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isomers by type, those of other frames as well."""
    _, _, found, shells = _found(spark, sf_dir)
    made = report.isomer_table(cages.isomers(shells, found), _TYPES, zero_rows=True)
    return made.select("frame_index", "isomer", *[F.col(f"`{t}`").alias(f"n_{k}") for k, t in enumerate(_TYPES)], "total")


def report_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cages of the reported types alone; free rings still know all cages."""
    _, _, found, shells = _found(spark, sf_dir)
    shown = cages.reported(shells, cages.report_types("II, 4^6")).groupBy("frame_index").agg(F.count("*").alias("cages"))
    free = rings.free_rings(found, shells.select(*K, F.explode("rings").alias("ring_id")).distinct()).groupBy("frame_index").agg(F.count("*").alias("free"))
    return shown.join(free, "frame_index", "full").na.fill(0)


def cage_occupancy_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guests in the polyhedron or near the centre."""
    waters, guests, found, shells = _found(spark, sf_dir)
    held = cages.occupancy(shells, found, waters, guests, mode="auto", radius=0.3)
    return held.groupBy("frame_index").agg(F.count("*").alias("held"), F.countDistinct("cage_id").alias("occupied"))


def cage_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the occupied dodecahedra as atoms."""
    waters, guests, found, shells = _found(spark, sf_dir)
    kinds = cages.compositions(shells, cages.occupancy(shells, found, waters, guests), guests)
    heads = waters.groupBy(*K).agg(*[F.first(f"l{c}").alias(f"l{c}") for c in "xyz"]).select("*", F.lit("f").alias("frame"), F.lit(0.0).alias("time_ps"), F.lit("s").alias("source"))
    made = structures.cage_atoms(cages.cage_centers(shells, waters), kinds, heads, "512", True)
    return made.select("frame_index", "resname", "atomname", F.round("x", 6).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def member_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a membership file: frames, centres, guests, components, members."""
    waters, guests, found, shells = _found(spark, sf_dir)
    held = checkpoint(cages.occupancy(shells, found, waters, guests))
    groups = cages.clusters(shells)
    statuses = shells.select(*K, "cage_id", "cage_type", F.lit(None).cast("string").alias("phase"), F.lit(None).cast("long").alias("domain"), F.lit("isolated").alias("status"))
    atoms = waters.select(*K, F.col("node").alias("atom"))
    part = atoms.select(*K, "atom", F.lit("water").alias("role"), F.lit("SOL").alias("resname")).unionByName(guests.select(*K, F.col("node").alias("atom"), F.lit("guest").alias("role"), "resname"))
    rows = report.render_members(waters.select(*K, F.lit(0.0).alias("time_ps")).distinct(), cages.cage_centers(shells, waters), statuses, groups, shells, held, guests, atoms, part, "oo")
    return rows.groupBy("record", "render_frame").agg(F.count("*").alias("records"), F.sum(F.when(F.col("atom_indices") != "-", F.size(F.split("atom_indices", ","))).otherwise(0)).alias("atoms"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order parameters of each water in one table."""
    nodes, r = adapters.points(spark, sf_dir), points.cutoff(spark, sf_dir)
    made = report.per_water(nodes, f3=order.f3_within(nodes, r), f4=order.f4_within(nodes, r), ql=order.ql_within(nodes, r, (4, 6)))
    return made.select("frame_index", "node", *[F.round(c, 6).alias(c) for c in ("f3", "f4", "q4", "q6")], "neighbors")


def order_ql_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ql over all waters within a radius."""
    nodes = adapters.points(spark, sf_dir)
    found = order.ql_by_mode(nodes, nodes.select(*K).limit(0), (4, 6), "cutoff", None, WIDE)
    return found.select("frame_index", "node", "neighbors", F.round("q4", 6).alias("q4"), F.round("q6", 6).alias("q6"))


def order_ql_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which half of the waters or more have fewer than six neighbours within the radius."""
    nodes = adapters.points(spark, sf_dir)
    found = order.ql_by_mode(nodes, nodes.select(*K).limit(0), (6,), "lammps", 6, WIDE)
    return order.shortfalls(found, 6).select("frame_index", "short", "waters")


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and counts of F3 and Ql, of all waters and of every third one."""
    nodes, r = adapters.points(spark, sf_dir), points.cutoff(spark, sf_dir)
    focus = nodes.where("node % 3 = 0").select(*K, "node")
    f3 = report.mean_columns(order.f3_within(nodes, r), "f3", "F3", focus)
    q6 = report.mean_columns(order.ql_within(nodes, r, (6,)), "q6", "q6", focus)
    rows = f3.join(q6, K)
    return rows.select("frame_index", *[F.round(c, 6).alias(c) if c.endswith("mean") else F.col(c) for c in rows.columns if c not in K])


def guest_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guests of lineitem's molecules by the name of their centre atom, else without one."""
    atoms = adapters.molecules(spark, sf_dir).withColumn("frame_index", (F.col("resid") % 8).cast("int"))
    found = select.select_guests(select.residues(atoms), ("3-MEDIUM", "5-LOW"), {"3-MEDIUM": ("N",)})
    return found.groupBy("frame_index", "resname").agg(F.count("*").alias("guests"), F.count("center").alias("centred"), F.sum(F.size("atoms")).alias("atoms"))


def molecule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules by an explicit id, which here is the part: atoms of one molecule are apart from each other."""
    atoms = adapters.molecules(spark, sf_dir).withColumn("frame_index", (F.col("resid") % 8).cast("int")).withColumn("molecule_id", (F.col("atom.l_partkey") % 50).cast("int"))
    blocks = select.molecules(atoms)
    return blocks.groupBy("frame_index", "resname").agg(F.countDistinct("block").alias("molecules"), F.count("*").alias("atoms"))


def atom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms by residue name, a column each."""
    atoms = adapters.molecules(spark, sf_dir).withColumn("frame_index", (F.col("resid") % 8).cast("int"))
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    made = report.molecule_columns(atoms, names)
    return made.select("frame_index", *[F.col(f"`mol_{n}`").alias(f"mol_{k}") for k, n in enumerate(names)], "mol_TOTAL")


FIXED = (quasi_cages, layered_patches, patch_limits, closed_pairs, report_summary, report_isomers, report_types, cage_occupancy_auto, cage_structures, member_records, order_rows, order_ql_cutoff, order_ql_shortfall, order_summary, guest_centers, molecule_ids, atom_counts)

_S = polyhedra._SITES
_WIDE_POINTS = {n: points.SQL[n].replace(points._SHRINKING, f"r AS (SELECT {WIDE}::DOUBLE AS cut),\n") for n in ("order_ql", "order_ql_nearest")}
_ISOMERS = [("plain", ("0", "-", "2", "-")), ("2x6sep", ("-", "1", "-", "-")), ("6n8e12d33333333", ("-", "-", "-", "3"))]


def _isomer_sql() -> str:
    def cell(shape: str) -> str:
        return "'-'" if shape == "-" else f"count(*) FILTER (shape = {shape})::VARCHAR"

    known = "EXISTS (SELECT 1 FROM sites WHERE shape IN ({}))"
    parts = []
    for name, shown in _ISOMERS:
        shapes = ", ".join(s for s in shown if s != "-")
        # a type that no frame has shows no isomer
        cells = [c if c == "'-'" else f"CASE WHEN {known.format(shown[k])} THEN {c} ELSE '-' END" for k, c in enumerate(map(cell, shown))]
        parts.append(f"SELECT frame_index, '{name}' AS isomer, " + ", ".join(f"{c} AS n_{k}" for k, c in enumerate(cells)) + f", count(*) FILTER (shape IN ({shapes})) AS total FROM sites GROUP BY frame_index HAVING {known.format(shapes)}")
    parts.append("SELECT frame_index, 'total', " + ", ".join(f"count(*) FILTER (shape = {k})::VARCHAR" for k in range(4)) + ", count(*) FROM sites GROUP BY frame_index")
    return _S + " UNION ALL ".join(parts)


_MOLECULES = "WITH atoms AS (SELECT (l_orderkey % 8)::INTEGER AS f, l_orderkey, l_partkey, coalesce(o_orderpriority, 'NONE') AS resname, l_returnflag AS a FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) "
SQL = {
    "quasi_cages": _S + "SELECT frame_index, 'quasi' AS kind, t AS patch_type, n * count(*) AS patches, n * count(*) FILTER (site // 4 % 2 = 1) AS free FROM sites, (VALUES ('qc_4r_6⁴₆₆₆₆', 6), ('qc_6r_4³6³₄₆₄₆₄₆', 8)) p(t, n) WHERE shape = 3 GROUP BY frame_index, t, n",
    "layered_patches": _S + "SELECT frame_index, k AS kind, t AS patch_type, n * count(*) AS patches FROM sites, (VALUES ('half', 'hc_5r_5⁵', 12), ('quasi', 'qc_5r_5⁵₅₅₅₅₅_5¹₅', 60), ('quasi', 'qc_5r_5⁵₅₅₅₅₅_5²₅₅', 30)) p(k, t, n) WHERE shape = 2 GROUP BY frame_index, k, t, n",
    "patch_limits": _S + "SELECT DISTINCT frame_index, 'layer states' AS warning FROM sites WHERE shape = 2",
    "closed_pairs": _S + "SELECT frame_index, 12 AS faces, 6 * count(*) AS pairs FROM sites WHERE shape = 2 GROUP BY frame_index",
    "report_summary": _S + """SELECT frame_index, 'frame ' || frame_index AS frame, frame_index::DOUBLE AS time_ps, 'supplier' AS source, 3.0::DOUBLE AS mean_coordination, 1.0::DOUBLE AS coordination_3_fraction, sum(edges)::BIGINT AS connection_count, sum(edges)::BIGINT AS oo_connection_count,
  sum(waters)::BIGINT AS coordination_3, 0::BIGINT AS coordination_gt4, sum(rings4)::BIGINT AS ring4, sum(rings5)::BIGINT AS ring5, sum(rings6)::BIGINT AS ring6, 0::BIGINT AS ring7, sum(free6)::BIGINT AS free_ring6, count(*) FILTER (shape = 2) AS cage_512, 0::BIGINT AS cage_51262, count(*) AS cage_total,
  count(*) FILTER (guests = 0) AS cage_empty, count(*) FILTER (guests > 0) AS cage_occupied, (SELECT string_agg(x.cage_type || ':' || x.n, ';' ORDER BY x.cage_type) FROM (SELECT frame_index AS f, cage_type, count(*) AS n FROM sites GROUP BY ALL) x WHERE x.f = frame_index) AS cage_types,
  CASE WHEN sum(guests) > 0 THEN 'CH4' ELSE '' END AS guest_order, 'ok' AS status FROM sites GROUP BY frame_index""",
    "report_isomers": _isomer_sql(),
    "report_types": _S + "SELECT frame_index, cages, free FROM (SELECT frame_index, count(*) FILTER (cage_type IN ('512', '4^6')) AS cages, sum(free6)::BIGINT AS free FROM sites GROUP BY frame_index) WHERE cages > 0 OR free > 0",
    "cage_occupancy_auto": polyhedra.SQL["cage_occupancy_center"],
    "cage_structures": _S + "SELECT frame_index, 'CNT' AS resname, '512' AS atomname, round(site * 3.0::DOUBLE, 6) AS x, 0.0::DOUBLE AS y FROM sites WHERE shape = 2 AND guests > 0".replace("round(site * 3.0::DOUBLE, 6)", "round(site * 3.0::DOUBLE + 0.0, 6)"),
    "member_records": _S + """, per AS (SELECT frame_index, (dense_rank() OVER (ORDER BY frame_index) - 1)::INTEGER AS render_frame, count(*) AS n, sum(guests)::BIGINT AS g, sum(waters)::BIGINT AS w, count(*) FILTER (guests > 0) AS o FROM sites GROUP BY frame_index)
SELECT 'F' AS record, render_frame, 1::BIGINT AS records, 0::BIGINT AS atoms FROM per UNION ALL SELECT 'C', render_frame, n, 0 FROM per UNION ALL SELECT 'G', render_frame, g, g FROM per WHERE g > 0
UNION ALL SELECT 'P', render_frame, 1 + (g > 0)::INTEGER, w + g FROM per WHERE render_frame = 0 UNION ALL SELECT 'M', render_frame, n + o, w + g FROM per""",
    "order_rows": f"SELECT a.frame_index, a.node, f3, f4, q4, q6, neighbors FROM ({points.SQL['order_f3']}) a JOIN ({points.SQL['order_f4']}) b ON a.frame_index = b.frame_index AND a.node = b.node JOIN ({points.SQL['order_ql']}) c ON a.frame_index = c.frame_index AND a.node = c.node",
    "order_ql_cutoff": _WIDE_POINTS["order_ql"],
    "order_ql_shortfall": f"SELECT frame_index, count(*) FILTER (neighbors < 6) AS short, count(*) AS waters FROM ({_WIDE_POINTS['order_ql']}) GROUP BY frame_index HAVING count(*) FILTER (neighbors < 6) >= 0.5 * count(*)",
    "order_summary": points._sql(f"""SELECT p.f AS frame_index, round(avg(f3), 6) AS "F3_mean", count(f3) AS "F3_count", round(avg(f3) FILTER (p.n % 3 = 0), 6) AS "F3_focus_mean", count(f3) FILTER (p.n % 3 = 0) AS "F3_focus_count",
  round(avg(q6), 6) AS q6_mean, count(q6) AS q6_count, round(avg(q6) FILTER (p.n % 3 = 0), 6) AS q6_focus_mean, count(q6) FILTER (p.n % 3 = 0) AS q6_focus_count
  FROM pts p LEFT JOIN f3 ON f3.f = p.f AND f3.a = p.n LEFT JOIN ql ON ql.f = p.f AND ql.a = p.n GROUP BY p.f""", points._F3, f"ql AS (SELECT f, a, sqrt(greatest(0, avg({points._P6}))) AS q6 FROM (SELECT p.f, p.a, {points._COS} AS c {points._PAIRS}) GROUP BY f, a)"),
    "guest_centers": _MOLECULES + "SELECT f AS frame_index, resname, count(*) AS guests, count(*) FILTER (c > 0 AND resname = '3-MEDIUM') AS centred, sum(n)::BIGINT AS atoms FROM (SELECT f, l_orderkey, resname, count(*) AS n, count(*) FILTER (a = 'N') AS c FROM atoms WHERE resname IN ('3-MEDIUM', '5-LOW') GROUP BY ALL) GROUP BY f, resname",
    "molecule_ids": _MOLECULES + "SELECT f AS frame_index, resname, count(DISTINCT l_partkey % 50) AS molecules, count(*) AS atoms FROM atoms GROUP BY f, resname",
    "atom_counts": _MOLECULES + "SELECT f AS frame_index, " + ", ".join(f"count(*) FILTER (resname = '{n}') AS mol_{k}" for k, n in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) + ', count(*) AS "mol_TOTAL" FROM atoms GROUP BY f',
}
