"""Queries over the point frames, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import graphs, neighbors, order, rings
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, joined
from latticework.sources import adapters
from latticework.sources.adapters import frames, points

_RADIUS: ContextVar[float | None] = ContextVar("radius", default=None)


def cutoff(spark: SparkSession, sf_dir: str) -> float:
    """The cutoff of the SQL, which shrinks with the table's rows, unless a fixed one is set."""
    fixed = _RADIUS.get()
    return adapters.cutoff(spark, sf_dir) if fixed is None else fixed


def at_fixed_cutoff(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with CUTOFF at any number of rows, so that a frame's result depends on that frame alone."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _RADIUS.set(adapters.CUTOFF)
        try:
            return query(spark, sf_dir)
        finally:
            _RADIUS.reset(before)

    run.__name__ = run.__qualname__ = f"fixed_{query.__name__}"
    return run


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = points(spark, sf_dir)
    return nodes, checkpoint(neighbors.oo_edges(nodes, cutoff(spark, sf_dir)))  # every operator reads the edges several times


def _guests(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.where("node % 7 = 0"), nodes.where("node % 7 <> 0")


def cutoff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _edges(spark, sf_dir)
    return edges.select("frame_index", "u", "v", F.round("dist", 6).alias("dist"))


def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    guests, waters = _guests(points(spark, sf_dir))
    found = neighbors.cross_cutoff_pairs(guests, waters, cutoff(spark, sf_dir))
    return found.select("frame_index", F.col("u").alias("guest"), F.col("v").alias("water"), F.round("dist", 6).alias("dist"))


def hbond_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.hbond_edges(points(spark, sf_dir), cutoff(spark, sf_dir), 60.0).select("frame_index", "u", "v")


def coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    degree = graphs.degrees(nodes, edges).groupBy("frame_index")
    counts = [F.count_if(F.col("degree") == k).alias(f"coord_{k}") for k in range(5)]
    return degree.agg(F.count("*").alias("waters"), *counts, F.count_if(F.col("degree") > 4).alias("coord_more"), F.round(F.avg("degree"), 6).alias("mean"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    return graphs.adjacency(nodes, edges).select("frame_index", "node", joined("neighbors").alias("neighbors"))


def node_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    return graphs.components(nodes, edges).select("frame_index", "node", "component")


def core_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.core_within(points(spark, sf_dir), cutoff(spark, sf_dir)).select("frame_index", "u", "v")


def chordless_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.find_rings(_edges(spark, sf_dir)[1])
    return found.select("frame_index", "ring_id", "size", joined("nodes").alias("nodes"))


def all_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.find_rings(_edges(spark, sf_dir)[1], sizes=(4, 5), chordless=False)
    return found.select("frame_index", "size", joined("nodes").alias("nodes"))


def shortest_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.find_rings(_edges(spark, sf_dir)[1], shortest=True)
    return found.select("frame_index", "size", joined("nodes").alias("nodes"))


def ring_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rings.ring_edges(rings.find_rings(_edges(spark, sf_dir)[1]))
    return found.groupBy("frame_index", "u", "v").agg(F.count("*").alias("rings"), F.array_join(F.array_sort(F.collect_list("ring_id")), " ").alias("ring_ids"))


def ring_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    found = rings.ring_centers(rings.find_rings(edges), nodes)
    return found.select("frame_index", "ring_id", *[F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"])


def order_f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.f3_within(points(spark, sf_dir), cutoff(spark, sf_dir)).select("frame_index", "node", F.round("f3", 6).alias("f3"))


def order_f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.f4_within(points(spark, sf_dir), cutoff(spark, sf_dir)).select("frame_index", "node", F.round("f4", 6).alias("f4"))


def order_ql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ql_within(points(spark, sf_dir), cutoff(spark, sf_dir), (4, 6)).select("frame_index", "node", "neighbors", F.round("q4", 6).alias("q4"), F.round("q6", 6).alias("q6"))


def order_ql_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ql_within(points(spark, sf_dir), cutoff(spark, sf_dir), (6,), nearest=3).select("frame_index", "node", "neighbors", F.round("q6", 6).alias("q6"))


def order_mcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir)
    guests, waters = _guests(nodes)
    r = cutoff(spark, sf_dir)
    edges = checkpoint(order.mcg_edges(guests, waters, 3 * r, 2.5 * r, 60.0, 2))
    made = [order.mcg(frames(nodes), edges, k).select(F.lit(f"MCG-{k}").alias("name"), "frame_index", "largest", "eligible", joined("members").alias("members")) for k in (1, 3)]
    return made[0].unionByName(made[1])


def order_dhop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    angles = (35.0, 30.0)
    counted = checkpoint(order.dhop_counts_within(nodes, cutoff(spark, sf_dir), angles))
    known = [counted.select(*K, "node", F.col(f"events_{k}").alias("events")) for k in range(len(angles))]
    made = [order.dhop(frames(nodes), nodes, edges, a, tuple(range(1, 13)), 1, events).select(F.lit(f"DHOP{a:.0f}").alias("name"), "frame_index", "largest", "eligible", joined("members").alias("members")) for a, events in zip(angles, known, strict=True)]
    return made[0].unionByName(made[1])


def ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    return order.ice_classes(nodes, edges, None, 1).select("frame_index", "node", "ice")


def order_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and counts of F3 over all waters and a focus set."""
    rows = order.f3_within(points(spark, sf_dir), cutoff(spark, sf_dir))
    focus = F.when(F.col("node") % 3 == 0, F.col("f3"))
    return rows.groupBy("frame_index").agg(F.round(F.avg("f3"), 6).alias("mean"), F.count("f3").alias("valid"), F.round(F.avg(focus), 6).alias("focus_mean"), F.count(focus).alias("focus_valid"))


_AT_CUTOFF = (cutoff_pairs, cross_pairs, hbond_pairs, coordination, adjacency, node_components, core_edges, chordless_rings, all_rings, shortest_rings, ring_incidence, ring_centers, order_f3, order_f4, order_ql, order_ql_nearest, order_mcg, order_dhop, ice, order_means)
FIXED = (*_AT_CUTOFF, *map(at_fixed_cutoff, _AT_CUTOFF))

_POINTS = """r AS (SELECT 0.12 * pow(least(1.0, 500.0 / greatest(1, count(*))), 1.0 / 3.0) AS cut FROM embeddings),
pts AS (SELECT label::INTEGER AS f, vec_id AS n, embedding[1]::DOUBLE + 0.5 AS x, embedding[2]::DOUBLE + 0.5 AS y, embedding[3]::DOUBLE + 0.5 AS z FROM embeddings),
deltas AS (SELECT a.f, a.n AS u, b.n AS v, (b.x - a.x) - round_even(b.x - a.x, 0) AS dx, (b.y - a.y) - round_even(b.y - a.y, 0) AS dy, (b.z - a.z) - round_even(b.z - a.z, 0) AS dz FROM pts a JOIN pts b ON a.f = b.f AND a.n <> b.n),
near AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM deltas, r WHERE sqrt(dx * dx + dy * dy + dz * dz) <= cut),
edges AS (SELECT * FROM near WHERE u < v), way AS (SELECT f, u AS a, v AS b, dx, dy, dz, dist FROM near)"""
_RINGS = """paths AS (
  SELECT f, [a, b] AS p FROM way WHERE a < b
  UNION ALL
  SELECT p.f, list_append(p.p, w.b) FROM paths p JOIN way w ON w.f = p.f AND w.a = p.p[-1]
  WHERE len(p.p) < 6 AND w.b > p.p[1] AND NOT list_contains(p.p, w.b)
    AND NOT EXISTS (SELECT 1 FROM way c WHERE c.f = p.f AND c.a = w.b AND c.b <> p.p[-1] AND c.b <> p.p[1] AND list_contains(p.p, c.b))
    AND (len(p.p) < 3 OR NOT EXISTS (SELECT 1 FROM way c WHERE c.f = p.f AND c.a = p.p[-1] AND c.b = p.p[1]))
), rings AS (
  SELECT p.f, len(p.p)::INTEGER AS size, p.p AS nodes, row_number() OVER (PARTITION BY p.f, len(p.p) ORDER BY p.p) AS k
  FROM paths p JOIN way c ON c.f = p.f AND c.a = p.p[-1] AND c.b = p.p[1] WHERE len(p.p) >= 4 AND p.p[2] < p.p[-1]
)"""
_REACH = """reach AS (SELECT f, n, n AS m FROM {nodes} UNION SELECT r.f, r.n, w.{b} FROM reach r JOIN {links} w ON w.f = r.f AND w.{a} = r.m)"""
_HYDROGENS = """hyd AS (SELECT label::INTEGER AS f, vec_id AS n, k, [embedding[3 * k + 1]::DOUBLE, embedding[3 * k + 2]::DOUBLE, embedding[3 * k + 3]::DOUBLE] AS e FROM embeddings, (SELECT unnest([1, 2]) AS k)),
h AS (SELECT f, n, k, e[1] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) * 0.1 AS hx, e[2] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) * 0.1 AS hy, e[3] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) * 0.1 AS hz FROM hyd)"""


def _sql(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive or _RINGS in parts else ''}{', '.join([_POINTS, *parts])} {body}"


def _cluster_sql(name: str, nodes: str, links: str) -> str:
    """Largest component of nodes(f, n) under links(f, a, b), by frame."""
    return f"""{name}_reach AS (SELECT f, n, n AS m FROM {nodes} UNION SELECT r.f, r.n, w.b FROM {name}_reach r JOIN {links} w ON w.f = r.f AND w.a = r.m),
{name}_label AS (SELECT f, n, min(m) AS c FROM {name}_reach GROUP BY f, n),
{name}_size AS (SELECT f, c, count(*) AS size, array_to_string(list(n ORDER BY n), ' ') AS members, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, c) AS k FROM {name}_label GROUP BY f, c),
{name} AS (SELECT f.f, coalesce(s.size, 0) AS largest, (SELECT count(*) FROM {nodes} e WHERE e.f = f.f) AS eligible, coalesce(s.members, '') AS members FROM (SELECT DISTINCT f FROM pts) f LEFT JOIN {name}_size s ON s.f = f.f AND s.k = 1)"""


def _dhop_sql(name: str, angle: str) -> str:
    return f"""{name}_ev AS (
  SELECT e.f, e.u, e.v, count(*) AS ev FROM edges e
  JOIN way p ON p.f = e.f AND p.a = e.u AND p.b <> e.v JOIN way q ON q.f = e.f AND q.a = e.v AND q.b <> e.u,
  LATERAL (SELECT p.dy * e.dz - p.dz * e.dy AS mx, p.dz * e.dx - p.dx * e.dz AS my, p.dx * e.dy - p.dy * e.dx AS mz,
    -e.dy * q.dz + e.dz * q.dy AS nx, -e.dz * q.dx + e.dx * q.dz AS ny, -e.dx * q.dy + e.dy * q.dx AS nz) x
  WHERE (mx * nx + my * ny + mz * nz) / (sqrt(mx * mx + my * my + mz * mz) * sqrt(nx * nx + ny * ny + nz * nz)) >= cos(radians({angle})) GROUP BY e.f, e.u, e.v
), {name}_q AS (SELECT f, n FROM (SELECT f, u AS n, ev FROM {name}_ev UNION ALL SELECT f, v, ev FROM {name}_ev) GROUP BY f, n HAVING sum(ev) BETWEEN 1 AND 12),
{name}_s AS (SELECT w.f, w.a AS n FROM way w JOIN {name}_q x ON x.f = w.f AND x.n = w.a JOIN {name}_q y ON y.f = w.f AND y.n = w.b GROUP BY w.f, w.a),
{name}_t AS (SELECT f, n FROM {name}_s UNION SELECT w.f, w.b FROM way w JOIN {name}_s s ON s.f = w.f AND s.n = w.a),
{name}_w AS (SELECT w.f, w.a, w.b FROM way w JOIN {name}_t x ON x.f = w.f AND x.n = w.a JOIN {name}_t y ON y.f = w.f AND y.n = w.b)"""


_MCG = """gw AS (SELECT d.f, d.u AS g, d.v AS w, dx, dy, dz FROM deltas d, r WHERE d.u % 7 = 0 AND d.v % 7 <> 0 AND dx * dx + dy * dy + dz * dz <= (2.5 * cut) * (2.5 * cut)),
gg AS (SELECT d.f, d.u, d.v, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM deltas d, r WHERE d.u < d.v AND d.u % 7 = 0 AND d.v % 7 = 0 AND dx * dx + dy * dy + dz * dz <= (3 * cut) * (3 * cut)),
ge AS (
  SELECT gg.f, gg.u, gg.v FROM gg JOIN gw a ON a.f = gg.f AND a.g = gg.u JOIN gw b ON b.f = gg.f AND b.g = gg.v AND b.w = a.w
  WHERE (a.dx * gg.dx + a.dy * gg.dy + a.dz * gg.dz) / (sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz) * dist) >= cos(radians(60))
    AND -(b.dx * gg.dx + b.dy * gg.dy + b.dz * gg.dz) / (sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz) * dist) >= cos(radians(60))
  GROUP BY gg.f, gg.u, gg.v HAVING count(*) >= 2
), gway AS (SELECT f, u AS a, v AS b FROM ge UNION ALL SELECT f, v, u FROM ge),
one_n AS (SELECT f, a AS n FROM gway GROUP BY f, a), three_n AS (SELECT f, a AS n FROM gway GROUP BY f, a HAVING count(*) >= 3),
three_w AS (SELECT w.* FROM gway w JOIN three_n x ON x.f = w.f AND x.n = w.a JOIN three_n y ON y.f = w.f AND y.n = w.b)"""
_PAIRS = "FROM way p JOIN way q ON p.f = q.f AND p.a = q.a"
_COS = "(p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (sqrt(p.dx * p.dx + p.dy * p.dy + p.dz * p.dz) * sqrt(q.dx * q.dx + q.dy * q.dy + q.dz * q.dz))"
_P6 = "(231 * pow(c, 6) - 315 * pow(c, 4) + 105 * pow(c, 2) - 5) / 16"
_P4 = "(35 * pow(c, 4) - 30 * pow(c, 2) + 3) / 8"
_F3 = f"f3 AS (SELECT f, a, avg(pow(c * abs(c) + pow(cos(radians(109.47)), 2), 2)) AS f3 FROM (SELECT p.f, p.a, {_COS} AS c {_PAIRS} AND p.b < q.b) GROUP BY f, a)"
_DIHEDRAL = """hh AS (
  SELECT w.f, w.a, w.b, w.dx, w.dy, w.dz, p.hx AS px, p.hy AS py, p.hz AS pz, q.hx AS qx, q.hy AS qy, q.hz AS qz,
    row_number() OVER (PARTITION BY w.f, w.a, w.b ORDER BY pow(ex - round_even(ex, 0), 2) + pow(ey - round_even(ey, 0), 2) + pow(ez - round_even(ez, 0), 2) DESC, p.k, q.k) AS rk
  FROM way w JOIN h p ON p.f = w.f AND p.n = w.a JOIN h q ON q.f = w.f AND q.n = w.b, LATERAL (SELECT w.dx + q.hx - p.hx AS ex, w.dy + q.hy - p.hy AS ey, w.dz + q.hz - p.hz AS ez) e
), ax AS (SELECT *, dx / s AS ax, dy / s AS ay, dz / s AS az FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS s FROM hh WHERE rk = 1)),
fl AS (SELECT f, a, ax, ay, az, px - t * ax AS vx, py - t * ay AS vy, pz - t * az AS vz, qx - o * ax AS wx, qy - o * ay AS wy, qz - o * az AS wz FROM (SELECT *, px * ax + py * ay + pz * az AS t, qx * ax + qy * ay + qz * az AS o FROM ax)),
f4 AS (SELECT f, a, avg(cos(3 * atan2((ay * vz - az * vy) * wx + (az * vx - ax * vz) * wy + (ax * vy - ay * vx) * wz, vx * wx + vy * wy + vz * wz))) AS f4 FROM fl GROUP BY f, a)"""

SQL = {
    "cutoff_pairs": _sql("SELECT f AS frame_index, u, v, round(dist, 6) AS dist FROM edges"),
    "cross_pairs": _sql("SELECT f AS frame_index, u AS guest, v AS water, round(dist, 6) AS dist FROM near WHERE u % 7 = 0 AND v % 7 <> 0"),
    "hbond_pairs": _sql("SELECT DISTINCT e.f AS frame_index, e.u, e.v FROM edges e JOIN h ON h.f = e.f AND h.n IN (e.u, e.v) WHERE (CASE WHEN h.n = e.u THEN 1 ELSE -1 END) * (hx * dx + hy * dy + hz * dz) >= dist * sqrt(hx * hx + hy * hy + hz * hz) * cos(radians(60))", _HYDROGENS),
    "coordination": _sql("SELECT f AS frame_index, count(*) AS waters, " + ", ".join(f"count(*) FILTER (d = {k}) AS coord_{k}" for k in range(5)) + ", count(*) FILTER (d > 4) AS coord_more, round(avg(d), 6) AS mean FROM (SELECT p.f, p.n, count(w.b) AS d FROM pts p LEFT JOIN way w ON w.f = p.f AND w.a = p.n GROUP BY p.f, p.n) GROUP BY f"),
    "adjacency": _sql("SELECT p.f AS frame_index, p.n AS node, coalesce(array_to_string(list(w.b ORDER BY w.b) FILTER (w.b IS NOT NULL), ' '), '') AS neighbors FROM pts p LEFT JOIN way w ON w.f = p.f AND w.a = p.n GROUP BY p.f, p.n"),
    "node_components": _sql("SELECT f AS frame_index, n AS node, min(m) AS component FROM reach GROUP BY f, n", _REACH.format(nodes="pts", links="way", a="a", b="b"), recursive=True),
    "chordless_rings": _sql("SELECT f AS frame_index, printf('ring%d_%05d', size, k) AS ring_id, size, array_to_string(nodes, ' ') AS nodes FROM rings", _RINGS),
    "shortest_rings": _sql("""SELECT f AS frame_index, size, array_to_string(nodes, ' ') AS nodes FROM rings g WHERE size < 6 OR NOT EXISTS (
  SELECT 1 FROM (SELECT unnest([1, 2, 3]) AS i) t JOIN way a ON a.f = g.f AND a.a = g.nodes[t.i] JOIN way b ON b.f = g.f AND b.a = a.b AND b.b = g.nodes[t.i + 3])""", _RINGS),
    "ring_incidence": _sql("""SELECT f AS frame_index, u, v, count(*) AS rings, array_to_string(list(id ORDER BY id), ' ') AS ring_ids FROM (
  SELECT f, printf('ring%d_%05d', size, k) AS id, least(nodes[i], nodes[i % size + 1]) AS u, greatest(nodes[i], nodes[i % size + 1]) AS v FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM rings)) GROUP BY f, u, v""", _RINGS),
    "ring_centers": _sql("""SELECT s.f AS frame_index, id AS ring_id, """ + ", ".join(f"round(p.{c} + avg(o{c}), 6) AS c{c}" for c in "xyz") + """ FROM (
  SELECT g.f, g.id, g.first, g.i, """ + ", ".join(f"sum(coalesce(w.d{c}, 0)) OVER (PARTITION BY g.f, g.id ORDER BY g.i) AS o{c}" for c in "xyz") + """ FROM (SELECT f, printf('ring%d_%05d', size, k) AS id, nodes[1] AS first, i, nodes[i - 1] AS a, nodes[i] AS b FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM rings)) g
  LEFT JOIN way w ON w.f = g.f AND w.a = g.a AND w.b = g.b AND g.i > 1) s JOIN pts p ON p.f = s.f AND p.n = s.first GROUP BY s.f, id, p.x, p.y, p.z""", _RINGS),
    "order_f3": _sql("SELECT p.f AS frame_index, p.n AS node, round(f3, 6) AS f3 FROM pts p LEFT JOIN f3 ON f3.f = p.f AND f3.a = p.n", _F3),
    "order_f4": _sql("SELECT p.f AS frame_index, p.n AS node, round(f4, 6) AS f4 FROM pts p LEFT JOIN f4 ON f4.f = p.f AND f4.a = p.n", _HYDROGENS, _DIHEDRAL),
    "order_ql": _sql(f"SELECT p.f AS frame_index, p.n AS node, coalesce(k, 0) AS neighbors, round(q4, 6) AS q4, round(q6, 6) AS q6 FROM pts p LEFT JOIN ql ON ql.f = p.f AND ql.a = p.n", f"ql AS (SELECT f, a, sqrt(count(*))::BIGINT AS k, sqrt(greatest(0, avg({_P4}))) AS q4, sqrt(greatest(0, avg({_P6}))) AS q6 FROM (SELECT p.f, p.a, {_COS} AS c {_PAIRS}) GROUP BY f, a)"),
    "order_ql_nearest": _sql(f"SELECT p.f AS frame_index, p.n AS node, coalesce(k, 0) AS neighbors, round(CASE WHEN coalesce(k, 0) < 3 THEN 0.0 ELSE q6 END, 6) AS q6 FROM pts p LEFT JOIN ql ON ql.f = p.f AND ql.a = p.n", "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, a ORDER BY dist, b) AS rk FROM way) WHERE rk <= 3)", f"ql AS (SELECT f, a, sqrt(count(*))::BIGINT AS k, sqrt(greatest(0, avg({_P6}))) AS q6 FROM (SELECT p.f, p.a, {_COS} AS c FROM top p JOIN top q ON p.f = q.f AND p.a = q.a) GROUP BY f, a)"),
    "order_mcg": _sql("SELECT 'MCG-1' AS name, f AS frame_index, largest, eligible, members FROM one UNION ALL SELECT 'MCG-3', * FROM three", _MCG, _cluster_sql("one", "one_n", "gway"), _cluster_sql("three", "three_n", "three_w"), recursive=True),
    "order_dhop": _sql("SELECT 'DHOP35' AS name, f AS frame_index, largest, eligible, members FROM d35 UNION ALL SELECT 'DHOP30', * FROM d30", _dhop_sql("a35", "35"), _dhop_sql("a30", "30"), _cluster_sql("d35", "a35_t", "a35_w"), _cluster_sql("d30", "a30_t", "a30_w"), recursive=True),
    "ice": _sql("""SELECT p.f AS frame_index, p.n AS node, CASE WHEN coalesce(d, 0) = 4 AND coalesce(s, 0) > 0 THEN CASE WHEN o THEN 'ice_i' ELSE 'interfacial' END ELSE 'liquid' END AS ice
FROM pts p LEFT JOIN deg ON deg.f = p.f AND deg.n = p.n LEFT JOIN (SELECT f, n, count(*) AS s FROM (SELECT f, unnest(nodes) AS n FROM rings WHERE size = 6) GROUP BY f, n) x ON x.f = p.f AND x.n = p.n
LEFT JOIN (SELECT w.f, w.a AS n, bool_and(deg.d = 4) AS o FROM way w JOIN deg ON deg.f = w.f AND deg.n = w.b GROUP BY w.f, w.a) y ON y.f = p.f AND y.n = p.n""", _RINGS, "deg AS (SELECT f, a AS n, count(*) AS d FROM way GROUP BY f, a)"),
    "order_means": _sql("SELECT p.f AS frame_index, round(avg(f3), 6) AS mean, count(f3) AS valid, round(avg(f3) FILTER (p.n % 3 = 0), 6) AS focus_mean, count(f3) FILTER (p.n % 3 = 0) AS focus_valid FROM pts p LEFT JOIN f3 ON f3.f = p.f AND f3.a = p.n GROUP BY p.f", _F3),
}
SQL["all_rings"] = _sql("SELECT f AS frame_index, len(p)::INTEGER AS size, array_to_string(p, ' ') AS nodes FROM walks JOIN way c ON c.f = walks.f AND c.a = p[-1] AND c.b = p[1] WHERE len(p) >= 4 AND p[2] < p[-1]".replace("SELECT f AS", "SELECT walks.f AS"), "walks AS (SELECT f, [a, b] AS p FROM way WHERE a < b UNION ALL SELECT p.f, list_append(p.p, w.b) FROM walks p JOIN way w ON w.f = p.f AND w.a = p.p[-1] WHERE len(p.p) < 5 AND w.b > p.p[1] AND NOT list_contains(p.p, w.b))", recursive=True)
_PEEL = [f"peel{k} AS MATERIALIZED (SELECT p.* FROM {was} p JOIN (SELECT f, a FROM {was} GROUP BY f, a HAVING count(*) >= 2) x ON x.f = p.f AND x.a = p.a JOIN (SELECT f, a FROM {was} GROUP BY f, a HAVING count(*) >= 2) y ON y.f = p.f AND y.a = p.b)" for k, was in enumerate(["way", *[f"peel{k}" for k in range(39)]])]
SQL["core_edges"] = _sql("SELECT f AS frame_index, a AS u, b AS v FROM peel39 WHERE a < b", *_PEEL)
_SHRINKING = _POINTS[: _POINTS.index("pts AS")]
SQL |= {f"fixed_{name}": sql.replace(_SHRINKING, f"r AS (SELECT {adapters.CUTOFF}::DOUBLE AS cut),\n") for name, sql in SQL.items()}
