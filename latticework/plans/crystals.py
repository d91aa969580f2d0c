"""Queries over faulty crystals, where cages touch: clusters, neighbourhoods, phases. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import cages, phases
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K
from latticework.sources import lattices


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shells, rings = lattices.faulty_crystals(spark, sf_dir)
    return checkpoint(shells), checkpoint(rings)


def crystal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shells, _ = _made(spark, sf_dir)
    return cages.clusters(shells).groupBy("frame_index", "cluster").agg(F.count("*").alias("cages"), F.max("size").alias("size"))


def crystal_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cages of a type meet how many neighbours of another over a face."""
    shells, rings = _made(spark, sf_dir)
    found = cages.fingerprints(shells, rings)
    return found.groupBy("frame_index", "cage_type", "neighbor", "face", "n").agg(F.count("*").alias("cages"))


def crystal_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cage's neighbours against the ideal ones of a phase."""
    shells, rings = _made(spark, sf_dir)
    found = cages.phase_support(shells, rings)
    return found.select("frame_index", "cage_id", "phase", *[F.round(c, 6).alias(c) for c in ("coverage", "purity", "score")], "strict")


def _statuses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shells, rings = _made(spark, sf_dir)
    return shells, checkpoint(phases.phase_domains(shells, rings))


def crystal_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)[1].select("frame_index", "cage_id", "cage_type", "phase", "status")


def crystal_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    shells, found = _statuses(spark, sf_dir)
    return phases.domain_table(found, shells).select("frame_index", "domain_id", "cluster", "phase", "cages", "waters", "boundary", "classified_fraction")


def crystal_cluster_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    shells, found = _statuses(spark, sf_dir)
    return phases.cluster_table(found, shells).drop("group_key")


def crystal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tracking calls the cages: phase, status, or isolated."""
    shells, found = _statuses(spark, sf_dir)
    return phases.phase_labels(found, shells).select("frame_index", F.get("phases", F.lit(0)).alias("label")).groupBy("frame_index", "label").agg(F.count("*").alias("cages"))


def crystal_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the touching cages after cages of one neighbour are peeled off."""
    from latticework.operators.graphs import two_core

    shells, _ = _made(spark, sf_dir)
    ties = cages.shared_faces(shells).select(*K, F.substring("a", 2, 4).cast("long").alias("u"), F.substring("b", 2, 4).cast("long").alias("v")).distinct()
    return two_core(ties).select("frame_index", "u", "v")


FIXED = (crystal_clusters, crystal_neighbors, crystal_support, crystal_phases, crystal_domains, crystal_cluster_types, crystal_labels, crystal_cores)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_NUMBER = {p: n for n, p in enumerate(lattices.PHASES)}
_SITES = _values([(_NUMBER[p], k, t, *place) for p in lattices.PHASES for k, (t, place) in enumerate(lattices.SITES[p])])
_CELLS = _values([(_NUMBER[p], n, *unit, int(hexagonal), len(lattices.SITES[p])) for p, (n, unit, hexagonal) in lattices.CELLS.items()])
_RULES = _values([(_NUMBER[p], *rest) for p, *rest in lattices.RULES])
_IDEAL = _values([(p, t, n, f, k) for (p, t), v in cages.TEMPLATES.items() for (n, f), k in v.items()])
_WRAP = "((({a} - {b}) + {l} // 2) % {l} + {l}) % {l} - {l} // 2"
_LATTICE = f"""sites(ph, i, t, x, y, z) AS (VALUES {_SITES}), cells(ph, n, ux, uy, uz, hex, m) AS (VALUES {_CELLS}), rules(ph, a, b, p, q, s) AS (VALUES {_RULES}),
ideal(phase, t, nb, face, want) AS (VALUES {_IDEAL}),
block AS MATERIALIZED (
  SELECT c.ph, ((i.k * n + j.k) * n + l.k) * m + s.i AS num, s.t, i.k * ux + s.x AS x, j.k * uy + s.y AS y, l.k * uz + s.z AS z, n * ux AS lx, n * uy AS ly, n * uz AS lz, hex, n * n * n * m AS total
  FROM cells c JOIN sites s ON s.ph = c.ph, (SELECT unnest(range(3)) AS k) i, (SELECT unnest(range(3)) AS k) j, (SELECT unnest(range(3)) AS k) l WHERE i.k < n AND j.k < n AND l.k < n
), walls AS MATERIALIZED (
  SELECT d.ph, d.one, d.two, r.s FROM (
    SELECT a.ph, a.num AS one, b.num AS two, least(a.t, b.t) AS s1, greatest(a.t, b.t) AS s2, a.hex, {_WRAP.format(a="b.x", b="a.x", l="a.lx")} AS dx, {_WRAP.format(a="b.y", b="a.y", l="a.ly")} AS dy, {_WRAP.format(a="b.z", b="a.z", l="a.lz")} AS dz
    FROM block a JOIN block b ON a.ph = b.ph AND a.num < b.num) d
  JOIN rules r ON r.ph = d.ph AND r.a = s1 AND r.b = s2 AND r.p = CASE hex WHEN 1 THEN dx * dx + dy * dy - dx * dy ELSE dx * dx + dy * dy + dz * dz END AND r.q = CASE hex WHEN 1 THEN abs(dz) ELSE 0 END
), parts AS (
  SELECT n_nationkey::INTEGER AS f, 0 AS part, n_nationkey % 3 AS ph FROM nation UNION ALL SELECT n_nationkey::INTEGER, 1, (n_nationkey + 1) % 3 FROM nation WHERE n_nationkey % 2 = 0
), cage AS MATERIALIZED (
  SELECT p.f, p.part * 1000 + b.num AS c, CASE WHEN any_value(s.s_suppkey) IS NULL THEN b.t ELSE '{lattices.ALIEN}' END AS t
  FROM parts p JOIN block b ON b.ph = p.ph LEFT JOIN supplier s ON s.s_nationkey = p.f AND s.s_suppkey % 2 = p.part AND (s.s_suppkey * 37) % b.total = b.num
  WHERE NOT (p.f % 5 = 4 AND (b.num * b.num * 31 + b.num * 17 + p.part * 7) % 101 >= {lattices.KEPT})
  GROUP BY p.f, p.part, b.num, b.t HAVING NOT coalesce(bool_or(s.s_acctbal > 0), false)
), face AS MATERIALIZED (
  SELECT w.*, a.t AS tu, b.t AS tv FROM (
    SELECT p.f, p.part * 1000 + one AS u, p.part * 1000 + two AS v, s AS face FROM parts p JOIN walls w ON w.ph = p.ph
    UNION ALL SELECT p.f, k, 1000 + k, 5 FROM parts p, (SELECT unnest(range({lattices.INTERFACE})) AS k) WHERE p.part = 1) w
  JOIN cage a ON a.f = w.f AND a.c = w.u JOIN cage b ON b.f = w.f AND b.c = w.v
), way AS MATERIALIZED (SELECT f, u AS a, v AS b, tu AS ta, tv AS tb, face FROM face UNION ALL SELECT f, v, u, tv, tu, face FROM face),
seen AS MATERIALIZED (SELECT f, a AS c, ta AS t, tb AS nb, face, count(*) AS n FROM way GROUP BY ALL),
support AS MATERIALIZED (
  SELECT c.f, c.c, c.t, i.phase, sum(least(coalesce(s.n, 0), want)) / sum(want) AS coverage, sum(least(coalesce(s.n, 0), want)) AS met, bool_and(coalesce(s.n, 0) > 0 AND abs(coalesce(s.n, 0) - want) <= 1) AS near,
    sum(coalesce(s.n, 0)) AS known, coalesce(any_value(o.n), 0) AS observed
  FROM cage c JOIN ideal i ON i.t = c.t LEFT JOIN seen s ON s.f = c.f AND s.c = c.c AND s.nb = i.nb AND s.face = i.face LEFT JOIN (SELECT f, c, sum(n) AS n FROM seen GROUP BY f, c) o ON o.f = c.f AND o.c = c.c
  GROUP BY c.f, c.c, c.t, i.phase
), scored AS MATERIALIZED (
  SELECT *, CASE WHEN met > 0 THEN 2 * coverage * purity / (coverage + purity) ELSE 0.0 END AS score, near AND known = observed AS strict FROM (SELECT *, CASE WHEN observed > 0 THEN met / observed ELSE 0.0 END AS purity FROM support)
)"""


def _chain(name: str, first: str, step: str, rounds: int) -> str:
    """CTEs name_0 to name_rounds, each made from the one before, and name for the last. In step, {{was}} is the one before."""
    parts = [f"{name}_0 AS MATERIALIZED ({first})"] + [f"{name}_{k} AS MATERIALIZED ({step.format(was=f'{name}_{k - 1}')})" for k in range(1, rounds + 1)]
    return ",\n".join([*parts, f"{name} AS (SELECT * FROM {name}_{rounds})"])


def _labels(name: str, nodes: str, links: str, keys: str = "f", rounds: int = 24) -> str:
    """Components of nodes(keys, c) under links(keys, a, b) by least neighbours, in so many rounds."""
    same = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    step = f"SELECT {', '.join(f'x.{k}' for k in keys.split(', '))}, x.c, least(any_value(x.top), coalesce(min(y.top), any_value(x.top))) AS top FROM {{was}} x LEFT JOIN {links} l ON {same.format('l', 'x')} AND l.a = x.c LEFT JOIN {{was}} y ON {same.format('y', 'x')} AND y.c = l.b GROUP BY {', '.join(f'x.{k}' for k in keys.split(', '))}, x.c"
    return _chain(name, f"SELECT {keys}, c, c AS top FROM {nodes}", step, rounds)


# cages are ranked by type and number, and a cluster is named after its first cage
_CLUSTERS = _labels("lab", "ranked", "rway") + """,
cluster AS MATERIALIZED (SELECT r.f, r.cage, r.c AS rk, printf('c%04d', t.cage) AS cluster, count(*) OVER (PARTITION BY r.f, l.top) AS size FROM lab l JOIN ranked r ON r.f = l.f AND r.c = l.c JOIN ranked t ON t.f = l.f AND t.c = l.top)"""
_RANKED = """ranked AS MATERIALIZED (SELECT f, c AS cage, row_number() OVER (PARTITION BY f ORDER BY t, c) AS c FROM cage),
rway AS MATERIALIZED (SELECT DISTINCT w.f, x.c AS a, y.c AS b FROM way w JOIN ranked x ON x.f = w.f AND x.cage = w.a JOIN ranked y ON y.f = w.f AND y.cage = w.b)"""
_GOOD = "coverage >= 0.5 AND purity >= 0.5 AND score >= 0.55"
_PHASES = f"""tie AS MATERIALIZED (
  SELECT DISTINCT w.f, i.phase, x.c AS a, y.c AS b, w.ta, w.tb, w.face FROM way w JOIN ideal i ON i.t = w.ta AND i.nb = w.tb AND i.face = w.face JOIN ideal j ON j.phase = i.phase AND j.t = w.tb AND j.nb = w.ta AND j.face = w.face
  JOIN ranked x ON x.f = w.f AND x.cage = w.a JOIN ranked y ON y.f = w.f AND y.cage = w.b
), pway AS MATERIALIZED (SELECT DISTINCT f, phase, a, b FROM tie),
sc AS MATERIALIZED (SELECT s.* EXCLUDE (c), r.c FROM scored s JOIN ranked r ON r.f = s.f AND r.cage = s.c),
good AS MATERIALIZED (SELECT * FROM sc WHERE {_GOOD}),
{_chain("peel", "SELECT p.* FROM pway p JOIN good x ON x.f = p.f AND x.phase = p.phase AND x.c = p.a JOIN good y ON y.f = p.f AND y.phase = p.phase AND y.c = p.b",
        "SELECT p.* FROM {was} p JOIN (SELECT f, phase, a FROM {was} GROUP BY f, phase, a HAVING count(*) >= 2) x ON x.f = p.f AND x.phase = p.phase AND x.a = p.a JOIN (SELECT f, phase, a FROM {was} GROUP BY f, phase, a HAVING count(*) >= 2) y ON y.f = p.f AND y.phase = p.phase AND y.a = p.b", 12)},
corenode AS MATERIALIZED (SELECT DISTINCT f, phase, a AS c FROM peel),
{_labels("corelab", "corenode", "peel", "f, phase")},
core AS MATERIALIZED (
  SELECT l.f, l.phase, l.c, l.top FROM corelab l JOIN (
    SELECT l.f, l.phase, l.top FROM corelab l JOIN good g ON g.f = l.f AND g.phase = l.phase AND g.c = l.c GROUP BY l.f, l.phase, l.top HAVING count(*) >= 3 AND avg(g.score) >= 0.6) b ON b.f = l.f AND b.phase = l.phase AND b.top = l.top
  WHERE EXISTS (SELECT 1 FROM tie t JOIN corelab x ON x.f = t.f AND x.phase = t.phase AND x.c = t.a JOIN corelab y ON y.f = t.f AND y.phase = t.phase AND y.c = t.b
    WHERE t.f = l.f AND t.phase = l.phase AND x.top = l.top AND y.top = l.top AND t.face = 6 AND ((t.phase = 'sI' AND t.ta = '51262' AND t.tb = '51262') OR (t.phase = 'sII' AND t.ta = '51264' AND t.tb = '51264') OR (t.phase = 'sH' AND least(t.ta, t.tb) = '435663' AND greatest(t.ta, t.tb) = '51268')))
), shares AS MATERIALIZED (
  SELECT x.f, x.a AS l, y.a AS r, x.b AS s FROM way x JOIN way y ON y.f = x.f AND y.b = x.b AND x.a < y.a WHERE x.ta = '51268' AND y.ta = '51268' AND x.tb = '512' AND x.face = 5 AND y.face = 5
), pairs AS MATERIALIZED (
  SELECT p.f, p.l, p.r FROM (SELECT f, l, r FROM shares GROUP BY f, l, r HAVING count(DISTINCT s) = 6) p WHERE NOT EXISTS (SELECT 1 FROM way w WHERE w.f = p.f AND w.a = p.l AND w.b = p.r)
), mid AS MATERIALIZED (
  SELECT DISTINCT p.f, p.l, p.r, w.b AS m, w.a = p.l AS left_ FROM pairs p JOIN way w ON w.f = p.f AND w.a IN (p.l, p.r) AND w.tb = '435663'
  WHERE EXISTS (SELECT 1 FROM shares s JOIN way q ON q.f = s.f AND q.a = s.s AND q.b = w.b WHERE s.f = p.f AND s.l = p.l AND s.r = p.r)
), joined AS MATERIALIZED (
  SELECT p.* FROM pairs p WHERE (SELECT count(DISTINCT m) FROM mid WHERE mid.f = p.f AND mid.l = p.l AND mid.r = p.r) = 6
    AND EXISTS (SELECT 1 FROM mid x JOIN mid y ON y.f = x.f AND y.l = x.l AND y.r = x.r JOIN way w ON w.f = x.f AND w.a = x.m AND w.b = y.m WHERE x.f = p.f AND x.l = p.l AND x.r = p.r AND x.left_ AND NOT y.left_)
), composite AS MATERIALIZED (
  SELECT DISTINCT j.f, 'sH' AS phase, r.c FROM (SELECT f, l, r, l AS m FROM joined UNION SELECT f, l, r, r FROM joined UNION SELECT s.f, s.l, s.r, s.s FROM shares s JOIN joined j ON j.f = s.f AND j.l = s.l AND j.r = s.r UNION SELECT m.f, m.l, m.r, m.m FROM mid m JOIN joined j ON j.f = m.f AND j.l = m.l AND j.r = m.r) j JOIN ranked r ON r.f = j.f AND r.cage = j.m
), strict AS MATERIALIZED (SELECT f, phase, c FROM sc WHERE strict),
may AS MATERIALIZED (SELECT r.f, i.phase, r.c FROM seen s JOIN ideal i ON i.t = s.t AND i.nb = s.nb AND i.face = s.face JOIN ranked r ON r.f = s.f AND r.cage = s.c GROUP BY r.f, i.phase, r.c HAVING bool_and(s.n <= want + 1)),
{_chain("claim", "SELECT f, phase, c FROM strict UNION SELECT p.f, p.phase, p.b FROM pway p JOIN strict s ON s.f = p.f AND s.phase = p.phase AND s.c = p.a UNION SELECT f, phase, c FROM core UNION SELECT * FROM composite",
        "SELECT * FROM {was} UNION SELECT p.f, p.phase, p.b FROM pway p JOIN {was} c ON c.f = p.f AND c.phase = p.phase AND c.c = p.a JOIN may m ON m.f = p.f AND m.phase = p.phase AND m.c = p.b GROUP BY p.f, p.phase, p.b HAVING count(*) >= 2", 16)},
claims AS MATERIALIZED (SELECT f, c, count(DISTINCT phase) AS n, min(phase) AS phase FROM claim GROUP BY f, c),
alone AS MATERIALIZED (SELECT f, phase, c FROM claims WHERE n = 1),
inner_ AS MATERIALIZED (SELECT p.* FROM pway p JOIN alone x ON x.f = p.f AND x.phase = p.phase AND x.c = p.a JOIN alone y ON y.f = p.f AND y.phase = p.phase AND y.c = p.b),
{_labels("part", "alone", "inner_", "f, phase")},
seeded AS MATERIALIZED (
  SELECT p.f, p.phase, p.top FROM part p JOIN strict s ON s.f = p.f AND s.phase = p.phase AND s.c = p.c
  UNION SELECT f, phase, any_value(ptop) FROM (SELECT k.f, k.phase, k.top, p.top AS ptop FROM core k JOIN sc ON sc.f = k.f AND sc.phase = k.phase AND sc.c = k.c AND CASE k.phase WHEN 'sI' THEN sc.t = '51262' WHEN 'sII' THEN sc.t = '51264' ELSE sc.t IN ('435663', '51268') END LEFT JOIN part p ON p.f = k.f AND p.phase = k.phase AND p.c = k.c)
    GROUP BY f, phase, top HAVING count(DISTINCT ptop) = 1 AND bool_and(ptop IS NOT NULL)
  UNION SELECT j.f, 'sH', x.top FROM joined j JOIN ranked a ON a.f = j.f AND a.cage = j.l JOIN ranked b ON b.f = j.f AND b.cage = j.r JOIN part x ON x.f = j.f AND x.phase = 'sH' AND x.c = a.c JOIN part y ON y.f = j.f AND y.phase = 'sH' AND y.c = b.c AND y.top = x.top
), domain AS MATERIALIZED (SELECT p.* FROM part p JOIN seeded s ON s.f = p.f AND s.phase = p.phase AND s.top = p.top),
status AS MATERIALIZED (
  SELECT r.f, r.cage, r.c, k.t, d.phase, d.top, CASE WHEN d.top IS NOT NULL THEN 'classified' WHEN EXISTS (SELECT 1 FROM rway w JOIN domain e ON e.f = w.f AND e.c = w.b WHERE w.f = r.f AND w.a = r.c) THEN 'boundary' WHEN q.n > 1 THEN 'ambiguous' ELSE 'unclassified' END AS status
  FROM ranked r JOIN cage k ON k.f = r.f AND k.c = r.cage LEFT JOIN domain d ON d.f = r.f AND d.c = r.c LEFT JOIN claims q ON q.f = r.f AND q.c = r.c
)"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join([_LATTICE, *parts])} {body}"


SQL = {
    "crystal_clusters": _sql("SELECT f AS frame_index, cluster, count(*) AS cages, max(size) AS size FROM cluster GROUP BY f, cluster", _RANKED, _CLUSTERS),
    "crystal_neighbors": _sql("SELECT f AS frame_index, t AS cage_type, nb AS neighbor, face, n, count(*) AS cages FROM seen GROUP BY ALL"),
    "crystal_support": _sql("SELECT f AS frame_index, printf('c%04d', c) AS cage_id, phase, round(coverage, 6) AS coverage, round(purity, 6) AS purity, round(score, 6) AS score, strict FROM scored"),
    "crystal_phases": _sql("SELECT f AS frame_index, printf('c%04d', cage) AS cage_id, t AS cage_type, phase, status FROM status", _RANKED, _PHASES),
    "crystal_domains": _sql("""SELECT f AS frame_index, printf('domain_%05d', row_number() OVER (PARTITION BY f ORDER BY cluster, CASE phase WHEN 'sI' THEN 1 WHEN 'sII' THEN 2 ELSE 3 END, top)) AS domain_id, cluster, phase, cages, cages AS waters, boundary, round(cages / (cages + boundary), 6) AS classified_fraction FROM (
  SELECT s.f, s.phase, s.top, count(*) AS cages, min(k.cluster) AS cluster, (SELECT count(DISTINCT w.b) FROM rway w JOIN status i ON i.f = w.f AND i.c = w.a AND i.status = 'classified' AND i.phase = s.phase AND i.top = s.top JOIN status o ON o.f = w.f AND o.c = w.b AND o.status = 'boundary' WHERE w.f = s.f) AS boundary
  FROM status s JOIN cluster k ON k.f = s.f AND k.cage = s.cage WHERE s.status = 'classified' GROUP BY s.f, s.phase, s.top)""", _RANKED, _CLUSTERS, _PHASES),
    "crystal_cluster_types": _sql("""SELECT s.f AS frame_index, k.cluster, count(*) AS cages, CASE count(DISTINCT s.phase) WHEN 0 THEN 'unclassified' WHEN 1 THEN min(s.phase) ELSE 'mixed' END AS cluster_type, """
        + ", ".join(f"count(*) FILTER (s.status = '{x}') AS {x}" for x in ("classified", "boundary", "ambiguous", "unclassified")) + " FROM status s JOIN cluster k ON k.f = s.f AND k.cage = s.cage WHERE k.size >= 2 GROUP BY s.f, k.cluster", _RANKED, _CLUSTERS, _PHASES),
    "crystal_labels": _sql("SELECT s.f AS frame_index, CASE WHEN k.size < 2 THEN 'isolated' WHEN s.status = 'classified' THEN s.phase ELSE s.status END AS label, count(*) AS cages FROM status s JOIN cluster k ON k.f = s.f AND k.cage = s.cage GROUP BY ALL", _RANKED, _CLUSTERS, _PHASES),
    "crystal_cores": _sql("SELECT f AS frame_index, a::BIGINT AS u, b::BIGINT AS v FROM trim_ WHERE a < b", _chain("trim_", "SELECT DISTINCT f, a, b FROM way", "SELECT p.* FROM {was} p JOIN (SELECT f, a FROM {was} GROUP BY f, a HAVING count(*) >= 2) x ON x.f = p.f AND x.a = p.a JOIN (SELECT f, a FROM {was} GROUP BY f, a HAVING count(*) >= 2) y ON y.f = p.f AND y.a = p.b", 12)),
}
