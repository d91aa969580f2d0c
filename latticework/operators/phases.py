"""Hydrate phases of cages: seeds, spatial cores, expansion, exclusive domains, boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.cages import TEMPLATES, clusters, fingerprints, phase_support, shared_faces
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, both_ways, components, two_core

# Thresholds of a spatial core, the pair of types and face that define a phase, and its anchor types.
COVERAGE, PURITY, SCORE, MEAN, SIZE, CONTACTS = 0.5, 0.5, 0.55, 0.6, 3, 2
DEFINING = {"sI": ("51262", "51262"), "sII": ("51264", "51264"), "sH": ("435663", "51268")}
ANCHORS = {"sI": ["51262"], "sII": ["51264"], "sH": ["435663", "51268"]}


def _ideal(cages: DataFrame) -> DataFrame:
    rows = [(p, t, n, f, k) for (p, t), v in TEMPLATES.items() for (n, f), k in v.items()]
    return F.broadcast(cages.sparkSession.createDataFrame(rows, "phase string, cage_type string, neighbor string, face int, ideal int"))


def composite_seeds(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(K, left, right) and (K, node): pairs of large sH cages, and all members of their surroundings.

    faces are (K, u, v, u_type, v_type, face). Two 51268 that don't touch share exactly six
    512 over five-faces; exactly six 435663 touch one of the two and one of those; and two
    of these touch each other, one beside each large cage.
    """
    ends = lambda a, b: faces.select(*K, F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"{a}_type").alias("a_type"), F.col(f"{b}_type").alias("b_type"), "face")
    way = ends("u", "v").union(ends("v", "u"))
    touch = checkpoint(way.select(*K, "a", "b", "b_type").distinct())
    small = way.where("a_type = '51268' AND b_type = '512' AND face = 5").select(*K, F.col("a").alias("large"), F.col("b").alias("small")).distinct()
    one, two = (small.withColumnRenamed("large", n) for n in ("left", "right"))
    common = checkpoint(one.join(two, [*K, "small"]).where("left < right"))
    six = common.groupBy(*K, "left", "right").agg(F.count("*").alias("n")).where("n = 6").drop("n")
    apart = six.join(touch.select(*K, F.col("a").alias("left"), F.col("b").alias("right")), [*K, "left", "right"], "left_anti")
    common = common.join(apart, [*K, "left", "right"], "left_semi")
    medium = touch.where("b_type = '435663'").select(*K, "a", F.col("b").alias("medium"))
    large = apart.select(*K, "left", "right", F.explode(F.array("left", "right")).alias("a")).join(medium, [*K, "a"]).select(*K, "left", "right", "medium", F.col("a").alias("beside"))
    by_small = common.select(*K, "left", "right", F.col("small").alias("a")).join(medium, [*K, "a"]).select(*K, "left", "right", "medium").distinct()
    around = checkpoint(large.join(by_small, [*K, "left", "right", "medium"], "left_semi").distinct())
    count = around.groupBy(*K, "left", "right").agg(F.countDistinct("medium").alias("n")).where("n = 6").drop("n")
    first = around.where("beside = left").select(*K, "left", "right", F.col("medium").alias("a"))
    last = around.where("beside = right").select(*K, "left", "right", F.col("medium").alias("b"))
    bridge = first.join(touch.select(*K, "a", "b"), [*K, "a"]).join(last, [*K, "left", "right", "b"], "left_semi").select(*K, "left", "right").distinct()
    pairs = checkpoint(count.join(bridge, [*K, "left", "right"], "left_semi"))
    members = pairs.select(*K, F.explode(F.array("left", "right")).alias("node"))
    for df, column in ((common, "small"), (around, "medium")):
        members = members.union(df.join(pairs, [*K, "left", "right"], "left_semi").select(*K, F.col(column).alias("node")))
    return pairs, members.distinct()


PHASES = ("sI", "sII", "sH")
_JOIN = "|"


def _tagged(phase: str = "phase") -> Column:
    """Phases are kept apart by the group key, so that graph operators treat each one alone."""
    return F.concat_ws(_JOIN, "group_key", phase)


def _phase_of() -> Column:
    return F.element_at(F.split("group_key", rf"\{_JOIN}"), -1)


def _group_of() -> Column:
    return F.regexp_extract("group_key", rf"^(.*)\{_JOIN}[^{_JOIN}]*$", 1)


def _numbered(cages: DataFrame) -> DataFrame:
    order = Window.partitionBy(*K).orderBy("cage_type", "waters", "cage_id")
    return cages.select(*K, "cage_id", "cage_type", "rings", F.row_number().over(order).cast("long").alias("node"))


def _faces(base: DataFrame, rings: DataFrame, sides: DataFrame | None) -> DataFrame:
    """(K, u, v, u_type, v_type, face) of all shared faces."""
    side = lambda c, p: base.select(*K, F.col("cage_id").alias(c), F.col("cage_type").alias(f"{p}_type"), F.col("node").alias(p))
    found = shared_faces(base, sides).join(rings.select(*K, "ring_id", F.col("size").alias("face")), [*K, "ring_id"])
    return found.join(side("a", "u"), [*K, "a"]).join(side("b", "v"), [*K, "b"]).select(*K, "u", "v", "u_type", "v_type", "face")


def _ties(faces: DataFrame, ideal: DataFrame) -> DataFrame:
    """Faces that a phase expects from both of their cages, under the tagged key of each such phase."""
    left = ideal.select("phase", F.col("cage_type").alias("u_type"), F.col("neighbor").alias("v_type"), "face")
    right = ideal.select("phase", F.col("cage_type").alias("v_type"), F.col("neighbor").alias("u_type"), "face")
    fits = faces.join(left, ["u_type", "v_type", "face"]).join(right, ["phase", "u_type", "v_type", "face"], "left_semi")
    return fits.select(_tagged().alias("group_key"), "frame_index", "u", "v", "u_type", "v_type", "face").distinct()


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes."""
    one, two = (nodes.select(*K, F.col("node").alias(n)) for n in "uv")
    return edges.join(one, [*K, "u"], "left_semi").join(two, [*K, "v"], "left_semi").select(*K, "u", "v")


def spatial_cores(support: DataFrame, ties: DataFrame, edges: DataFrame) -> DataFrame:
    """(K, node, component, cage_type) of the cores: two-cores of well-supported cages, large and good enough, with a tie that defines the phase."""
    good = support.where((F.col("coverage") >= COVERAGE) & (F.col("purity") >= PURITY) & (F.col("score") >= SCORE))
    core = two_core(_within(edges, good))
    nodes = core.select(*K, F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = checkpoint(components(nodes, core).join(good.select(*K, "node", "score", "cage_type"), [*K, "node"]))
    pair = F.array_sort(F.array("u_type", "v_type"))
    defining = reduce(lambda c, p: c | ((_phase_of() == p[0]) & (F.col("face") == 6) & (pair == F.array_sort(F.array(*map(F.lit, p[1]))))), DEFINING.items(), F.lit(False))
    there = labels.select(*K, F.col("node").alias("v"), F.col("component").alias("other"))
    firm = labels.join(ties.where(defining).select(*K, F.col("u").alias("node"), "v"), [*K, "node"]).join(there, [*K, "v"]).where("component = other").select(*K, "component").distinct()
    large = labels.groupBy(*K, "component").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).where((F.col("n") >= SIZE) & (F.col("mean") >= MEAN))
    return labels.join(large.select(*K, "component"), [*K, "component"], "left_semi").join(firm, [*K, "component"], "left_semi").select(*K, "node", "component", "cage_type")


def expanded(claimed: DataFrame, open_: DataFrame, edges: DataFrame) -> DataFrame:
    """claimed with those of open_ that have CONTACTS or more claimed neighbours, to a fixpoint."""
    while True:
        contacts = both_ways(edges).join(claimed.withColumnRenamed("node", "a"), [*K, "a"], "left_semi").groupBy(*K, F.col("b").alias("node")).agg(F.count("*").alias("n"))
        more = checkpoint(contacts.where(F.col("n") >= CONTACTS).select(*K, "node").join(open_, [*K, "node"], "left_semi").join(claimed, [*K, "node"], "left_anti"))
        if not more.count():
            return claimed
        claimed = checkpoint(claimed.union(more))


def _partial(base: DataFrame, rings: DataFrame, ideal: DataFrame, sides: DataFrame | None) -> DataFrame:
    """Cages whose known neighbours of a phase are at most one more than its ideal ones, under the tagged key."""
    seen = fingerprints(base, rings, sides).join(ideal, ["cage_type", "neighbor", "face"])
    ok = seen.groupBy(*K, "cage_id", "phase").agg(F.bool_and(F.col("n") <= F.col("ideal") + 1).alias("ok")).where("ok")
    return ok.join(base.select(*K, "cage_id", "node"), [*K, "cage_id"]).select(_tagged().alias("group_key"), "frame_index", "node")


def _anchored(parts: DataFrame, strict: DataFrame, cores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(K, domain) of the parts(K, node, component) that hold a seed: a strict cage, all anchors of a core, or both large cages of a pair."""
    anchor = reduce(lambda c, p: c | ((_phase_of() == p[0]) & F.col("cage_type").isin(p[1])), ANCHORS.items(), F.lit(False))
    held = cores.where(anchor).join(parts.select(*K, "node", F.col("component").alias("domain")), [*K, "node"], "left")
    held = held.groupBy(*K, "component").agg(F.countDistinct("domain").alias("n"), F.bool_and(F.col("domain").isNotNull()).alias("every"), F.min("domain").alias("domain"))
    whole = held.where("every AND n = 1").select(*K, "domain")
    inside = lambda c: parts.select(*K, F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    joint = pairs.join(inside("left"), [*K, "left"]).join(inside("right"), [*K, "right"]).where("left_in = right_in").select(*K, F.col("left_in").alias("domain"))
    single = strict.join(parts, [*K, "node"]).select(*K, F.col("component").alias("domain"))
    return whole.union(joint).union(single).distinct()


def phase_domains(cages: DataFrame, rings: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, cage_id, cage_type, phase, domain, status): classified, boundary, ambiguous or unclassified.

    A cage is claimed for a phase by strict neighbourhoods, by cores of well-supported
    cages, and by two contacts with claimed ones, to a fixpoint. Domains are components of
    cages that one phase alone claims and that hold a seed; domain is its least cage number,
    counted in a frame by type and waters. sides, of face_sides, settle faces of many cages.
    """
    base, ideal = checkpoint(_numbered(cages)), _ideal(cages)
    faces = checkpoint(_faces(base, rings, sides))
    ties = checkpoint(_ties(faces, ideal))
    edges = checkpoint(ties.select(*K, "u", "v").distinct())
    support = checkpoint(phase_support(base, rings, sides).join(base.select(*K, "cage_id", "node"), [*K, "cage_id"]).withColumn("group_key", _tagged()))
    strict = support.where("strict").select(*K, "node")
    around = both_ways(edges).join(strict.withColumnRenamed("node", "a"), [*K, "a"], "left_semi").select(*K, F.col("b").alias("node"))
    cores = checkpoint(spatial_cores(support, ties, edges))
    tag = F.concat_ws(_JOIN, "group_key", F.lit("sH"))
    pairs, paired = (checkpoint(df.withColumn("group_key", tag)) for df in composite_seeds(faces))
    first = checkpoint(strict.union(around).union(cores.select(*K, "node")).union(paired.select(*K, "node")).distinct())
    claimed = expanded(first, checkpoint(_partial(base, rings, ideal, sides)), edges)

    claims = claimed.select(_group_of().alias("group_key"), "frame_index", "node", _phase_of().alias("phase"))
    count = checkpoint(claims.groupBy(*K, "node").agg(F.countDistinct("phase").alias("n"), F.min("phase").alias("phase")))
    alone = checkpoint(count.where("n = 1").select(_tagged().alias("group_key"), "frame_index", "node"))
    parts = checkpoint(components(alone, _within(edges, alone)))
    seeded = _anchored(parts, strict, cores, pairs)
    domains = parts.withColumnRenamed("component", "domain").join(seeded, [*K, "domain"], "left_semi")
    domains = checkpoint(domains.select(_group_of().alias("group_key"), "frame_index", "node", _phase_of().alias("phase"), "domain"))
    beside = both_ways(faces).join(domains.select(*K, F.col("node").alias("a")), [*K, "a"], "left_semi").select(*K, F.col("b").alias("node")).distinct().withColumn("beside", F.lit(True))
    rows = base.select(*K, "cage_id", "cage_type", "node").join(domains, [*K, "node"], "left").join(beside, [*K, "node"], "left").join(count.select(*K, "node", "n"), [*K, "node"], "left")
    status = F.when(F.col("domain").isNotNull(), "classified").when(F.col("beside"), "boundary").when(F.col("n") > 1, "ambiguous").otherwise("unclassified")
    return rows.select(*K, "cage_id", "cage_type", "phase", "domain", status.alias("status"))


def domain_table(statuses: DataFrame, cages: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(K, domain_id, cluster, phase, cages, waters, boundary, classified_fraction) of phase_domains' result.

    boundary counts the boundary cages that touch the domain; domains are numbered by
    cluster, phase and first cage.
    """
    held = checkpoint(statuses.join(clusters(cages, sides).select(*K, "cage_id", "cluster"), [*K, "cage_id"]))
    inside = held.where("status = 'classified'")
    own = inside.groupBy(*K, "domain", "phase").agg(F.count("*").alias("cages"), F.min("cluster").alias("cluster"))
    waters = inside.select(*K, "domain", "phase", "cage_id").join(cages.select(*K, "cage_id", F.explode("waters").alias("water")), [*K, "cage_id"]).groupBy(*K, "domain", "phase").agg(F.countDistinct("water").alias("waters"))
    shared = shared_faces(cages, sides)
    way = shared.select(*K, "a", "b").union(shared.select(*K, "b", "a"))
    outer = held.where("status = 'boundary'").select(*K, F.col("cage_id").alias("b"))
    touch = way.join(outer, [*K, "b"], "left_semi").join(inside.select(*K, F.col("cage_id").alias("a"), "domain", "phase"), [*K, "a"])
    rim = touch.groupBy(*K, "domain", "phase").agg(F.countDistinct("b").alias("boundary"))
    rows = own.join(waters, [*K, "domain", "phase"]).join(rim, [*K, "domain", "phase"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(0)))
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    number = F.row_number().over(Window.partitionBy(*K).orderBy("cluster", place, "domain"))
    share = F.round(F.col("cages") / (F.col("cages") + F.col("boundary")), 6)
    return rows.select(*K, F.format_string("domain_%05d", number).alias("domain_id"), "cluster", "phase", "cages", "waters", "boundary", share.alias("classified_fraction"))


def cluster_table(statuses: DataFrame, cages: DataFrame, sides: DataFrame | None = None, min_cage: int = 2) -> DataFrame:
    """(K, cluster, cages, cluster_type, one count for each status): clusters of min_cage cages or more.

    cluster_type is the phase of the cluster's domains, mixed if they have several,
    unclassified without a domain.
    """
    held = statuses.join(clusters(cages, sides).where(F.col("size") >= min_cage), [*K, "cage_id"])
    rows = held.groupBy(*K, "cluster").agg(
        F.count("*").alias("cages"), F.countDistinct(F.when(F.col("status") == "classified", F.col("phase"))).alias("n"), F.min(F.when(F.col("status") == "classified", F.col("phase"))).alias("one"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("classified", "boundary", "ambiguous", "unclassified")],
    )
    kind = F.when(F.col("n") == 0, "unclassified").when(F.col("n") == 1, F.col("one")).otherwise("mixed")
    return rows.select(*K, "cluster", "cages", kind.alias("cluster_type"), "classified", "boundary", "ambiguous", "unclassified")


def phase_labels(statuses: DataFrame, cages: DataFrame, sides: DataFrame | None = None, min_cage: int = 2) -> DataFrame:
    """(K, cage_id, phases): what tracking calls a cage: its phase or status, isolated if its cluster is smaller than min_cage."""
    held = statuses.join(clusters(cages, sides).select(*K, "cage_id", "size"), [*K, "cage_id"])
    label = F.when(F.col("size") < min_cage, "isolated").when(F.col("status") == "classified", F.col("phase")).otherwise(F.col("status"))
    return held.select(*K, "cage_id", F.array(label).alias("phases"))
