"""Molecules from atoms, and frames by time, index and topology.

Atoms are (group_key, frame_index, atom, resid, resname, atomname); atom orders a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from latticework.operators.graphs import K


#: Numbers of atoms that are sorted together (a power of two).
STRETCH = 1 << 16


def _lead(atoms: DataFrame) -> Column | None:
    """The integer that atoms are ordered by first; None if they are ordered by something else."""
    at, kind = F.col("atom"), atoms.schema["atom"].dataType
    while isinstance(kind, StructType) and kind.fields:
        at, kind = at[kind.fields[0].name], kind.fields[0].dataType
    return at.cast("long") if isinstance(kind, IntegralType) else None


def residues(atoms: DataFrame) -> DataFrame:
    """Atoms with block, the number of their contiguous run of (resname, resid); wrapped resids stay apart.

    Stretches of STRETCH atom numbers are sorted each, and what they hold is added up over a frame, so no
    task holds a frame. Atoms that no integer orders are sorted frame by frame.
    """
    lead = _lead(atoms)
    place = F.lit(0).cast("long") if lead is None else F.coalesce(F.floor(lead / STRETCH).cast("long"), F.lit(-(1 << 62)))  # nulls come first
    rows = atoms.withColumn("_place", place).withColumn("_name", F.upper("resname"))
    order = Window.partitionBy(*K, "_place").orderBy("atom")
    changed = (~F.lag("_name").over(order).eqNullSafe(F.col("_name"))) | (~F.lag("resid").over(order).eqNullSafe(F.col("resid")))
    rows = rows.withColumn("_new", F.when((F.row_number().over(order) > 1) & changed, 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*K, "_place").agg(F.max("_run").alias("runs"), *[f(F.struct("_name", "resid"), "atom").alias(n) for n, f in (("head", F.min_by), ("tail", F.max_by))])
    along = Window.partitionBy(*K).orderBy("_place")
    goes_on = F.lag(F.lit(True)).over(along).isNotNull() & F.lag("tail").over(along)["_name"].eqNullSafe(F.col("head._name")) & F.lag("tail").over(along)["resid"].eqNullSafe(F.col("head.resid"))
    ends = ends.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    before = F.sum(F.col("begins") + F.col("runs")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs")
    return rows.join(ends.select(*K, "_place", before.alias("_before")), [*K, "_place"]).select(*atoms.columns, (F.col("_before") + F.col("_run")).alias("block"))


def molecules(atoms: DataFrame) -> DataFrame:
    """Atoms with block: by molecule_id and residue name where the input has ids, numbered by first atom; else as residues.

    A frame with both atoms that have a molecule_id and atoms that have none is an error.
    """
    if "molecule_id" not in atoms.columns:
        return residues(atoms)
    per = atoms.groupBy(*K).agg(F.count("molecule_id").alias("known"), F.count("*").alias("n"))
    wrong = F.raise_error(F.concat(F.lit("frame "), F.col("frame_index").cast("string"), F.lit(" has atoms with and without a molecule id")))
    marked = atoms.join(per, K).withColumn("known", F.when((F.col("known") > 0) & (F.col("known") < F.col("n")), wrong.cast("long")).otherwise(F.col("known")))
    named = marked.where("known > 0").drop("known", "n").withColumn("_name", F.upper("resname"))
    first = named.groupBy(*K, "_name", "molecule_id").agg(F.min("atom").alias("_first"))
    first = first.withColumn("block", F.row_number().over(Window.partitionBy(*K).orderBy("_first"))).drop("_first")
    given = named.join(first, [*K, "_name", "molecule_id"]).drop("_name")
    rest = residues(marked.where("known = 0").drop("known", "n"))
    return given.withColumn("block", F.col("block").cast("long")).unionByName(rest.select(*given.columns))


def select_guests(blocks: DataFrame, resnames: tuple[str, ...], center_atoms: dict[str, tuple[str, ...]] | None = None, centroid: bool = False) -> DataFrame:
    """(K, block, resname, resid, node, atoms, center): molecules of the names; center is the atom that center_atoms names, null for the centroid."""
    rows = blocks.where(F.upper("resname").isin(*[n.upper() for n in resnames])).withColumn("name", F.upper("resname"))
    wanted = F.lit(False)
    for name, atoms in ({} if centroid else center_atoms or {}).items():
        wanted |= (F.col("name") == name.upper()) & F.upper("atomname").isin(*[a.upper() for a in atoms])
    return rows.groupBy(*K, "block", F.col("name").alias("resname"), "resid").agg(F.min("atom").alias("node"), F.array_sort(F.collect_list("atom")).alias("atoms"), F.min(F.when(wanted, F.col("atom"))).alias("center"))


def select_waters(blocks: DataFrame, resnames: tuple[str, ...], oxygen: tuple[str, ...], hydrogen: tuple[str, ...]) -> DataFrame:
    """(K, block, resname, resid, atoms, oxygen, hydrogens): first oxygen by name, else a molecule's only atom; others are left out."""
    named = F.upper("atomname")
    rows = blocks.where(F.upper("resname").isin(*[n.upper() for n in resnames]))
    found = rows.groupBy(*K, "block", F.upper("resname").alias("resname"), "resid").agg(
        F.count("*").alias("atoms"), F.min("atom").alias("only"), F.min(F.when(named.isin(*oxygen), F.col("atom"))).alias("first"), F.array_sort(F.collect_list(F.when(named.isin(*hydrogen), F.col("atom")))).alias("hydrogens")
    )
    center = F.coalesce("first", F.when(F.col("atoms") == 1, F.col("only")))
    return found.withColumn("oxygen", center).where("oxygen IS NOT NULL").drop("only", "first")


def graph_mode(waters: DataFrame) -> str:
    """hbond if every water has two hydrogens or more, oo if none has any; mixtures are an error."""
    low, high = waters.agg(F.min(F.size("hydrogens")), F.max(F.size("hydrogens"))).first()
    if low is None or high == 0:
        return "oo"
    if low >= 2:
        return "hbond"
    raise ValueError("waters with and without hydrogens need an explicit graph mode")


def graph_modes(waters: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_key, mode): graph_mode of each group(K, group), decided on its first frame."""
    first = groups.groupBy("group_key", "group").agg(F.min("frame_index").alias("frame_index"))
    held = first.join(waters.select(*K, F.size("hydrogens").alias("n")), K, "left").groupBy("group_key", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    mixed = F.raise_error(F.concat(F.lit("waters with and without hydrogens need an explicit graph mode, in group "), F.col("group").cast("string"))).cast("string")
    mode = F.when(F.col("low").isNull() | (F.col("high") == 0), "oo").when(F.col("low") >= 2, "hbond").otherwise(mixed)
    return held.select("group_key", "group", mode.alias("mode"))


def roles(resname: Column, water: tuple[str, ...], guest: tuple[str, ...], additive: tuple[str, ...] = (), role_map: dict[str, str] | None = None, environment: tuple[str, ...] = ()) -> Column:
    """water, guest, what role_map says, additive, environment or unknown, in this order."""
    name = F.upper(resname)
    out = F.when(name.isin(*water), "water").when(name.isin(*guest), "guest")
    for key, role in (role_map or {}).items():
        out = out.when(name == key.upper(), role)
    return out.when(name.isin(*additive), "additive").when(name.isin(*environment), "environment").otherwise("unknown")


def topology(blocks: DataFrame) -> DataFrame:
    """(K, atoms, fingerprint): digest of the residues in the order of their numbers with their atom names; ids and coordinates don't count."""
    residue = blocks.groupBy(*K, "block", F.upper("resname").alias("resname")).agg(F.transform(F.array_sort(F.collect_list(F.struct("atom", "atomname"))), lambda a: a["atomname"]).alias("names"))
    lines = residue.select(*K, "block", F.size("names").alias("n"), F.concat_ws(":", "resname", F.array_join("names", ",")).alias("line"))
    # digests of residues and their numbers are folded in any order, so nothing of a frame is gathered
    folds = [F.hex(F.bit_xor(F.xxhash64(*seed, "block", "line"))) for seed in ((), (F.lit("again"),))]
    parts = lines.groupBy(*K).agg(F.sum("n").alias("atoms"), F.concat_ws(" ", *folds).alias("text"))
    return parts.select(*K, "atoms", F.sha2(F.concat_ws("|", F.col("atoms").cast("string"), "text"), 256).alias("fingerprint"))


def topology_groups(found: DataFrame) -> DataFrame:
    """topology() with group, numbered from 1 by the first frame of each fingerprint."""
    first = found.groupBy("group_key", "fingerprint").agg(F.min("frame_index").alias("first"))
    return found.join(first.withColumn("group", F.dense_rank().over(Window.partitionBy("group_key").orderBy("first"))).drop("first"), ["group_key", "fingerprint"])


LETTERS = 26


def topology_letters(found: DataFrame) -> DataFrame:
    """topology() with letter, A to Z by the first frame of each fingerprint over all groups; null everywhere if there are more than 26.

    With more, frames can only be listed, not analysed as groups.
    """
    first = found.groupBy("fingerprint").agg(F.min(F.struct("group_key", "frame_index")).alias("first"))
    ranked = first.orderBy("first").limit(LETTERS + 1).select("fingerprint", F.row_number().over(Window.orderBy("first")).alias("k"))  # 27 rows at most
    few = first.limit(LETTERS + 1).count() <= LETTERS
    letter = F.char(F.lit(64) + F.col("k")) if few else F.lit(None).cast("string")
    return found.join(F.broadcast(ranked), "fingerprint", "left").select(*found.columns, letter.alias("letter"))


def by_topology(atoms: DataFrame, found: DataFrame) -> DataFrame:
    """Atoms whose group_key is the letter of their frame's topology; frames keep their order and are numbered anew in each group.

    More than 26 topologies are an error.
    """
    named = topology_letters(found)
    many = F.raise_error(F.lit("more than 26 topologies: frames can only be listed")).cast("string")
    order = Window.partitionBy("letter").orderBy(*K)
    placed = named.withColumn("letter", F.coalesce("letter", many)).select(*K, "letter", (F.row_number().over(order) - 1).cast("int").alias("place"))
    rows = atoms.join(placed, K)
    return rows.select(*[F.col("letter").alias(c) if c == "group_key" else F.col("place").alias(c) if c == "frame_index" else F.col(c) for c in atoms.columns])


def fill_times(frames: DataFrame, first: float = 0.0, step: float = 1.0) -> DataFrame:
    return frames.withColumn("time_ps", F.coalesce("time_ps", F.lit(first) + F.col("frame_index") * F.lit(step)))


def sample_times(frames: DataFrame, delta: float, tolerance: float = 1e-6) -> DataFrame:
    """Frames(group_key, frame_index, time_ps) every delta ps; times must be regular and delta a multiple of their step."""
    order = Window.partitionBy("group_key").orderBy("frame_index")
    steps = frames.select("group_key", (F.col("time_ps") - F.lag("time_ps").over(order)).alias("d")).where("d IS NOT NULL")
    low, high = steps.agg(F.min("d"), F.max("d")).first()
    if low is None:
        return frames
    if low <= 0 or high - low > tolerance:
        raise ValueError(f"frame times are irregular: steps of {low} to {high} ps")
    every = round(delta / low)
    if every < 1 or abs(every * low - delta) > tolerance:
        raise ValueError(f"{delta} ps is no multiple of the step of {low} ps")
    return frames.withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") % every == 0).drop("_k")


PAIR_IDS = ("resid", "oxygen_index", "atomid")


def pair_nodes(pairs: DataFrame, waters: DataFrame, atoms: DataFrame, kind: str) -> DataFrame:
    """(K, u, v) of pairs(K, u, v) whose ids are of a kind: resids of waters, oxygens' places, or atom numbers of oxygens.

    An id that several waters have, or that belongs to no water's oxygen, is an error. Pairs that stand there more than once
    are joined once.
    """
    if kind not in PAIR_IDS:
        raise ValueError(f"pair ids are one of {', '.join(PAIR_IDS)}")
    if kind == "oxygen_index":
        known = waters.select(*K, F.col("oxygen").cast("long").alias("id"), F.col("oxygen").cast("long").alias("node"))
    elif kind == "resid":
        known = waters.select(*K, F.col("resid").cast("long").alias("id"), F.col("oxygen").cast("long").alias("node"))
    else:
        oxygens = waters.select(*K, F.col("oxygen").alias("atom"))
        known = atoms.join(oxygens, [*K, "atom"], "left_semi").select(*K, F.col("atomid").cast("long").alias("id"), F.col("atom").cast("long").alias("node"))
    single = known.groupBy(*K, "id").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    out = pairs.select(*K, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    for end in "uv":
        named = single.select(*K, F.col("id").alias(end), F.col("n").alias("_n"), F.col("node").alias("_node"))
        text = F.concat(F.lit(f"{kind} "), F.col(end).cast("string"))
        unknown = F.raise_error(F.concat(text, F.lit(" is no selected water"))).cast("long")
        several = F.raise_error(F.concat(text, F.lit(" belongs to several waters"))).cast("long")
        node = F.when(F.col("_n").isNull(), unknown).when(F.col("_n") > 1, several).otherwise(F.col("_node"))
        out = out.join(named, [*K, end], "left").withColumn(end, node).drop("_n", "_node")
    return out.select(*K, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def resolve_pairs(pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unknown): canonical edges(K, u, v) whose ends are nodes(K, node), and ends that no node has."""
    edges = pairs.select(*K, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    ends = edges.select(*K, F.explode(F.array("u", "v")).alias("node")).distinct()
    unknown = ends.join(nodes, [*K, "node"], "left_anti")
    known = lambda c: nodes.select(*K, F.col("node").alias(c))
    return edges.join(known("u"), [*K, "u"], "left_semi").join(known("v"), [*K, "v"], "left_semi").select(*K, "u", "v"), unknown
