"""Public interface: read frames, analyse them, track cages."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import cages, geometry, graphs, neighbors, order, patches, phases, rings, select, tracking
from latticework.operators import tables as report
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K
from latticework.sources import files, state


#: Settings by section, under the names that a nested configuration has for the fields of Config.
SECTIONS: dict[str, dict[str, str]] = {
    "input": {n: n for n in ("first_file_time_ps", "frame_time_step_ps", "delta_time_ps", "xyz_scale")},
    "lammps": {"units": "lammps_units", "timestep": "lammps_timestep", "type_map": "type_map"},
    "graph": {"bond_mode": "mode", "oo_cutoff_nm": "oo_cutoff_nm", "hbond_angle_deg": "angle_deg", "pair_id": "pair_id"},
    "pbc": {"box_mode": "box_mode"},
    "component": {"role_map": "role_map", "unknown_action": "unknown_action"},
    "additive": {"resnames": "additive_resnames"},
    "environment": {"resnames": "environment_resnames"},
    "water": {"resnames": "water_resnames", "oxygen_names": "oxygen_names", "hydrogen_names": "hydrogen_names"},
    "guest": {"resnames": "guest_resnames", "center_atoms": "center_atoms", "center_mode": "center_mode"},
    "ring": {"sizes": "ring_sizes", "report_sizes": "ring_report_sizes", "definition": "ring_definition"},
    "half_cage": {"enabled": "half_cages"},
    "quasi_cage": {"enabled": "quasi_cages", "base_sizes": "base_sizes", "side_sizes": "side_sizes", "max_layers": "layers", "max_rings_per_layer": "layer_rings", "max_layer_states_per_seed": "layer_states", "max_candidates_per_edge": "per_side", "max_layer_candidates": "layer_candidates", "search_policy": "search_policy"},
    "cage": {"report_types": "cage_report_types", "max_faces": "max_faces", "max_states_per_seed": "max_states", "scientific_validation": "validate_cages", "max_face_planarity_rms_nm": "max_planarity_nm", "max_face_edge_cv": "max_edge_cv", "min_cage_volume_nm3": "min_volume_nm3", "occupancy_mode": "occupancy_mode", "occupancy_radius_nm": "occupancy_radius_nm"},
    "hydrate_cluster": {"enabled": "find_clusters", "min_cage": "min_cage"},
    "hydrate_order": {"mcg_guest_cutoff_nm": "mcg_guest_cutoff_nm", "mcg_water_cutoff_nm": "mcg_water_cutoff_nm", "mcg_cone_half_angle_deg": "mcg_angle_deg", "mcg_min_waters": "mcg_min_waters", "dhop_planar_counts": "dhop_counts", "dhop_min_qualified_neighbors": "dhop_least"},
    "order": {"parameters": "order_parameters", "q_neighbor_mode": "q_mode", "q_n_neighbor": "q_count", "q_cutoff_nm": "q_cutoff_nm", "focus_waters": "focus_waters"},
    "ice": {"method": "ice_method", "min_six_rings": "min_six_rings"},
    "output": {"types": "outputs", "center_resname": "center_resname"},
}
#: Settings that a named start has in place of the defaults.
PRESETS: dict[str, dict] = {
    "rigorous": {"mode": "hbond", "find_clusters": True, "outputs": ("info", "summary", "xlsx")},
    "standard": {},
    "fast": {"mode": "hbond", "half_cages": False, "quasi_cages": False},
    "plain": {"half_cages": False, "quasi_cages": False},
}
OUTPUTS = ("info", "summary", "detail", "xlsx", "membership", "order", "ring-gro", "half-gro", "quasi-gro", "cage-gro", "cluster-gro", "ice-gro", "cluster-detail")


@dataclass(frozen=True)
class Config:
    """What an analysis does; unknown keys are errors, by section or flat."""

    first_file_time_ps: float = 0.0
    frame_time_step_ps: float = 100.0
    delta_time_ps: float | None = None
    xyz_scale: float = 0.1
    lammps_units: str = "real"
    lammps_timestep: float = 1.0
    type_map: dict = field(default_factory=dict)
    box_mode: str = "orthorhombic"
    mode: str = "auto"
    oo_cutoff_nm: float = 0.35
    angle_deg: float = 30.0
    pair_id: str = "resid"
    water_resnames: tuple[str, ...] = ("SOL", "WAT", "HOH", "TIP3", "TIP4")
    oxygen_names: tuple[str, ...] = ("OW", "O", "OH2")
    hydrogen_names: tuple[str, ...] = ("HW1", "HW2", "H1", "H2")
    guest_resnames: tuple[str, ...] = ("CH4", "MET", "CO2", "ETH")
    center_atoms: dict = field(default_factory=dict)
    center_mode: str = "center_atom"
    role_map: dict = field(default_factory=dict)
    unknown_action: str = "warn"
    additive_resnames: tuple[str, ...] = ()
    environment_resnames: tuple[str, ...] = ()
    ring_sizes: tuple[int, ...] = (4, 5, 6)
    ring_report_sizes: tuple[int, ...] | str = "auto"
    ring_definition: str = "chordless"
    half_cages: bool = True
    quasi_cages: bool = True
    base_sizes: tuple[int, ...] = (5, 6)
    side_sizes: tuple[int, ...] = (5, 6)
    layers: int = 1
    layer_rings: int = 6
    layer_states: int = 200
    per_side: int = 4
    layer_candidates: int = 24
    search_policy: str = "bounded"
    cage_report_types: tuple[str, ...] | str = "auto"
    max_faces: int = 20
    max_states: int = 0
    validate_cages: bool = False
    max_planarity_nm: float = 0.06
    max_edge_cv: float = 0.35
    min_volume_nm3: float = 1e-6
    occupancy_mode: str = "polyhedron"
    occupancy_radius_nm: float = 0.5
    find_clusters: bool = False
    min_cage: int = 2
    mcg_guest_cutoff_nm: float = 0.9
    mcg_water_cutoff_nm: float = 0.6
    mcg_angle_deg: float = 45.0
    mcg_min_waters: int = 5
    dhop_counts: tuple[int, ...] = (11, 12)
    dhop_least: int = 3
    ql: tuple[int, ...] = (6, 12)
    order_parameters: tuple[str, ...] | str = ("f3", "f4")
    q_mode: str = "graph"
    q_count: int | None = None
    q_cutoff_nm: float = 0.35
    focus_waters: tuple[int, ...] = ()
    ice_method: str = "chill"
    min_six_rings: int = 2
    outputs: tuple[str, ...] = ("info", "summary")
    center_resname: str = "CNT"
    track: tracking.TrackingConfig = field(default_factory=tracking.TrackingConfig)

    def __post_init__(self) -> None:
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise ValueError(why)

        need(self.mode in ("auto", "oo", "hbond", "pairs"), f"unknown graph mode {self.mode!r}")
        need(self.ring_definition in ("chordless", "shortest_path"), f"unknown ring definition {self.ring_definition!r}")
        need(bool(self.ring_sizes) and set(self.ring_sizes) <= {4, 5, 6, 7}, "ring sizes are 4 to 7")
        need(self.oo_cutoff_nm > 0 and 0 <= self.angle_deg <= 180 and self.occupancy_radius_nm > 0, "cutoffs must be positive and the angle between 0 and 180 degrees")
        need(self.occupancy_mode in ("polyhedron", "center", "auto"), f"unknown occupancy mode {self.occupancy_mode!r}")
        need(self.xyz_scale > 0 and self.frame_time_step_ps > 0 and (self.delta_time_ps is None or self.delta_time_ps > 0), "scale and time steps must be positive")
        need(self.lammps_units in files.UNITS and self.lammps_timestep > 0, f"units are one of {sorted(files.UNITS)} and the time step is positive")
        need(self.box_mode == "orthorhombic", "boxes must be orthorhombic")
        need(self.pair_id in select.PAIR_IDS, f"pair ids are one of {', '.join(select.PAIR_IDS)}")
        need(self.center_mode in ("center_atom", "centroid"), "the centre of a guest is its center_atom or its centroid")
        need(self.unknown_action in ("warn", "ignore", "error"), "unknown molecules are warned of, ignored or an error")
        need(set(self.role_map.values()) <= {"water", "guest", "additive", "environment", "other"}, "roles are water, guest, additive, environment or other")
        need(set(self.report_sizes()) <= set(self.ring_sizes), "report sizes are among the ring sizes")
        need(set(self.base_sizes) | set(self.side_sizes) <= {4, 5, 6, 7}, "patch sizes are 4 to 7")
        need(1 <= self.layers <= 3 and min(self.layer_rings, self.layer_states, self.per_side, self.layer_candidates) >= 1, "layers are 1 to 3 and their bounds 1 or more")
        need(self.layers == 1 or self.quasi_cages, "more layers need quasi cages")
        need(self.search_policy in ("bounded", "exact"), "the search policy is bounded or exact")
        need(self.max_faces >= 1 and self.max_states >= 0 and self.min_cage >= 1, "bounds of the cage search are not negative")
        need(0 < self.mcg_angle_deg < 90 and self.mcg_min_waters >= 1 and self.dhop_least >= 1 and bool(self.dhop_counts), "the cone is between 0 and 90 degrees and counts are positive")
        need(self.ice_method == "chill" and self.min_six_rings >= 1, "ice is told by chill, with one six-ring or more")
        need(set(self.outputs) <= set(OUTPUTS), f"outputs are among {', '.join(OUTPUTS)}")
        need(self.find_clusters or not {"cluster-gro", "cluster-detail"} & set(self.outputs), "cluster outputs need the cluster search")
        need(self.center_resname.isascii() and 1 <= len(self.center_resname) <= 5, "a residue name has one to five ASCII characters")
        order.parameters(self.order_parameters)
        order.q_neighbors(self.q_mode, self.q_count)
        self.report_types()

    def report_sizes(self) -> tuple[int, ...]:
        return self.ring_sizes if self.ring_report_sizes in ("auto", "all") else tuple(self.ring_report_sizes)

    def report_types(self) -> tuple[str, ...] | None:
        return cages.report_types(self.cage_report_types, self.ring_sizes, self.max_faces)

    @classmethod
    def load(cls, text: str, preset: str | None = None, **overrides: object) -> Config:
        """From YAML or JSON text, by section or flat: defaults, then a preset, then the text, then overrides."""
        try:
            import yaml

            values = yaml.safe_load(text) or {}
        except ImportError:
            values = json.loads(text or "{}")
        preset = values.pop("preset", preset)
        if preset is not None and preset not in PRESETS:
            raise ValueError(f"presets are {', '.join(PRESETS)}")
        known = {f.name for f in fields(cls)}
        flat = dict(PRESETS[preset]) if preset else {}
        for key, value in values.items():
            if isinstance(value, dict) and key in SECTIONS:
                inner = dict(value)
                if key == "input":
                    values_of = inner.pop("lammps", {})
                    flat |= cls._section("lammps", values_of)
                flat |= cls._section(key, inner)
            elif key in known:
                flat[key] = value
            else:
                raise ValueError(f"unknown settings: {key}")
        if unknown := sorted(set(overrides) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        flat |= overrides
        flat = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()}
        if isinstance(flat.get("track"), dict):
            allowed = {f.name for f in fields(tracking.TrackingConfig)}
            if unknown := sorted(set(flat["track"]) - allowed):
                raise ValueError(f"unknown settings: {', '.join(f'track.{k}' for k in unknown)}")
            flat["track"] = tracking.TrackingConfig(**flat["track"])
        return cls(**flat)

    @staticmethod
    def _section(name: str, values: dict) -> dict:
        if unknown := sorted(set(values) - set(SECTIONS[name])):
            raise ValueError(f"unknown settings: {', '.join(f'{name}.{k}' for k in unknown)}")
        return {SECTIONS[name][k]: v for k, v in values.items()}

    def resolved(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    def rows(self) -> list[tuple[str, str]]:
        """(key, value) of all settings."""
        return report.flattened(asdict(self))


class Session:
    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()

    def read_frames(self, path: str, **options: object) -> DataFrame:
        return files.read_frames(self.spark, path, **options)

    def analyze(self, atoms: DataFrame, pairs: DataFrame | None = None) -> dict[str, DataFrame]:
        """Tables of waters, edges, rings, cages, occupancy, clusters, phases, order and a summary by frame.

        Tables that nobody reads are not computed, but for edges, rings and cages, which
        others build on.
        """
        c = self.config
        atoms = atoms.withColumn("time_ps", F.coalesce("time_ps", F.lit(c.first_file_time_ps) + F.col("frame_index") * F.lit(c.frame_time_step_ps)))
        blocks = checkpoint(select.molecules(atoms))
        waters = checkpoint(select.select_waters(blocks, c.water_resnames, c.oxygen_names, c.hydrogen_names))
        place = ["x", "y", "z", "lx", "ly", "lz"]
        points = waters.select(*K, F.col("oxygen").cast("long").alias("node"), "hydrogens").join(atoms.select(*K, F.col("atom").cast("long").alias("node"), *place), [*K, "node"])
        guests = checkpoint(self._centers(blocks, select.select_guests(blocks, c.guest_resnames, c.center_atoms, c.center_mode == "centroid")))
        mode = select.graph_mode(waters) if c.mode == "auto" else c.mode
        if mode == "pairs":
            if pairs is None:
                raise ValueError("graph mode pairs needs pairs")
            edges = self._with_vectors(select.pair_nodes(pairs, waters, atoms, c.pair_id), points)
        elif mode == "hbond":
            edges = neighbors.hbond_edges(self._hydrogens(points, atoms), c.oo_cutoff_nm, c.angle_deg)
        else:
            edges = neighbors.oo_edges(points, c.oo_cutoff_nm)
        edges = checkpoint(edges.select(*K, "u", "v", "dx", "dy", "dz", "dist"))
        found = checkpoint(rings.find_rings(edges, c.ring_sizes, shortest=c.ring_definition == "shortest_path"))
        shells = checkpoint(cages.find_cages(found.where("size <= 6"), c.max_faces, points, max_states=c.max_states))
        if c.validate_cages:
            shells = checkpoint(geometry.sound_cages(shells, found, points, c.max_planarity_nm, c.max_edge_cv, volume=c.min_volume_nm3))
        held = cages.occupancy(shells, found, points, guests, c.occupancy_mode, c.occupancy_radius_nm)
        held = checkpoint(held)
        kinds = cages.compositions(shells, held, guests)
        summary = graphs.degrees(points, edges).groupBy(*K).agg(F.count("*").alias("waters"), F.avg("degree").alias("mean_coordination"))
        summary = summary.join(edges.groupBy(*K).agg(F.count("*").alias("edges")), K, "left").join(found.groupBy(*K).pivot("size", list(c.ring_sizes)).count(), K, "left")
        summary = summary.join(kinds.groupBy(*K).agg(F.count("*").alias("cages"), F.count_if(F.col("occupancy") != "empty").alias("occupied")), K, "left").na.fill(0)
        return {
            "waters": waters, "guests": guests, "edges": edges, "rings": found, "cages": shells, "occupancy": kinds, "isomers": cages.isomers(shells, found), "clusters": cages.clusters(shells),
            "f3": order.f3(points, edges), "ql": order.ql(points, edges, c.ql), "ice": order.ice_classes(points, edges, found), "membership": files.membership(found, shells, held), "summary": summary,
            "points": points, "held": held, "frames": atoms.groupBy(*K).agg(*[F.first(n).alias(n) for n in ("frame", "time_ps", "source")]),
        }

    def report(self, tables: dict[str, DataFrame], atoms: DataFrame, failed: DataFrame | None = None) -> dict[str, DataFrame]:
        """The wide summary row of each frame, and the report tables that are cut from it.

        failed, of files.split_failed, adds a row for each frame that can't be read.
        """
        c = self.config
        found, shells, points = tables["rings"], tables["cages"], tables["points"]
        mode = select.graph_mode(tables["waters"]) if c.mode == "auto" else c.mode
        kept = cages.reported(tables["occupancy"], c.report_types())
        centers = rings.ring_centers(found, points).join(points.select(*K, "lx", "ly", "lz").distinct(), K)
        open_, warnings = patches.patches_and_warnings(found, centers, c.base_sizes, c.side_sizes, c.per_side, c.layers, c.layer_rings, c.layer_states, c.layer_candidates, c.search_policy == "exact")
        kinds = [k for k, on in (("half", c.half_cages), ("quasi", c.quasi_cages)) if on]
        open_ = checkpoint(patches.free_patches(open_.where(F.col("kind").isin(*kinds)), shells))
        used = open_.select(*K, F.explode("rings").alias("ring_id")).union(shells.select(*K, F.explode("rings").alias("ring_id")))
        focus = points.join(tables["waters"].where(F.col("resid").isin(*c.focus_waters)).select(*K, F.col("oxygen").cast("long").alias("node")), [*K, "node"], "left_semi") if c.focus_waters else None
        parts = [
            report._counts(atoms, "n_atoms"), report._counts(tables["waters"], "n_waters"), report._counts(tables["guests"], "n_guests"), report.connection_columns(points, tables["edges"], mode),
            report.ring_columns(found, used), report.patch_columns(open_), report.cage_columns(kept), report.breakdown(kept, "cage_type", "cage_types_found", ";"), report.molecule_columns(atoms), report.guest_order(tables["guests"]), report.ice_columns(tables["ice"]),
        ]
        names = order.parameters(c.order_parameters)
        heads = tables["frames"].select(*K)
        for name in names:
            parts.append(self._order_columns(name, tables, atoms, heads, focus))
        out = {"patches": open_, "warnings": warnings}
        if c.find_clusters:
            sides = checkpoint(cages.face_sides(shells, found, points))
            statuses = checkpoint(phases.phase_domains(shells, found, sides))
            members, domains = checkpoint(cages.clusters(shells, sides)), checkpoint(phases.domain_table(statuses, shells, sides))
            groups = checkpoint(phases.cluster_table(statuses, shells, sides, c.min_cage))
            parts.append(report.cluster_columns(groups, domains, members, shells, c.min_cage))
            out |= {"phases": statuses, "hydrate_domain": domains, "hydrate_cluster_detail": groups, "phase_labels": phases.phase_labels(statuses, shells, sides, c.min_cage)}
        rows = report.summary(tables["frames"], *parts)
        if failed is not None:
            rows = report.with_failures(rows, failed)
        rows = checkpoint(rows)
        types = list(c.report_types() or [r[0] for r in kept.select("cage_type").distinct().orderBy("cage_type").limit(1000).collect()])  # a column each
        out |= {"summary": rows, "failures": report.failures(rows), "connection": report.connection_table(rows), "ring": report.ring_table(rows, c.report_sizes()), "ice": report.ice_table(rows), "molecule": report.molecule_table(rows), "order_parameter": report.order_table(rows, names, bool(c.focus_waters))}
        out |= {"half_cage": report.patch_table(open_, "half"), "quasi_cage": report.patch_table(open_, "quasi"), "quasi_cage_isomer": report.quasi_isomers(open_)}
        if types:
            out |= {"cage": report.cage_table(kept, types), "cage_isomer": report.isomer_table(tables["isomers"], types)}
        if c.find_clusters:
            out["hydrate_cluster"] = report.hydrate_table(rows)
        return out

    def _order_columns(self, name: str, tables: dict[str, DataFrame], atoms: DataFrame, heads: DataFrame, focus: DataFrame | None) -> DataFrame:
        c, points, edges = self.config, tables["points"], tables["edges"]
        if name == "f3":
            return report.mean_columns(tables["f3"], "f3", "F3", focus)
        if name == "f4":
            return report.mean_columns(order.f4(self._hydrogens(points, atoms), edges), "f4", "F4", focus)
        if name.startswith("q"):
            return report.mean_columns(order.ql_by_mode(points, edges, (int(name[1:]),), c.q_mode, c.q_count, c.q_cutoff_nm), name, name, focus)
        if name.startswith("mcg"):
            near = checkpoint(order.mcg_edges(tables["guests"], points, c.mcg_guest_cutoff_nm, c.mcg_water_cutoff_nm, c.mcg_angle_deg, c.mcg_min_waters))
            found = order.mcg(heads, near, int(name[3:]))
        else:
            found = order.dhop(heads, points, checkpoint(neighbors.oo_edges(points)), float(name[4:]), c.dhop_counts, c.dhop_least)
        return found.select(*K, F.col("largest").alias(f"{name.upper()}_largest_cluster"))

    def phases(self, tables: dict[str, DataFrame]) -> DataFrame:
        return phases.phase_domains(tables["cages"], tables["rings"])

    def snapshots(self, tables: dict[str, DataFrame], labels: DataFrame | None = None) -> DataFrame:
        """What tracking needs of each cage: waters, centre, sizes of its faces, guests, and phases if labels(K, cage_id, phases) are given."""
        shells = tables["cages"]
        centers = cages.cage_centers(shells, tables["points"]).select(*K, "cage_id", "cx", "cy", "cz", "lx", "ly", "lz")
        faces = shells.select(*K, "cage_id", F.explode("rings").alias("ring_id")).join(tables["rings"].select(*K, "ring_id", "size"), [*K, "ring_id"])
        topology = faces.groupBy(*K, "cage_id").agg(F.array_sort(F.collect_list("size")).alias("topology"))
        held = tables["held"].groupBy(*K, "cage_id").agg(F.array_sort(F.collect_list(F.col("guest").cast("string"))).alias("guests"))
        rows = shells.join(tables["frames"].select(*K, "time_ps"), K).select(*K, "time_ps", "cage_id", "cage_type", "waters")
        rows = rows.join(centers, [*K, "cage_id"]).join(topology, [*K, "cage_id"]).join(held, [*K, "cage_id"], "left")
        rows = rows.withColumn("guests", F.coalesce("guests", F.array().cast("array<string>")))
        return rows if labels is None else rows.join(labels, [*K, "cage_id"])

    def track(self, tables: dict[str, DataFrame], atoms: DataFrame, labels: DataFrame | None = None) -> dict[str, DataFrame]:
        """Observations, events, lifetimes, population and residences of an analysis' cages, over all its frames."""
        c = self.config.track
        frames = checkpoint(tables["frames"].select(*K, "time_ps"))
        seen, candidates = tracking.track(self.snapshots(tables, labels), c, frames)
        made = state.track_tables(seen, tracking.event_table(seen, candidates, frames, c.gap_frame), frames, gap_frame=c.gap_frame)
        return {**made, "distribution": made["lifetime_distribution"], "frames": frames}

    @staticmethod
    def _centers(blocks: DataFrame, guests: DataFrame) -> DataFrame:
        """(K, node, resname, x, y, z, lx, ly, lz): guests at their centre atom, or at the mean of their atoms near the first one."""
        from latticework.functions.pbc import delta, vec

        own = guests.select(*K, "block", "resname", "node", "center", F.coalesce("center", "node").alias("anchor"))
        first = blocks.select(*K, F.col("atom").alias("anchor"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
        rows = own.join(first, [*K, "anchor"]).join(blocks.select(*K, "block", "x", "y", "z", "lx", "ly", "lz"), [*K, "block"])
        near = delta(vec("a"), vec(""), vec("l"))
        mean = [F.avg(F.when(F.col("center").isNull(), d).otherwise(0.0)) for d in near]
        found = rows.groupBy(*K, F.col("node").cast("long").alias("node"), "resname")
        return found.agg(*[(F.first(f"a{c}") + d).alias(c) for c, d in zip("xyz", mean, strict=True)], *[F.first(f"l{c}").alias(f"l{c}") for c in "xyz"])

    @staticmethod
    def _hydrogens(points: DataFrame, atoms: DataFrame) -> DataFrame:
        from latticework.functions.pbc import delta, vec

        h = points.select(*K, "node", "x", "y", "z", "lx", "ly", "lz", F.posexplode("hydrogens").alias("k", "h"))
        at = atoms.select(*K, F.col("atom").alias("h"), *[F.col(c).alias(f"h{c}") for c in "xyz"])
        d = delta(vec(""), vec("h"), vec("l"))
        vectors = h.join(at, [*K, "h"]).groupBy(*K, "node").agg(F.array_sort(F.collect_list(F.struct("k", *[x.alias(c) for c, x in zip("xyz", d, strict=True)]))).alias("hydrogens"))
        return points.drop("hydrogens").join(vectors, [*K, "node"])

    @staticmethod
    def _with_vectors(edges: DataFrame, points: DataFrame) -> DataFrame:
        from latticework.functions.pbc import delta, norm, vec

        end = lambda n: points.select(*K, F.col("node").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"], *(["lx", "ly", "lz"] if n == "u" else []))
        rows = edges.join(end("u"), [*K, "u"]).join(end("v"), [*K, "v"])
        d = delta(vec("u"), vec("v"), vec("l"))
        return rows.select(*K, "u", "v", *[x.alias(f"d{c}") for c, x in zip("xyz", d, strict=True)]).withColumn("dist", norm(vec("d")))
