"""Coordinate files as atom tables, and back.

Files are read by Spark (any store, globs and folders included), split by split, and parsed
in tasks, one frame at a time. Lengths are in nm.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K

ATOMS = "group_key string, frame_index int, frame string, source string, time_ps double, atom int, resid int, resname string, atomname string, atomid int, x double, y double, z double, vx double, vy double, vz double, lx double, ly double, lz double"
_FIELDS = [f.split() for f in ATOMS.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in _FIELDS])
_TIME = re.compile(r"\b(?:t|time_ps)\s*=\s*([-+0-9.eE]+)", re.IGNORECASE)
#: Length of a unit in nm and time step units in ps, by the dump's unit style.
UNITS = {"real": (0.1, 0.001), "metal": (0.1, 1.0), "nano": (1.0, 1000.0)}


class FormatError(ValueError):
    """A file that doesn't hold what its format asks for."""


def _number(text: str, where: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise FormatError(f"{where}: {text!r} is no number") from None
    if not math.isfinite(value):
        raise FormatError(f"{where}: {text!r} is not finite")
    return value


def gro_box(line: str) -> tuple[float | None, float | None, float | None]:
    """Lengths of a box line of three or nine numbers; all zero means no period; tilted boxes are refused."""
    values = [_number(v, "box") for v in line.split()]
    if len(values) not in (3, 9):
        raise FormatError(f"a box line has 3 or 9 numbers, not {len(values)}")
    if any(abs(v) > 1e-9 for v in values[3:]):
        raise FormatError("triclinic boxes are not supported")
    if all(v == 0 for v in values[:3]):
        return None, None, None
    if any(v <= 0 for v in values[:3]):
        raise FormatError("a box is periodic along all axes or along none")
    return values[0], values[1], values[2]


def gro_atom(line: str) -> tuple:
    """(resid, resname, atomname, atomid, x, y, z, vx, vy, vz) of a fixed-width record, or one parted by blanks."""
    line = line.split(";")[0].rstrip()
    try:
        head = int(line[:5]), line[5:10].strip(), line[10:15].strip(), int(line[15:20])
        body = line[20:]
        values = [float(body[k : k + 8]) for k in range(0, 24, 8)]
        rest = [float(body[k : k + 8]) for k in range(24, min(len(body), 48), 8)]
        if len(body) < 24:
            raise ValueError
    except ValueError:
        parts = line.split()
        match = re.fullmatch(r"(\d+)(\D\S*)", parts[0]) if parts else None
        if match is None or len(parts) not in (6, 9):
            raise FormatError(f"no atom record: {line!r}") from None
        head = int(match[1]), match[2], parts[1], int(_number(parts[2], "atom number"))
        values, rest = [_number(v, "coordinate") for v in parts[3:6]], [_number(v, "velocity") for v in parts[6:]]
    if not all(map(math.isfinite, values + rest)):
        raise FormatError(f"coordinates are not finite: {line!r}")
    return (*head, *values, *(rest if len(rest) == 3 else (None, None, None)))


def read_gro_text(text: str) -> Iterator[tuple[str, float | None, tuple, list[tuple]]]:
    """(title, time, box, atoms) of each stacked block; the atoms' identities may not change."""
    lines, at, first = text.splitlines(), 0, None
    while at < len(lines):
        if not lines[at].strip() and all(not x.strip() for x in lines[at:]):
            return
        title = lines[at]
        try:
            count = int(lines[at + 1].split(";")[0])
            atoms = [gro_atom(x) for x in lines[at + 2 : at + 2 + count]]
            box = gro_box(lines[at + 2 + count].split(";")[0])
        except (IndexError, ValueError) as e:
            raise e if isinstance(e, FormatError) else FormatError(f"block at line {at + 1} is incomplete") from None
        identity = [a[:4] for a in atoms]
        if first is not None and identity != first:
            raise FormatError(f"atoms of the block at line {at + 1} differ from those before")
        first = identity
        found = _TIME.search(title)
        yield title.strip(), float(found[1]) if found else None, box, atoms
        at += count + 3


def read_xyz_text(text: str, scale: float = 0.1) -> Iterator[tuple[str, None, tuple, list[tuple]]]:
    """The one frame of count, comment and ``name x y z`` lines; every atom is a residue of its own."""
    lines = text.splitlines()
    if len(lines) < 2 or not lines[0].strip().isdigit() or len(lines) < 2 + int(lines[0]):
        raise FormatError("an XYZ file has a count, a comment and that many atoms")
    atoms = []
    for k, line in enumerate(lines[2 : 2 + int(lines[0])], 1):
        parts = line.split()
        if len(parts) < 4:
            raise FormatError(f"no atom record: {line!r}")
        atoms.append((k, parts[0], parts[0], k, *[_number(v, "coordinate") * scale for v in parts[1:4]], None, None, None))
    yield lines[1].strip(), None, (None, None, None), atoms


def read_dump_text(text: str, units: str = "real", timestep: float = 1.0) -> Iterator[tuple[str, float, tuple, list[tuple]]]:
    """Frames of a text dump: periodic straight boxes, plain, scaled or unwrapped positions, atoms by id."""
    if units not in UNITS:
        raise FormatError(f"units are one of {sorted(UNITS)}")
    length, ps = UNITS[units]
    sections = re.split(r"^ITEM: ", text, flags=re.MULTILINE)[1:]
    step = bounds = None
    for section in sections:
        head, _, body = section.partition("\n")
        if head.startswith("TIMESTEP"):
            step, bounds, count = int(body.split()[0]), None, None
        elif head.startswith("NUMBER OF ATOMS"):
            count = int(body.split()[0])
        elif head.startswith("BOX BOUNDS"):
            if "xy" in head.split():
                raise FormatError("triclinic boxes are not supported")
            if head.split()[2:] != ["pp"] * 3:
                raise FormatError("boxes must be periodic along all axes")
            bounds = [tuple(map(float, x.split()[:2])) for x in body.splitlines()[:3]]
        elif head.startswith("ATOMS"):
            if step is None or bounds is None:
                raise FormatError("atoms come after their step and box")
            names = head.split()[1:]
            style = next((s for s in ("", "u", "s", "su") if all(f"{c}{s}" in names for c in "xyz")), None)
            if style is None or "id" not in names:
                raise FormatError("a dump needs id and x y z (or xs, xu, xsu)")
            rows = [x.split() for x in body.splitlines() if x.strip()]
            if len(rows) != count or any(len(r) != len(names) for r in rows):
                raise FormatError(f"step {step} is incomplete")
            at = {n: k for k, n in enumerate(names)}
            if len({r[at["id"]] for r in rows}) != len(rows):
                raise FormatError(f"step {step} repeats an atom id")
            atoms = []
            for r in sorted(rows, key=lambda r: int(r[at["id"]])):
                place = []
                for c, (low, high) in zip("xyz", bounds, strict=True):
                    v = _number(r[at[c + style]], "coordinate")
                    place.append(((v * (high - low)) if "s" in style else v - low) * length)
                kind = r[at["type"]] if "type" in at else "0"
                atoms.append((int(r[at["mol"]]) if "mol" in at else int(r[at["id"]]), kind, kind, int(r[at["id"]]), *place, None, None, None))
            yield f"step {step}", step * timestep * ps, tuple((h - lo) * length for lo, h in bounds), atoms


PARSERS = {".gro": read_gro_text, ".xyz": read_xyz_text, ".dump": read_dump_text, ".lammpstrj": read_dump_text}
_OPTIONS = {".gro": (), ".xyz": ("scale",), ".dump": ("units", "timestep"), ".lammpstrj": ("units", "timestep")}
_BINARY = (".xtc", ".trr", ".dcd")


_SUFFIX = r"\.[^./]*$"
_MARK = "ITEM: TIMESTEP"
_LINES = "source string, start long, line long, mark long, value string"


def _listed(spark: SparkSession, path: str, pattern: str | None, recursive: bool) -> DataFrame:
    """(source, suffix) of all files of a path; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("source"), F.lower(F.regexp_extract("path", _SUFFIX, 0)).alias("suffix"))


def natural_key(name: Column) -> Column:
    """Something that sorts names as people do, runs of digits by their value."""
    parts = F.split(name, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    number = lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 40, "0")).otherwise(p)
    return F.transform(parts, number)


def _numbered_lines(spark: SparkSession, path: str, pattern: str | None, recursive: bool, suffixes: list[str] | None) -> DataFrame:
    """_LINES of all text files, or those with one of the suffixes: each line's place in its split, and the frame marks up to it there."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), "value")
    if suffixes is not None:
        rows = rows.where(F.lower(F.regexp_extract("source", _SUFFIX, 0)).isin(*suffixes))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, mark = None, 0, 0
        for batch in batches:
            places, marks = [], []
            for source, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (source, start) != key:
                    key, line, mark = (source, start), 0, 0
                mark += value.startswith(_MARK)
                places.append(line)
                marks.append(mark)
                line += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(marks, pa.int64()), batch.column(2)], names=[c.split()[0] for c in _LINES.split(", ")])

    return rows.mapInArrow(kernel, _LINES)


def _placed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines by their place in the file, a row for each file with its last line that is not blank, marks, and second line)."""
    solid = F.when(F.trim("value") != "", F.col("line"))
    second = F.max(F.when((F.col("start") == 0) & (F.col("line") == 1), F.col("value")))
    splits = checkpoint(lines.groupBy("source", "start").agg(F.count("*").alias("n"), F.max("mark").alias("marks"), F.max(solid).alias("solid"), second.alias("second")))
    before = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    skip = splits.select("source", "start", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("n", "marks")], "solid", "marks", "second")
    whole = skip.groupBy("source").agg((F.max(F.col("n_0") + F.col("solid")) + 1).alias("lines"), F.max(F.col("marks_0") + F.col("marks")).alias("marks"), F.max("second").alias("second"))
    placed = lines.join(skip.select("source", "start", "n_0", "marks_0"), ["source", "start"])
    return placed.select("source", (F.col("line") + F.col("n_0")).alias("line"), (F.col("mark") + F.col("marks_0") - 1).alias("mark"), "value"), whole


def _by_frame(lines: DataFrame, whole: DataFrame, suffix: str, lenient: bool) -> tuple[DataFrame, DataFrame]:
    """(lines with frame, (source, frames)) of one format: stacked blocks of equal length, marked frames, or one frame a file."""
    if suffix == ".xyz":
        return lines.withColumn("frame", F.lit(0).cast("long")), whole.select("source", F.lit(1).cast("long").alias("frames"))
    if suffix != ".gro":
        return lines.withColumn("frame", F.col("mark")).where("frame >= 0"), whole.select("source", F.col("marks").alias("frames"))
    # the second line of a block counts its atoms; as these may not change, blocks are of one length
    count = F.regexp_extract("second", r"^\s*(\d+)\s*(?:;.*)?$", 1).try_cast("long")
    sized = whole.select("source", (count + 3).alias("block"), "lines")
    if lenient:  # a file that is not made of blocks is one frame, which then fails
        sized = sized.withColumn("block", F.when(F.col("lines") % F.col("block") == 0, F.col("block")).otherwise(F.greatest("lines", F.lit(1))))
    bad = F.raise_error(F.concat(F.lit("a block is incomplete, or its atoms differ from those before: "), "source"))
    frames = F.when(F.col("block").isNull() | (F.col("lines") % F.col("block") != 0), bad.cast("long")).otherwise((F.col("lines") / F.col("block")).cast("long"))
    kept = lines.join(sized, "source").where("line < lines").withColumn("frame", F.floor(F.col("line") / F.col("block")))
    return kept.select("source", "line", "value", "frame"), sized.select("source", frames.alias("frames"))


#: Place of the row that stands for a frame which can't be read; its frame is the reason.
FAILED = -1


def _parsed(lines: DataFrame, suffix: str, options: dict, lenient: bool = False) -> DataFrame:
    """Atoms of frames of lines(source, frame, line, value), each frame in one task, and identity, a digest of what may not change."""
    schema = _ARROW.append(pa.field("identity", pa.string()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def frame() -> pa.RecordBatch:
            try:
                found = list(PARSERS[suffix]("\n".join(held), **options))
                if len(found) != 1:
                    raise FormatError(f"frame {key[1]} of {key[0]} is incomplete")
                title, time, box, atoms = found[0]
                own = hashlib.md5(repr([a[:4] for a in atoms]).encode()).hexdigest() if suffix == ".gro" else ""
                rows = [("A", key[1], title, key[0], time, n, *a, *box, own) for n, a in enumerate(atoms)]
            except ValueError as e:
                if not lenient:
                    raise
                rows = [("A", key[1], str(e), key[0], None, FAILED, *[None] * 13, "")]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for source, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (source, n) != key:
                    if held:
                        yield frame()
                    key, held = (source, n), []
                held.append(value)
        if held:
            yield frame()

    dealt = lines.select("source", "frame", "line", "value").repartition("source", "frame").sortWithinPartitions("source", "frame", "line")
    return dealt.select("source", "frame", "value").mapInArrow(kernel, f"{ATOMS}, identity string")


def read_frames(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, stacked: bool = True, lenient: bool = False, form: str | None = None, **options: object) -> DataFrame:
    """Atoms of all files of a path, folder or glob; frames are numbered by file (natural order) and place in it.

    The format follows from the suffix, or is form (gro, xyz, dump) for files of any name;
    otherwise files with another suffix in a folder are passed over. Texts are
    read by split: a first pass counts lines, a second deals them out by frame, so a file
    may be of any size and a task holds one frame. options go to the parser (scale, units,
    timestep). lenient turns a frame that can't be read into one row, for split_failed,
    where otherwise the whole run fails.
    """
    if form is not None and f".{form}" not in PARSERS:
        raise FormatError(f"formats are {', '.join(sorted(p[1:] for p in PARSERS))}")
    suffixes = [f".{form}"] if form else [r[0] for r in _listed(spark, path, pattern, recursive).select("suffix").distinct().collect()]  # the kinds of files
    if binary := sorted(set(suffixes) & set(_BINARY)):
        raise FormatError(f"{binary[0]} needs a decoder that this engine does not have")
    known = sorted(set(suffixes) & set(PARSERS))
    if suffixes and not known:
        raise FormatError(f"no format for files of {path}")
    if strange := sorted(set(options) - {o for s in known for o in _OPTIONS[s]}):
        raise ValueError(f"no such option for these files: {', '.join(strange)}")
    parts, counts = [], []
    for suffix in known:
        lines, whole = _placed(_numbered_lines(spark, path, pattern, recursive, None if form else [suffix]))
        lines, frames = _by_frame(lines, whole, suffix, lenient)
        own = {k: v for k, v in options.items() if k in _OPTIONS[suffix]}
        parts.append(_parsed(lines, suffix, own, lenient))
        counts.append(frames)
    if not parts:
        return spark.createDataFrame([], ATOMS)
    frames = checkpoint(reduce(DataFrame.unionByName, counts))
    if not stacked and (many := frames.where("frames > 1").first()):
        raise FormatError(f"{many[0]} has more than one frame")
    order = Window.orderBy(natural_key(F.col("source"))).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    skip = checkpoint(frames.select("source", F.coalesce(F.sum("frames").over(order), F.lit(0)).cast("int").alias("skip")))
    atoms = reduce(DataFrame.unionByName, parts).join(skip, "source").withColumn("frame_index", F.col("frame_index") + F.col("skip"))
    if ".gro" in known and not lenient and frames.where("frames > 1").limit(1).count():
        # the first frame's identity is compared with every frame's
        lead = reduce(DataFrame.unionByName, [p.where("frame_index = 0") for p, s in zip(parts, known, strict=True) if s == ".gro"])
        same = checkpoint(lead.groupBy("source").agg(F.first("identity").alias("expected")))
        other = F.raise_error(F.concat(F.lit("atoms of a block differ from those before: "), "source"))
        atoms = atoms.join(same, "source", "left").withColumn("source", F.when(F.col("expected").isNull() | (F.col("expected") == F.col("identity")), F.col("source")).otherwise(other.cast("string")))
    return atoms.select(*[n for n, _ in _FIELDS])


def split_failed(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, failed) of a lenient reading; failed is (K, frame, time_ps, source, error), a row for each frame that can't be read."""
    bad = atoms.where(F.col("atom") == FAILED).select(*K, F.lit(None).cast("string").alias("frame"), "time_ps", "source", F.col("frame").alias("error"))
    return atoms.where(F.col("atom") != FAILED), bad


def frame_slice(atoms: DataFrame, indexes: list[int]) -> DataFrame:
    """The frames of sorted, unique, non-negative indexes."""
    if any(i < 0 for i in indexes):
        raise ValueError("frame indexes are not negative")
    return atoms.where(F.col("frame_index").isin(sorted(set(indexes))))


def apply_type_map(atoms: DataFrame, mapping: dict[str, tuple[str, str] | None]) -> DataFrame:
    """Atoms of numeric types with names (resname, atomname); types mapped to None are left out, unknown ones are an error."""
    spark = atoms.sparkSession
    table = spark.createDataFrame([(k, *(v or (None, None)), v is None) for k, v in mapping.items()], "resname string, new_res string, new_atom string, ignored boolean")
    joined = atoms.join(F.broadcast(table), "resname", "left")
    missing = F.raise_error(F.concat(F.lit("no entry for atom type "), "resname"))
    marked = joined.withColumn("ignored", F.when(F.col("ignored").isNull(), missing.cast("boolean")).otherwise(F.col("ignored"))).where("NOT ignored")
    return marked.withColumn("resname", F.col("new_res")).withColumn("atomname", F.col("new_atom")).select(*atoms.columns)


#: A line of a pair file without its comment: two ids, parted and surrounded by blanks, commas or semicolons.
_PARTED = "[,; \\t\\n\\x0b\\f\\r]"
_PAIR = f"^{_PARTED}*(?P<u>[0-9]+){_PARTED}+(?P<v>[0-9]+){_PARTED}*$"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of each line of a pair file: two ids parted by blanks, commas or semicolons; # starts a comment."""

    pattern, blank = _PAIR, f"^{_PARTED}*$"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = pc.replace_substring_regex(batch.column("value"), pattern="(?s)#.*$", replacement="")
            found = pc.extract_regex(body, pattern=pattern)
            if found.null_count:
                bad = pc.filter(body, pc.and_(found.is_null(), pc.invert(pc.match_substring_regex(body, pattern=blank))))
                if len(bad):
                    raise ValueError(f"no pair of ids: {bad[0].as_py()}")
                found = found.drop_null()
            yield pa.RecordBatch.from_arrays([pc.cast(pc.struct_field(found, n), pa.int64()) for n in "uv"], names=["u", "v"])

    return spark.read.text(path).mapInArrow(kernel, "u bigint, v bigint").where("u <> v")


def gro_lines(atoms: DataFrame) -> DataFrame:
    """(K, place, line): the text of each frame as a GRO block, to be ordered by place."""
    number = lambda c: F.format_string("%8.3f", c)
    wrap = lambda c: F.pmod(F.col(c), F.lit(100000)).cast("int")
    record = F.concat(F.format_string("%5d", wrap("resid")), F.rpad("resname", 5, " "), F.lpad("atomname", 5, " "), F.format_string("%5d", wrap("atomid")), number("x"), number("y"), number("z"))
    if "vx" in atoms.columns:
        speed = F.concat(*[F.format_string("%8.4f", f"v{c}") for c in "xyz"])
        record = F.concat(record, F.when(F.col("vx").isNotNull() & F.col("vy").isNotNull() & F.col("vz").isNotNull(), speed).otherwise(""))
    body = atoms.select(*K, (F.col("atom") + 2).cast("long").alias("place"), record.alias("line"))
    frame = atoms.groupBy(*K).agg(F.first("frame").alias("frame"), F.first("time_ps").alias("time"), F.count("*").alias("n"), *[F.first(f"l{c}").alias(f"l{c}") for c in "xyz"])
    side = F.concat(*[F.format_string("%10.5f", F.coalesce(f"l{c}", F.lit(0.0))) for c in "xyz"])
    timed = F.when(F.col("time").isNull() | F.col("frame").rlike(r"(?i)\b(t|time_ps)\s*="), F.col("frame")).otherwise(F.concat("frame", F.lit(" t= "), F.col("time").cast("string")))
    ends = frame.select(*K, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), timed.alias("line")), F.struct(F.lit(1).cast("long").alias("place"), F.col("n").cast("string").alias("line")), F.struct(F.lit(1 << 60).alias("place"), side.alias("line")))).alias("e"))
    return body.unionByName(ends.select(*K, "e.place", "e.line"))


def write_gro(atoms: DataFrame, folder: str) -> None:
    """A folder for each frame, with one text file."""
    write_lines(gro_lines(atoms), folder)


def xyz_lines(atoms: DataFrame, scale: float = 0.1) -> DataFrame:
    """(K, place, line): the text of each frame as an XYZ file, lengths divided by scale."""
    number = lambda c: F.format_string("%.6f", F.col(c) / scale)
    body = atoms.select(*K, (F.col("atom") + 2).cast("long").alias("place"), F.concat_ws(" ", "atomname", *map(number, "xyz")).alias("line"))
    count = atoms.groupBy(*K).agg(F.count("*").cast("string").alias("n"), F.first("frame").alias("frame"))
    head = count.select(*K, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.col("n").alias("line")), F.struct(F.lit(1).cast("long").alias("place"), F.coalesce("frame", F.lit("")).alias("line")))).alias("e"))
    return body.unionByName(head.select(*K, "e.place", "e.line"))


def dump_lines(atoms: DataFrame, scale: float = 0.1) -> DataFrame:
    """(K, place, line): the text of each frame as a block of a text dump in periodic boxes, its step being the frame's index."""
    number = lambda c: F.format_string("%.6f", c)
    body = atoms.select(*K, (F.col("atom") + 9).cast("long").alias("place"), F.concat_ws(" ", F.col("atomid").cast("string"), "atomname", *[number(F.col(c) / scale) for c in "xyz"]).alias("line"))
    frame = atoms.groupBy(*K).agg(F.count("*").cast("string").alias("n"), *[F.first(f"l{c}").alias(f"l{c}") for c in "xyz"])
    head = [F.lit(_MARK), F.col("frame_index").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("n"), F.lit("ITEM: BOX BOUNDS pp pp pp"), *[F.concat(F.lit("0 "), number(F.col(f"l{c}") / scale)) for c in "xyz"], F.lit("ITEM: ATOMS id type x y z")]
    return body.unionByName(frame.select(*K, F.posexplode(F.array(*head)).alias("place", "line")).withColumn("place", F.col("place").cast("long")))


def write_lines(lines: DataFrame, folder: str, stacked: bool = False) -> None:
    """Frames of lines(K, place, line) as text: a folder and a file for each, or all frames of a group in one file in their order."""
    if stacked:
        dealt = lines.repartition("group_key").sortWithinPartitions(*K, "place")
        dealt.select("group_key", "line").write.partitionBy("group_key").mode("errorifexists").text(folder)
    else:
        dealt = lines.repartition(*K).sortWithinPartitions(*K, "place")
        dealt.select(*K, "line").write.partitionBy(*K).mode("errorifexists").text(folder)


def membership(rings: DataFrame, cages: DataFrame, held: DataFrame) -> DataFrame:
    """(K, record, object_id, kind, member): the waters of rings and cages, and the guests of cages."""
    parts = [
        rings.select(*K, F.lit("R").alias("record"), F.col("ring_id").alias("object_id"), F.concat(F.lit("ring"), "size").alias("kind"), F.explode("nodes").alias("member")),
        cages.select(*K, F.lit("M").alias("record"), F.col("cage_id").alias("object_id"), F.col("cage_type").alias("kind"), F.explode("waters").alias("member")),
        held.select(*K, F.lit("G").alias("record"), F.col("cage_id").alias("object_id"), F.lit("guest").alias("kind"), F.col("guest").alias("member")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Every table in a folder of its own name; existing ones are an error. form is parquet, csv or json; arrays go to csv as JSON."""
    for name, df in tables.items():
        if form == "csv":
            df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        writer = df.write.mode("errorifexists")
        (writer.option("header", "true") if form == "csv" else writer).format(form).save(f"{folder}/{name}")
