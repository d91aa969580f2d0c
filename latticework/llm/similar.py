"""Near-duplicates by a stated Jaccard similarity: SimHash BK-trees, verified exactly.

Copies of similarity 0.8 differ in about 15 % of SimHash bits, too many for shards cut from
the fingerprint itself. Here a shard is one MinHash band: texts of 0.8 share one of 16
bands of four values with a chance of 0.9998. Within a shard a BK-tree of 256-bit SimHash
fingerprints finds all texts within ``RADIUS`` bits (mean plus four deviations at 0.8), and
a spanning forest of these candidates leaves the shard. Its components are candidate
groups, which hold every link that bands and radius admit.

Each group's shingle sets then meet once, in cells of at most two chunks of ``SHARD`` texts
and ``CELL_BYTES``; a group of more than a chunk's texts is parted by its bands, so that
cells grow with texts and not with their square. Pairs that share a band and are within the
radius are checked by exact similarity, in groups of any size alike, and a spanning forest of
the links that hold is closed to components. No candidate is passed over but those between
texts that are linked already. Texts of equal shingle sets are one node throughout.

Sets of up to ``FEW`` shingles that are linked differ by one shingle, and few shingles make
fingerprints uncertain. They are linked exactly, by joining a set's digest to the digests of
others without one of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import ROW, checkpoint, give_back, row_key, unpacked, whole_row
from latticework.llm.components import connected_components
from latticework.llm.simhash import SHARD, BKTree, bit_counts

BANDS, ROWS = 16, 4
RADIUS = 64
#: Sets of 0.8 with at most so many shingles in the larger differ by one.
FEW = 8
#: Bytes of shingle sets in a chunk of a cell, but for a single set that is larger.
CELL_BYTES = 8 << 20
#: Shared hashes counted at a time when a set is compared with a cell.
_COUNTED = 1 << 20
#: Linked documents whose ids are broadcast when their texts are fetched; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _RNG.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words: the whole sequence; none: nothing."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(line[s:e]) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def _mixed(h: np.ndarray, factor: np.ndarray) -> np.ndarray:
    x = h * factor
    return x ^ (x >> np.uint64(29))


def _least(h: np.ndarray) -> np.ndarray:
    """Least value of the set under each permutation; long sets in parts of bounded size."""
    parts = [_mixed(h[None, k : k + 4096], _MULTIPLY[:, None]).min(axis=1) for k in range(0, len(h), 4096)]
    return np.minimum.reduce(parts)


def sketch(h: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Digest of the set, its 256-bit SimHash, and its band keys of eight bytes each."""
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return digest, bytes(32), b""
    sim = b"".join(np.packbits(bit_counts(np.ascontiguousarray(_mixed(h, f))) * 2 > len(h), bitorder="little").tobytes() for f in _SPREAD)
    least = _least(h).reshape(BANDS, ROWS)
    keys = b"".join(xxhash.xxh3_64_digest(row.tobytes(), seed=k) for k, row in enumerate(least))
    return digest, sim, keys


def fewer(h: np.ndarray) -> bytes:
    """For sets of two to FEW shingles: the digests, 16 bytes each, of the set without each of its members."""
    return b"".join(xxhash.xxh3_128_digest(np.delete(h, k).tobytes()) for k in range(len(h))) if 2 <= len(h) <= FEW else b""


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, ROW..., digest, sim, bands, fewer) for each row of docs(doc_id, text)."""
    made = ["digest", "sim", "bands", "fewer"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[bytes]] = [[] for _ in made]
            for t in batch.column(0):
                h = shingle_set(t.as_py(), shingle)
                for column, value in zip(out, (*sketch(h), fewer(h)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, pa.binary()) for c in out]], names=["doc_id", *ROW, *made])
            del out
            give_back()

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(F.col("text").cast("binary").alias("text"), doc_id.alias("doc_id"), *row_key(doc_id, F.col("text")))
    return source.mapInArrow(kernel, "doc_id long, unnamed boolean, id long, v1 long, v2 long, " + ", ".join(f"{c} binary" for c in made))


class Forest:
    """Which items are linked already."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        """Link a and b; whether they were apart."""
        a, b = self.top(a), self.top(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


class Overlap:
    """Exact similarity of a set to each of several sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.hashes = np.concatenate(sets)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def jaccard(self, s: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.hashes, s)
        met = np.searchsorted(self.hashes, s, "right") - low
        common = np.zeros(len(self.sizes), np.int64)
        step = max(1, _COUNTED // len(self.sizes))  # each hash is in every set once at most
        for k in range(0, len(s), step):
            n, start = met[k : k + step], low[k : k + step]
            at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
            common += np.bincount(self.owners[at], minlength=len(common))
        return common / np.maximum(self.sizes + len(s) - common, 1)


def forest_links(tree_of: list[tuple], probes: list[tuple], radius: int, similarity: float | None = None) -> list[tuple[int, int]]:
    """Spanning links of (id, fingerprint, set, bands) items within radius: probes against tree_of, or without probes tree_of in itself.

    With a similarity, links are between sets of that exact Jaccard similarity or more which
    share a band; items without bands all share one.
    """
    tree, slots, forest, links, exact = BKTree(), [], Forest(), [], None
    bands = np.array([np.frombuffer(t[3], "<i8") for t in tree_of]) if similarity is not None and tree_of and tree_of[0][3] else None

    def add(k: int) -> None:
        at = tree.add(tree_of[k][1])
        if at == len(slots):
            slots.append([])
        slots[at].append(k)

    for k in range(len(tree_of) if probes else 0):
        add(k)
    for n, item in enumerate(probes or tree_of):
        near = [k for at in tree.within(item[1], radius) for k in slots[at]]
        if not probes:
            add(n)
        near = [k for k in near if forest.top(tree_of[k][0]) != forest.top(item[0])]
        if near and bands is not None:
            near = [k for k, same in zip(near, (bands[near] == np.frombuffer(item[3], "<i8")).any(axis=1).tolist(), strict=True) if same]
        if near and similarity is not None:
            if len(near) == 1:
                there = {near[0]: Overlap([tree_of[near[0]][2]]).jaccard(item[2])[0]}
            else:
                exact = exact or Overlap([t[2] for t in tree_of])
                there = exact.jaccard(item[2])
            near = [k for k in near if there[k] >= similarity - 1e-9]
        links += [(item[0], tree_of[k][0]) for k in near if forest.tie(item[0], tree_of[k][0])]
    return links


def cell_links(keyed: DataFrame, radius: int, similarity: float | None = None, sets: DataFrame | None = None, shard: int = SHARD, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Links (a, b) of keyed(shard, rep, sim, bands, weight), a spanning forest for each cell of two chunks of a shard; weight is the bytes of a rep's set in sets(rep, set)."""
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).where("n > 1")
    chunks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / shard), F.ceil(F.col("bytes") / cell_bytes)).cast("long"))
    cells = (
        keyed.join(sizes.select("shard", chunks.alias("chunks")), "shard")
        .withColumn("own", F.pmod(F.xxhash64("rep"), "chunks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("probe"), "rep", "sim", "bands")
    )
    cells = cells.withColumn("set", F.lit(b"")) if sets is None else cells.join(sets, "rep").select(*cells.columns, "set")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, probes, out = None, [], [], set()

        def close() -> None:
            if tree and (probes or (key[1] == key[2] and len(tree) > 1)):
                out.update((max(p), min(p)) for p in forest_links(tree, probes, radius, similarity))

        def rows() -> pa.RecordBatch:
            both = np.array(sorted(out), np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            sets = batch.column(7)
            for n, (s, i, j, probe, rep, sim, bands) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)):
                if (s, i, j) != key:
                    close()
                    key, tree, probes = (s, i, j), [], []
                (probes if probe else tree).append((rep, int.from_bytes(sim, "little"), np.frombuffer(sets[n].as_buffer(), np.uint64).copy(), bands))
            if len(out) > 100_000:
                yield rows()
        close()
        yield rows()
        tree.clear()
        probes.clear()
        give_back()

    dealt = cells.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "probe", "rep")
    return dealt.mapInArrow(kernel, "a long, b long").distinct()


def _band_keys(bands: str) -> Column:
    @F.arrow_udf("array<long>")
    def keys(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b, "<i8") for b in column.to_pylist()], pa.list_(pa.int64()))

    return keys(bands)


def candidate_groups(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(rep, grp) for those nodes(rep, sim, bands) that have a candidate; grp is the smallest rep that candidates reach."""
    keyed = nodes.select("rep", "sim", F.explode(_band_keys("bands")).alias("shard"), F.lit(b"").alias("bands"), F.lit(0).cast("long").alias("weight"))
    tied = connected_components(checkpoint(cell_links(keyed, radius, shard=shard)))
    return tied.select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def verified_links(nodes: DataFrame, groups: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) within groups(rep, grp) of shingle sets with a Jaccard similarity of at least similarity: a spanning forest for each cell.

    A node's set is read from a row whose doc_id, or its first text hash if it has none, is the node's holder (without one, its rep).
    """
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    wanted = checkpoint(nodes.join(groups.join(sizes, "grp"), "rep"))
    ends = wanted.select((F.col("holder") if "holder" in nodes.columns else F.col("rep")).alias("holder"), "rep", "digest")
    ends = _small(ends)

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat an id and a text give a set once in a task
        for batch in batches:
            reps, found = [], []
            for rep, digest, text in zip(*batch.columns, strict=True):
                if (rep := rep.as_py()) not in done:
                    own = shingle_set(text.as_py(), shingle).tobytes()
                    if xxhash.xxh3_128_digest(own) == digest.as_py():
                        done.add(rep)
                        reps.append(rep)
                        found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(found, pa.binary())], names=["rep", "set"])
            del found
            give_back()

    key = row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select(_holder(*key).alias("holder"), F.col("text").cast("binary").alias("text")).join(ends, "holder")
    sets = checkpoint(texts.select("rep", "digest", "text").mapInArrow(as_set, "rep long, set binary"))
    parted = F.transform(_band_keys("bands"), lambda k: F.xxhash64(k, F.col("grp")))
    keyed = wanted.join(sets.select("rep", F.length("set").cast("long").alias("weight")), "rep")
    # texts that meet in a band need not show which
    shown = F.when(F.col("n") <= shard, F.col("bands")).otherwise(F.lit(b""))
    keyed = keyed.select("rep", "sim", shown.alias("bands"), "weight", F.explode(F.when(F.col("n") <= shard, F.array("grp")).otherwise(parted)).alias("shard"))
    return cell_links(keyed, radius, similarity, sets, shard)


def _holder(unnamed: Column, named: Column, v1: Column, v2: Column) -> Column:
    return F.when(unnamed, v1).otherwise(named)


def short_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes(rep, digest, fewer): a set of up to FEW shingles and the same without one of them, if they are that similar."""
    size = F.length("fewer") / 16
    one_off = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda k: F.substr(F.col("fewer"), 16 * k + 1, F.lit(16)))
    larger = nodes.where((size >= 2) & ((size - 1) / size >= similarity - 1e-9)).select(F.col("rep").alias("a"), F.explode(one_off).alias("digest"))
    return larger.join(nodes.select("digest", F.col("rep").alias("b")), "digest").select("a", "b")


def _components(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows; (digest, first, component) of all shingle sets, first being ROW of the first row that has the set."""
    if similarity < 0.8:
        raise ValueError("bands and radius are laid out for a similarity of 0.8 or more")
    marked = checkpoint(sketches(docs, shingle))
    same = marked.groupBy("digest", "sim", "bands", "fewer").agg(F.min(F.struct(*ROW)).alias("first"))
    holder = _holder(*[F.col(f"first.{c}") for c in ROW])
    nodes = checkpoint(same.withColumn("holder", holder).withColumn("rep", F.monotonically_increasing_id()))
    groups = checkpoint(candidate_groups(nodes))
    links = verified_links(nodes, groups, docs, shingle, similarity).unionByName(short_links(nodes, similarity))
    tied = connected_components(checkpoint(links)).withColumnRenamed("node", "rep")
    return marked, nodes.join(tied, "rep", "left").select("digest", "first", F.coalesce("component", "rep").alias("component"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of docs(doc_id, text): components of links of similarity (0.8 or more) between shingle sets.

    component_id is the smallest doc_id of the component, null if no row of it has one.
    Texts without words are equal to each other; null counts as empty. Rows that repeat a
    doc_id, or have none, give a row each by their own text. No rows, no result.
    """
    marked, sets = _components(docs, shingle, similarity)
    lowest = sets.groupBy("component").agg(F.min("first").alias("lowest"))
    named = sets.join(lowest, "component").select("digest", F.when(~F.col("lowest.unnamed"), F.col("lowest.id")).alias("component_id"))
    return marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without a doc_id last, ties by a hash of the text.

    Rows that repeat doc_id and text are one document; one of them stays, whichever it is.
    Rows that only share a doc_id are apart. All columns stay, whatever their names. No
    rows, no result.
    """
    marked, sets = _components(docs, shingle, similarity)
    winners = sets.groupBy("component").agg(F.min("first").alias("winner"))
    named = sets.join(winners, "component").select("digest", "winner")
    lost = checkpoint(marked.select("digest", *ROW).join(named, "digest").where(F.struct(*ROW) != F.col("winner")).select(*ROW).distinct())
    again = checkpoint(marked.groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").select(*ROW).join(lost, list(ROW), "left_anti"))
    rows = docs.select(whole_row(docs), *row_key(F.col("doc_id"), F.col("text"))).join(_small(lost), list(ROW), "left_anti")
    if again.limit(1).count():
        again = _small(again)
        single = rows.join(again, list(ROW), "left_semi").groupBy(*ROW).agg(F.first("row").alias("row"))
        rows = rows.join(again, list(ROW), "left_anti").select("row").unionByName(single.select("row"))
    return unpacked(rows, docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """For a broadcast if there are no more than BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
