"""SimHash near-duplicates, linked through sharded BK-trees.

Fingerprints are cut into four blocks of 16 bits. Two fingerprints that differ in at
most two bits agree in two blocks at least, so each fingerprint goes to six shards, one
for each pair of blocks, and every link is found in one of them. A shard's fingerprints
form a BK-tree (children keyed by the integer Hamming distance to their parent), and a
probe follows only the edges within the radius. A shard of more than ``SHARD`` texts is
dealt into cells of two chunks each; no task holds more than two chunks. Trees travel
with the shuffle, as a broadcast of them would grow with the corpus.

Only links of a spanning forest leave a cell, so a group of n fingerprints gives fewer
than n rows there, while connected components stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint
from latticework.llm.components import connected_components

SEED = 42
RADIUS = 2
SHARD = 2048
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_EACH_BYTE = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, how many of the hashes set it."""
    if len(h) < 2000:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    rows = -(-len(h) // 255)
    h = np.concatenate([h, np.zeros(rows * 255 - len(h), np.uint64)]).reshape(rows, 255)
    out = np.zeros(64, np.int64)
    for k in range(8):  # eight counters of one byte in each word; 255 additions fit
        sums = ((h >> np.uint64(k)) & _EACH_BYTE).sum(axis=1, dtype=np.uint64)
        out[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; no words: 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    h = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    bits = bit_counts(h) * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. A null text counts as empty."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, fp long")


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        """Position of x, which is added if it is not there."""
        if not self.items:
            self.items.append(x)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (x ^ self.items[at]).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.items)
                self.items.append(x)
                self.children.append({})
                return len(self.items) - 1
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of all items at distance radius or less; only edges d - radius to d + radius are followed."""
        items, children, found = self.items, self.children, []
        stack = [0] if items else []
        while stack:
            at = stack.pop()
            d = (x ^ items[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                low, high = d - radius, d + radius
                stack += [c for edge, c in below.items() if low <= edge <= high]
        return found


def cell_links(tree_of: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links between values at distance 1 to radius: within tree_of if probes is empty, else from probes to it."""
    if not probes and len(tree_of) == 2:
        a, b = tree_of
        return [(a, b)] if 0 < (a ^ b).bit_count() <= radius else []
    tree, root = BKTree(), {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []

    def tie(x: int) -> None:
        for at in tree.within(x, radius):
            a, b = top(tree.items[at]), top(x)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((x, tree.items[at]))

    for x in tree_of:
        if not probes:
            tie(x)
        tree.add(x)
    for x in probes:
        tie(x)
    return links


def link(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between distinct values of column fp at Hamming distance 1 to radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree up to radius 2 only")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keys = F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(_PAIRS)])
    keyed = prints.select("fp").distinct().select("fp", F.explode(keys).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("fp"), "chunks")
    cells = (
        keyed.join(sizes.select("shard", F.ceil(F.col("n") / shard).alias("chunks")), "shard")
        .withColumn("own", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("probe"), "fp")
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        out: list[tuple[int, int]] = []
        key, tree, probes = None, [], []

        def close() -> None:
            if tree and (probes or (key[1] == key[2] and len(tree) > 1)):
                out.extend(cell_links(tree, probes, radius))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(5)]
            for s, i, j, probe, fp in zip(*cols, strict=True):
                if (s, i, j) != key:
                    close()
                    key, tree, probes = (s, i, j), [], []
                (probes if probe else tree).append(fp & mask)
            if out:
                yield _pairs(out)
                out.clear()
        close()
        if out:
            yield _pairs(out)

    dealt = cells.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "probe", "fp")
    return dealt.mapInArrow(kernel, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Fingerprints that differ in radius bits or fewer are linked; component_id is the
    smallest doc_id that links reach. Texts without words have fingerprint zero and are
    linked like any other. Rows that repeat a doc_id give a row each; a null doc_id gives
    a row, and is a component's id only if the component has no other. No rows, no result.
    """
    marked = checkpoint(fingerprints(docs, shingle))
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    tied = connected_components(checkpoint(link(marked, radius)))
    named = reps.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
