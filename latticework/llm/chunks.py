"""Document fingerprints by content-defined chunking.

A gear hash (32 bytes of history, one table entry a byte) marks boundaries; chunks shorter
than the mean size need a rarer mark than longer ones, which narrows the sizes. A
fingerprint is the set of chunk digests with their byte lengths. As boundaries depend on
nearby bytes alone, an insertion changes the chunks around it and no others, and the
lengths of shared digests measure how much of one text the other contains.

Finding each document's successor takes one shuffle: doc_ids are cut into ranges, and the
first document of each range is also sent to the range before it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import give_back

LEAST, MEAN, MOST = 8, 32, 192
#: A boundary's hash has this many leading zero bits, below and above the mean size.
RARE, COMMON = 6, 3
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, np.uint32)
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NO_ID = -(1 << 63)
#: Rows that a range of doc_ids has about, at most.
PART_ROWS = 100_000
#: Rows that are sent back at a time; each has two fingerprints about as long as its text.
OUT_ROWS = 500


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    common = np.flatnonzero(h < 1 << 32 - COMMON)
    rare = common[h[common] < 1 << 32 - RARE]
    common, rare = (common + 1).tolist(), (rare + 1).tolist()
    ends, at = [], 0
    while n - at > LEAST:
        i = bisect_left(rare, at + LEAST)
        end = rare[i] if i < len(rare) else n + 1
        if end > at + MEAN:
            i = bisect_left(common, at + MEAN)
            end = min(common[i] if i < len(common) else n, at + MOST, n)
        at = min(end, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> dict[str, int]:
    """Byte length by chunk digest."""
    digest, out, at = xxhash.xxh3_64_hexdigest, {}, 0
    for end in boundaries(data):
        out[digest(data[at:end])[:10]] = end - at
        at = end
    return out


def to_text(chunks: dict[str, int]) -> str:
    return " ".join(sorted([f"{d}.{n}" for d, n in chunks.items()]))


def from_text(text: str) -> dict[str, int]:
    return {d: int(n) for d, _, n in (x.partition(".") for x in text.split())}


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length that is in chunks of b; 1 if a is empty."""
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else 1.0


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """The smaller of the two containments; 1 for two empty texts, 0 if one is empty."""
    return min(containment(a, b), containment(b, a))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs(doc_id, text); a null text counts as empty, with an empty fingerprint."""

    @F.arrow_udf("string")
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(fingerprint(t or b"")) for t in texts.to_pylist()], pa.string())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text").cast("binary")).alias("fingerprint"))


def with_successor(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, text), sorted within partitions, so that a row's successor in its part follows it.

    Rows with ahead belong to the next part (after the last, to the first) and only show
    what comes after this one. Equal doc_ids are ordered by text, null ids come first.
    """
    spark = docs.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    ids = docs.select(order.alias("id"))
    shares = [k / parts for k in range(1, parts)]
    found = ids.agg(F.percentile_approx("id", shares, 10 * parts)).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def part_of(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, x.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    heads = [tuple(r) for r in ids.groupBy(part_of("id").alias("part")).agg(F.min("id")).collect()]  # a row for each part
    heads.sort()
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.arrow_udf("array<struct<part: int, ahead: boolean>>")
    def places(x: pa.Array) -> pa.Array:
        values = x.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, values, side="left").tolist()
        rows = [[{"part": p, "ahead": False}] + ([{"part": before[v], "ahead": True}] if v in before else []) for p, v in zip(own, values.tolist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("part", pa.int32()), ("ahead", pa.bool_())])))

    rows = docs.select(order.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.explode(places("id"))).select("place.part", "place.ahead", "id", "doc_id", "text")
    return rows.repartition(max(1, parts // 4), "part").sortWithinPartitions("part", "ahead", "id", "text").select("part", "ahead", "doc_id", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """EDITED: each text's fingerprint against that of an edited copy and that of the next document.

    The edit replaces the last quarter of a text's code points (rounded down) by as many
    from the start of the next document, or all that it has. A null text counts as empty;
    a single document is its own successor. No rows, no result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in EDITED.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                part, ahead, doc_id, text = (x.as_py() for x in row)
                if held is not None and held[0] != part:
                    held = None
                if ahead and held is None:
                    continue
                chunks = fingerprint(text.encode())
                if held is not None:
                    out.append(_edit(*held[1:], text, chunks))
                held = None if ahead else (part, doc_id, text, chunks)
                if len(out) == OUT_ROWS:
                    yield rows()
            give_back()
        if out:
            yield rows()

    return with_successor(docs).mapInArrow(kernel, EDITED)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _edit(doc_id: int | None, text: str, chunks: dict[str, int], following: str, after: dict[str, int]) -> tuple:
    tail = len(text) // 4
    edited = (text[: len(text) - tail] + following[:tail]).encode()
    marks = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), to_text(chunks), to_text(marks), likeness(chunks, marks), likeness(chunks, after)
