"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of five-word shingles into classes of
(L/2, L]. For each class a document is covered by blocks of 2L shingles, L apart, so that
any stretch of L shingles lies within one block; there a block that holds 0.8 of an item's
shingles has a Jaccard similarity of at least 0.4 L / (2 L + 0.1 L), however long the
document is. A class's index has as many bands of one MinHash value as miss such a block with a chance below
``MISS``. Items found in a block are verified by exact containment of their shingles, as
strings, in the whole document.

A block is hashed only if one of its shingles is in the class's index: bands of one value
can only meet where an item's own least shingle occurs. The benchmark goes to the
executors in chunks whose text and index have at most ``CHUNK_BYTES``, each against all
documents; a chunk is let go before the next one is read. An index has flat arrays and the
items' words, whose shingles are only cut out when a document has a candidate.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint, give_back, unpacked, whole_row

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-9
#: Bytes of text and index in a chunk of the benchmark, but for a single item that is larger.
CHUNK_BYTES = 128 << 20
FOUND = "doc_id long, item_id long, matched long, shingles long, containment double"
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BITS = 20
_PART = 1 << 14


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^k and P^-k modulo 2^64 for k below n."""
    with np.errstate(over="ignore"):
        up = np.full(n, _P, np.uint64)
        down = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLE = [*_powers(1 << 12)]


def shingle_hashes(line: bytes) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words of a line whose words are parted by one blank each."""
    raw = np.frombuffer(line, np.uint8)
    n = len(raw)
    if n >= len(_TABLE[0]):
        _TABLE[:] = _powers(1 << (n + 1).bit_length())
    gaps = np.flatnonzero(raw == 32)
    if len(gaps) < SHINGLE - 1:
        return np.zeros(0, np.uint64)
    up, down = _TABLE
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(raw * up[:n], out=sums[1:])
    starts = np.concatenate([[0], gaps + 1])[: len(gaps) - SHINGLE + 2]
    ends = np.append(gaps, n)[SHINGLE - 1 :]
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def normal(text: bytes | None) -> bytes:
    """The text's words (parted by ASCII white space, A-Z lower-cased), parted by one blank each."""
    return b" ".join((text or b"").lower().split())


def shingles(line: bytes) -> set[bytes]:
    words = line.split()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def bands(length: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Single-value bands that find a block of 2 length shingles with threshold of length / 2 shingles or more."""
    least = max(1, length // 2 + 1)
    jaccard = threshold * least / (2 * length + (1 - threshold) * least)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def size_class(shingles: int) -> int:
    """The L of the class (L/2, L] of an item of so many shingles."""
    return 1 << max(0, shingles - 1).bit_length()


def index_bytes(text: bytes | None, threshold: float = THRESHOLD) -> int:
    """About what an item takes in an index: its words, a band's key and owner for each band, its least shingles."""
    n = max(0, len((text or b"").split()) - SHINGLE + 1)
    if not n:
        return 64
    made = bands(size_class(n), threshold)
    return 256 + 2 * len(text or b"") + 12 * made + 8 * min(n, made)


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def least_hashes(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Under each of n permutations, the least value of the hashes and which of them has it; long sets in parts."""
    a, b = (x[:, None] for x in _permutations(n))
    values, at = np.full(n, _MASK, np.uint64), np.zeros(n, np.int64)
    for k in range(0, len(h), _PART):
        x = h[None, k : k + _PART] * a + b
        x ^= x >> np.uint64(31)
        own = x.argmin(axis=1)
        found = np.take_along_axis(x, own[:, None], 1)[:, 0]
        less = found < values
        values[less], at[less] = found[less], own[less] + k
    return values, at


class _Class:
    """Bands of one size class: sorted keys, the item of each, and the hashes of items' least shingles."""

    def __init__(self, keys: list[np.ndarray], owners: list[int], least: list[np.ndarray], n_bands: int) -> None:
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.owners = np.repeat(np.array(owners, np.int32), n_bands)[order]
        self.least = np.unique(np.concatenate(least))

    def items(self, keys: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        return np.concatenate([self.owners[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b] or [self.owners[:0]])


def _band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band and its MinHash value. Keys that meet by chance only add candidates."""
    return (least ^ (np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Items by size class; in each class, item numbers by band and MinHash value."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.items: list[tuple[int | None, bytes]] = []
        parts: dict[int, tuple[list, list, list]] = {}
        for item_id, text in items:
            line = normal(text)
            h = np.unique(shingle_hashes(line))
            if not len(h):
                continue
            length = size_class(len(h))
            keys, owners, least = parts.setdefault(length, ([], [], []))
            values, at = least_hashes(h, bands(length, threshold))
            keys.append(_band_keys(values))
            owners.append(len(self.items))
            least.append(h[np.unique(at)])
            self.items.append((item_id, line))
        self.classes: dict[int, _Class] = {}
        self.any = np.zeros(1 << _BITS, bool)
        for length in sorted(parts):
            made = self.classes[length] = _Class(*parts.pop(length), bands(length, threshold))
            self.any[made.least >> np.uint64(64 - _BITS)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a band with a block of a document whose shingle hashes are h, in order."""
        found: set[int] = set()
        near = np.flatnonzero(self.any[h >> np.uint64(64 - _BITS)])
        if not len(near):
            return found
        for length, table in self.classes.items():
            at = np.minimum(np.searchsorted(table.least, h[near]), len(table.least) - 1)
            hits = near[table.least[at] == h[near]]
            if not len(hits):
                continue
            blocks = np.unique(np.concatenate([hits // length, np.maximum(hits // length - 1, 0)]))
            n = bands(length, self.threshold)
            for block in blocks.tolist():
                found.update(table.items(_band_keys(least_hashes(h[block * length : (block + 2) * length], n)[0])).tolist())
        return found

    def search(self, text: bytes | None) -> list[tuple[int | None, int, int]]:
        """(item id, shingles matched, its shingles) of the items that the text contains."""
        line = normal(text)
        h = shingle_hashes(line)
        found = self.candidates(h) if len(h) else ()
        if not found:
            return []
        own = shingles(line)
        out = []
        for k in sorted(found):
            item_id, item = self.items[k]
            wanted = shingles(item)
            matched = len(wanted & own)
            if matched >= self.threshold * len(wanted) - 1e-9:
                out.append((item_id, matched, len(wanted)))
        return out


_MADE: dict[tuple[str, float], Index] = {}


def _index(sent: Broadcast, threshold: float) -> Index:
    """This worker's index of a chunk; only the last one is kept."""
    stamp, items = sent.value
    if (stamp, threshold) not in _MADE:
        _MADE.clear()
        _MADE[stamp, threshold] = Index(items, threshold)
    return _MADE[stamp, threshold]


def _chunks(benchmark: DataFrame, limit: int, threshold: float) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The benchmark's rows, as many at a time as limit allows; the driver holds one chunk and the partition it reads."""
    rows, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator():
        text = None if text is None else bytes(text)
        more = index_bytes(text, threshold)
        if rows and size + more > limit:
            yield rows
            rows, size = [], 0
        rows.append((item_id, text))
        size += more
    if rows:
        yield rows


def _with_chunks(docs: DataFrame, benchmark: DataFrame, threshold: float, chunk_bytes: int, single: Callable[[Broadcast], DataFrame], each: Callable[[Broadcast], DataFrame]) -> DataFrame | list[DataFrame]:
    """single of the only chunk; or each of several, computed and let go before the next but one is read; or no list at all."""
    context = docs.sparkSession.sparkContext
    chunks = _chunks(benchmark, chunk_bytes, threshold)
    head = [items for _, items in zip(range(2), chunks)]
    send = lambda items: context.broadcast((uuid.uuid4().hex, items))  # noqa: E731  # chunk_bytes or one item
    if len(head) == 1:
        return single(send(head[0]))
    done = []
    while head:
        sent = send(head.pop(0))
        done.append(checkpoint(each(sent)))
        sent.destroy()
        head += [items for _, items in zip(range(1 - len(head)), chunks)]
    return done


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """FOUND: a row for each document and benchmark item with threshold or more of the item's distinct shingles in it.

    Words are parted by ASCII white space; A-Z are lower-cased. Null or empty texts, and
    items or documents of fewer than five words, match nothing. Repeated rows of either
    table give repeated results. No rows in either, no result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def against(sent: Broadcast) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(sent, threshold)
            for batch in batches:
                texts = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                out = [(doc_id, *row) for doc_id, text in texts for row in index.search(text.as_py())]
                if out:
                    doc_ids, item_ids, matched, whole = (list(c) for c in zip(*out, strict=True))
                    shares = [m / n for m, n in zip(matched, whole, strict=True)]
                    cols = [pa.array(c, pa.int64()) for c in (doc_ids, item_ids, matched, whole)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(shares, pa.float64())], names=[x.split()[0] for x in FOUND.split(", ")])

        return source.mapInArrow(kernel, FOUND)

    parts = _with_chunks(docs, benchmark, threshold, chunk_bytes, against, against)
    if isinstance(parts, list):
        return reduce(DataFrame.unionAll, parts, docs.sparkSession.createDataFrame([], FOUND))
    return parts


def _contains(sent: Broadcast, threshold: float) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        index = _index(sent, threshold)
        found = pa.array([bool(index.search(t.as_py())) for t in texts], pa.bool_())
        give_back()
        return found

    return lambda text: hit(text.cast("binary"))


def _digest(text: Column) -> list[Column]:
    """128 bits of a text; null counts as empty."""
    return [F.xxhash64(F.lit(k), F.coalesce(text.cast("string"), F.lit(""))).alias(f"t{k}") for k in (1, 2)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without the rows whose text contains a benchmark item.

    Each row goes by its own text, whether its doc_id is repeated or null. Null, empty and
    very short texts stay; all columns stay, whatever their names. With one chunk of
    benchmark, rows are judged where they are read; with several, the digests of texts
    that a chunk convicts are collected in a table and joined. No rows, no result.
    """
    text = F.col("text")

    def clean(sent: Broadcast) -> DataFrame:
        return docs.where(~_contains(sent, threshold)(text))

    def guilty(sent: Broadcast) -> DataFrame:
        return docs.where(_contains(sent, threshold)(text)).select(*_digest(text)).distinct()

    convicted = _with_chunks(docs, benchmark, threshold, chunk_bytes, clean, guilty)
    if not isinstance(convicted, list):
        return convicted
    if not convicted:
        return docs
    rows = docs.select(whole_row(docs), *_digest(text))
    kept = rows.join(reduce(DataFrame.unionAll, convicted).distinct(), ["t1", "t2"], "left_anti")
    return unpacked(kept, docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS matched, any_value(n) AS shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM shingles d JOIN shingles b ON d.s = b.s JOIN sizes ON sizes.id = b.id
WHERE d.kind = 0 AND b.kind = 1 GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""
