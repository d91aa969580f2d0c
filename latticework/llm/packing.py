"""Order-preserving packing of documents into token sequences by dynamic programming.

Each partition of the input, in doc_id order, is one stream of tokens. Windows are cut at
document ends, at sentence ends (with a penalty), or, where neither comes within a window,
inside a sentence (with a larger one). With cut positions p, the least cost is

    f(j) = min over i, p(j) - p(i) <= 2048, of f(i) + pad(p(j) - p(i)) + penalty(j) + WINDOW_COST

where pad(n) is 2048 - n, but 0 where n is a power of two. As 2048 - n splits into a term of
i and a term of j, a monotone queue gives the first kind of transition in constant time;
powers of two are looked up by position. No row is shuffled: a partition is packed where it
is read, and at most one window of it is short.

Tokens are held back until all cuts that a later window could start from share an earlier
one; what lies before that is settled, and cutting a stream piece by piece costs no more than
cutting it at once.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import give_back

SEQUENCE = 2048
END_ID = 1
SENTENCE_CUT = 6
INNER_CUT = 256
WINDOW_COST = 16
#: Shortest window that is left unpadded for being a power of two; shorter ones would only break documents up.
LEAST_POWER = 256
#: Tokens that are held before settled windows are looked for.
BLOCK = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters on whose class all regular expression libraries agree; other texts take the slower path.
_COMMON = re.compile("[^\t-\r -~¡-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞]")
#: Pieces of text that byte pairs are merged within, as the vocabulary's ByteLevel pre-tokenizer has them.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Token ids of a byte-level vocabulary file. With special, strings of special tokens get their ids, else they are ordinary text."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, special: bool = False) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        added = {x["id"]: x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if k not in added}
        self.special = re.compile("|".join(map(re.escape, added.values()))) if special and added else None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sentence_end = np.zeros(max([0, *spec["model"]["vocab"].values(), *added]) + 2, bool)
        for token, k in ranks.items():
            self.sentence_end[k] = b"\n" in token or token.rstrip(b"\"')]").endswith((b".", b"!", b"?"))

    @classmethod
    def of(cls, path: str, special: bool = False) -> Encoder:
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def ids(self, text: str) -> list[int]:
        if _COMMON.search(text) or (self.special and self.special.search(text)):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _came_from(p: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """For each cut the one before it on the cheapest way there; gaps of p are size at most."""
    n = len(p)
    at = np.full(int(p[-1]) + 1, -1, np.int64)
    at[p] = np.arange(n)
    to, back = [], []
    power = min(LEAST_POWER, size)
    while power <= size:
        j = np.searchsorted(p, power)
        i = at[p[j:] - power]
        found = np.flatnonzero(i >= 0)
        to.append(found + j)
        back.append(i[found])
        power *= 2
    to, back = np.concatenate(to), np.concatenate(back)
    order = np.argsort(to, kind="stable")
    to, back = [*to[order].tolist(), n], back[order].tolist()
    where, cost = p.tolist(), (penalty + WINDOW_COST).tolist()
    f, came = [0] * n, [0] * n
    queue, keys, head, nxt = [0], [0], 0, 0
    for j in range(1, n):
        x = where[j]
        low = x - size
        while where[queue[head]] < low:
            head += 1
        best, of = keys[head] + size - x, queue[head]
        while to[nxt] == j:
            i = back[nxt]
            nxt += 1
            if f[i] < best:
                best, of = f[i], i
        best += cost[j]
        f[j], came[j] = best, of
        key = best + x
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    return came


def _way_to(came: list[int], j: int) -> list[int]:
    path = []
    while j:
        path.append(j)
        j = came[j]
    return [0, *reversed(path)]


def cuts(p: np.ndarray, penalty: np.ndarray, size: int = SEQUENCE) -> list[int]:
    """Indexes into p of the cheapest cuts, from 0 to the last; gaps of p are size at most."""
    return _way_to(_came_from(p, penalty, size), len(p) - 1) if len(p) > 1 else []


def settled_cuts(p: np.ndarray, penalty: np.ndarray, size: int = SEQUENCE) -> list[int]:
    """The cuts that stay the cheapest whatever follows: up to the last one that all places a later window may start from have in common."""
    came = _came_from(p, penalty, size)
    live = np.flatnonzero(p > p[-1] - size).tolist()
    heap, known = [-j for j in live], set(live)
    heapq.heapify(heap)
    while len(heap) > 1:
        j = came[-heapq.heappop(heap)]
        if j not in known:
            known.add(j)
            heapq.heappush(heap, -j)
    return _way_to(came, -heap[0])


class _Stream:
    """Documents of one partition on their way into windows."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.sequence = size, first
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, first position, start within the document, its tokens
        self.ids: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.price: list[np.ndarray] = []
        self.held, self.goal = 0, BLOCK

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(ids)
        at = np.append(ends[ends < n], n)
        price = np.full(len(at), SENTENCE_CUT, np.int64)
        price[-1] = 0
        gaps = np.diff(at, prepend=0)
        if gaps.max() > self.size:  # no end for a whole window: allow cuts on the way
            more = np.concatenate([np.arange(a - g + self.size, a, self.size) for a, g in zip(at[gaps > self.size], gaps[gaps > self.size], strict=True)])
            at, price = np.append(at, more), np.append(price, np.full(len(more), INNER_CUT))
            order = np.argsort(at)
            at, price = at[order], price[order]
        self.docs.append((doc_id, self.held, 0, n))
        self.ids.append(ids)
        self.cut.append(at + self.held)
        self.price.append(price)
        self.held += n

    def windows(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows that are settled; at the end, of all windows."""
        p, price = np.concatenate([[0], *self.cut]), np.concatenate([[0], *self.price])
        path = (cuts if last else settled_cuts)(p, price, self.size)
        if len(path) < 2:
            self.goal = 2 * self.held
            return
        ids = np.concatenate(self.ids)
        bounds = p[path].tolist()
        d = 0
        for a, b in zip(bounds, bounds[1:]):
            x = a
            while x < b:
                doc_id, first, start, whole = self.docs[d]
                end = min(b, first + whole - start)
                yield doc_id, start + x - first, end - x, zlib.crc32(ids[x:end].tobytes()), whole, self.sequence, x - a
                x = end
                if x == first + whole - start:
                    d += 1
            self.sequence += 1
        done, k = bounds[-1], path[-1]
        rest = []
        for doc_id, first, start, whole in self.docs[d:]:
            skip = max(0, done - first)
            rest.append((doc_id, max(0, first - done), start + skip, whole))
        self.docs, self.ids, self.held = rest, [ids[done:]], len(ids) - done
        self.goal = self.held + BLOCK
        self.cut, self.price = [p[k + 1 :] - done], [price[k + 1 :]]


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, special: bool = False) -> DataFrame:
    """A row for each piece of a document of docs(doc_id, text), as in PIECES.

    special gives the strings of special tokens in a text their ids, as the tokenizer's plain
    call does; otherwise they are ordinary text. Order holds within a partition, and each
    partition may end with a short window, so small files are better merged before. A null or empty text is the end id alone. Texts of any length are cut into as many
    pieces as they need; rows that repeat a doc_id are packed as documents of their own.
    sequence_id has the partition in its upper bits. No rows, no result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, special)
        stream = _Stream(size, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encoder.ids(text) if text else []
                ids.append(END_ID)
                ids = np.array(ids, "<u4")
                stream.add(doc_id, ids, np.flatnonzero(encoder.sentence_end[ids[:-1]]) + 1)
                if stream.held > stream.goal:
                    yield _rows(stream.windows(last=False))
            give_back()
        if stream.held:
            yield _rows(stream.windows(last=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).sortWithinPartitions("doc_id", "text").mapInArrow(kernel, PIECES)


def _rows(pieces: Iterator[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = list(zip(*pieces, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def default_tokenizer() -> str:
    """Place of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
