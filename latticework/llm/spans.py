"""Substring dedup by sliding sentence spans.

A sentence is a run of characters up to and with its closing ``.``, ``!`` or ``?`` marks,
or up to the end of its line. From every sentence starts a span: the shortest run of
consecutive sentences that a ``Rule`` finds long enough. Where a span starts alone decides
where it ends, so a passage has the same spans wherever it is copied to. Spans are joined
globally by 128-bit hash; all but the first of equal ones (by doc_id, then position) go,
with every sentence they cover.

Repeats within a document are settled there, so a document counts once for a span. Counts
and smallest doc_ids are summed before the shuffle; the join back is an equi-join whose
partitions can be split.

Those spans alone leave the end of a repeated passage whose last sentences are not long
enough by themselves. ``whole`` adds the shortest span that ends at every sentence. The
two together remove what hashing every long enough run would: a repeated run's first and
last sentences are in its first span and its last, and if a sentence between is before the
last span, the span that starts there ends within the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint, give_back, whole_row


class Rule(NamedTuple):
    """A run is long enough with this many sentences and words together, or with many words in however few sentences."""

    sentences: int
    words: int
    many: float = float("inf")

    def enough(self, sentences: int, words: int) -> bool:
        return words >= self.many or (sentences >= self.sentences and words >= self.words)


#: As the SQL of op9_sentence_spans has it; a single sentence of 25 words is a run there.
SHORT_RUNS = Rule(3, 8, 25)
#: Several sentences always, and too many words for a repeated line or a common phrase.
PASSAGES = Rule(2, 25)
_PIECE = re.compile(rb"[^.!?\n]+[.!?]*|[.!?\n]+")
_STOPS = b".!?\n"


def _sentences(text: bytes) -> tuple[list[bytes], list[int], bytes, np.ndarray, np.ndarray]:
    """Pieces of the text; which of them are sentences; these in normal form, one a line; where each begins there; words before each, and in all."""
    pieces = _PIECE.findall(text)
    where, normal, sizes = [], [], []
    for k, piece in enumerate(pieces):
        words = piece.lower().split()
        if words and piece[0] not in _STOPS:
            where.append(k)
            normal.append(b" ".join(words))
            sizes.append(len(words))
    begins, upto = np.zeros(len(where) + 1, np.int64), np.zeros(len(where) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in normal], out=begins[1:])
    np.cumsum(sizes, out=upto[1:])
    return pieces, where, b"\n".join(normal), begins, upto


def _first_ends(upto: np.ndarray, rule: Rule) -> np.ndarray:
    """For each sentence the end of the shortest long enough run from it, beyond the text where there is none."""
    n = len(upto) - 1
    here = np.arange(n)
    ends = np.maximum(here + rule.sentences, np.searchsorted(upto, upto[:-1] + rule.words))
    return np.minimum(ends, np.maximum(here + 1, np.searchsorted(upto, upto[:-1] + rule.many)))


def _last_starts(upto: np.ndarray, rule: Rule) -> np.ndarray:
    """For each sentence the start of the shortest long enough run up to it, negative where there is none."""
    n = len(upto) - 1
    here = np.arange(n)
    starts = np.minimum(here + 1 - rule.sentences, np.searchsorted(upto, upto[1:] - rule.words, "right") - 1)
    return np.maximum(starts, np.minimum(here, np.searchsorted(upto, upto[1:] - rule.many, "right") - 1))


def found_runs(text: bytes, whole: bool, rule: Rule) -> tuple[list[bytes], list[int], list[tuple[int, int, bytes]]]:
    """Pieces of the text; which of them are sentences; (first, last sentence, digest) of the shortest runs from each sentence, in order; whole adds those up to each."""
    pieces, where, lines, begins, upto = _sentences(text)
    n = len(where)
    ends = _first_ends(upto, rule)
    places = [(i, end - 1) for i, end in enumerate(ends.tolist()) if end <= n]
    if whole:
        starts = _last_starts(upto, rule)
        places = sorted({*places, *((i, j) for j, i in enumerate(starts.tolist()) if i >= 0)})
    at, digest = begins.tolist(), xxhash.xxh3_128_digest
    return pieces, where, [(i, j, digest(lines[at[i] : at[j + 1] - 1])) for i, j in places]


def _document(docs: DataFrame) -> list[Column]:
    """doc_id and twin: a row without a doc_id is a document by a hash of its text, else twin is 0."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(0).alias("twin")]


def _postings(docs: DataFrame, whole: bool, rule: Rule) -> DataFrame:
    """(doc_id, twin, h1, h2): the spans of each document, each once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column(2):
                text = text.as_py()
                own = {d for *_, d in found_runs(text, whole, rule)[2]} if text else ()
                found += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            del found
            give_back()
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "twin", "h1", "h2"])

    source = docs.select(*_document(docs), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(kernel, "doc_id long, twin long, h1 long, h2 long")


def dedup_spans(docs: DataFrame, whole: bool = False, rule: Rule = SHORT_RUNS) -> DataFrame:
    """docs with covered sentences cut out of text, and two more columns, n_sentences (before) and n_removed.

    A null text stays null and has no sentences. Of equal spans the one in the smallest
    doc_id stays, in it the first. All rows of that doc_id keep it. Rows without a doc_id
    come last; those of equal texts are one document. Columns of docs with the names
    n_sentences and n_removed are replaced; others stay, whatever their names. No rows, no
    result. whole takes the spans that end at a sentence besides those that start.
    """

    @F.arrow_udf("struct<text: string, n_sentences: long, n_removed: long>")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, before, lost = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            text, drop = text.as_py(), drop.as_py()
            pieces, where, held = found_runs(text or b"", whole, rule)
            gone: set[int] = set()
            seen = set(drop or ())
            covered = 0
            for i, end, d in held:
                h1 = int.from_bytes(d[:8], "little", signed=True)
                if h1 in seen:
                    gone.update(where[max(i, covered) : end + 1])
                    covered = max(covered, end + 1)
                seen.add(h1)
            kept.append(text if not gone else b"".join(p for k, p in enumerate(pieces) if k not in gone))
            before.append(len(where))
            lost.append(len(gone))
        give_back()
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(lost, pa.int64())], names=["text", "n_sentences", "n_removed"])

    held = checkpoint(_postings(docs, whole, rule))
    least = F.min(F.when(F.col("doc_id").isNull(), F.col("twin")))
    first = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), least.alias("first_twin")).where("n > 1").drop("n")
    kept_here = F.when(F.col("first").isNull(), F.col("twin") == F.col("first_twin")).otherwise(F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)))
    again = held.join(first, ["h1", "h2"]).where(~kept_here)
    unnamed, named = F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id")
    drops = again.groupBy(unnamed, named, "twin").agg(F.collect_list("h1").alias("hashes"))  # at most the document's own spans
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    rows = docs.select(whole_row(docs), F.col("text").cast("binary").alias("text"), *_document(docs)).select("row", "text", unnamed, named, "twin")
    done = rows.join(drops, ["unnamed", "id", "twin"], "left").select("row", cut("text", "hashes").alias("done"))
    extra = [F.col(f"done.{c}").alias(c) for c in ("n_sentences", "n_removed")]
    return done.select(*[F.col("done.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], *extra)


ORACLE = r"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?\n]+') AS p FROM documents)
), words AS (
  SELECT *, array_to_string(regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS s,
    len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS n FROM pieces
), sentences AS (
  SELECT doc_id, pos, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM words WHERE n > 0 AND NOT regexp_matches(piece, '^[.!?\n]')
), ends AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 24
  WHERE b.upto - a.upto + a.n >= 25 OR (b.i - a.i >= 2 AND b.upto - a.upto + a.n >= 8) GROUP BY a.doc_id, a.i
), spans AS (
  SELECT e.doc_id, e.i, e.j, string_agg(s.s, chr(10) ORDER BY s.i) AS span
  FROM ends e JOIN sentences s ON s.doc_id = e.doc_id AND s.i BETWEEN e.i AND e.j GROUP BY e.doc_id, e.i, e.j
), again AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS k FROM spans) WHERE k > 1),
gone AS (SELECT DISTINCT s.doc_id, s.pos FROM again a JOIN sentences s ON s.doc_id = a.doc_id AND s.i BETWEEN a.i AND a.j)
SELECT d.doc_id, coalesce(string_agg(p.piece, '' ORDER BY p.pos) FILTER (gone.pos IS NULL), CASE WHEN any_value(d.text) IS NOT NULL THEN '' END) AS text,
  count(s.pos) AS n_sentences, count(gone.pos) AS n_removed
FROM documents d LEFT JOIN pieces p ON p.doc_id = d.doc_id LEFT JOIN sentences s ON s.doc_id = p.doc_id AND s.pos = p.pos LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos
GROUP BY d.doc_id
"""

_ENDS = ORACLE[ORACLE.index("ends AS (") : ORACLE.index("), spans AS (")]
#: The same with the runs of PASSAGES: the shortest from each sentence and up to each sentence.
ORACLE_PASSAGES = ORACLE.replace(
    _ENDS,
    """long_enough AS (
  SELECT a.doc_id, a.i, b.i AS j FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 24
  WHERE b.upto - a.upto + a.n >= 25
), ends AS (
  SELECT doc_id, i, min(j) AS j FROM long_enough GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM long_enough GROUP BY doc_id, j
""",
)
