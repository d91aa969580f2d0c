"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

``LineIndex`` holds three tables. ``postings`` says which document holds which line key,
``refs`` counts the documents of each key and names the largest, and ``filters`` has one
cuckoo filter for each shard of those keys that enough documents hold. ``insert`` reads the
texts of new documents only and ``delete`` no texts; both recount the keys they touch, change
the filters of shards whose keys moved, and write the tables anew. ``apply`` asks the filters
first and settles every hit by the exact counts. Filters are broadcast while they are small;
beyond that postings go to the filter of their shard, a shard of very many postings in parts.

A row without a doc_id is a document of its own text that is smaller than any other.

Keys are 128-bit XXH3 digests. Counting is grouped twice, by (key, document) and by key,
with partial sums before each shuffle, so a line that a third of all documents hold
reaches its reducer as one row from each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import WS, checkpoint, give_back, whole_row
from latticework.llm.cuckoo import CuckooFilter, as_rows

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys that a filter's shard is sized for.
SHARD_KEYS = 50_000
#: All filters together are broadcast up to this size; beyond it postings are dealt by shard to meet them.
BROADCAST_BYTES = 32 << 20
#: Postings of a shard that meet one copy of its filter, when they are dealt.
PART_POSTINGS = 4_000_000
_CONTINUED = re.compile(rb"[\x80-\xbf]")


class LineIndex(NamedTuple):
    postings: DataFrame  # doc_id, twin, key; distinct; twin is a hash of the text if there is no doc_id, else 0
    refs: DataFrame  # key, n_docs, last_doc, last_twin
    filters: DataFrame  # shard, shards, filter
    min_docs: int
    shard_keys: int = SHARD_KEYS


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of the line without outer white space, A-Z lower-cased; None if it is shorter than min_chars code points."""
    line = line.strip(WS)
    if len(line) < min_chars or (not line.isascii() and len(line) - len(_CONTINUED.findall(line)) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, twin, key), each once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            counts = []
            for text in batch.column(2):
                text = text.as_py()
                own = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                counts.append(len(own))
                keys += own
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], names=["doc_id", "twin", "key"])
            give_back()

    return docs.select(*_document(docs), F.col("text").cast("binary").alias("text")).mapInArrow(kernel, "doc_id long, twin long, key binary").distinct()


def _document(docs: DataFrame) -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(0).alias("twin")]


def _count(pairs: DataFrame) -> DataFrame:
    twin = F.max(F.when(F.col("doc_id").isNull(), F.col("twin")))
    return pairs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"), twin.alias("last_twin"))


def _shard(shards: Column) -> Column:
    return F.pmod(F.xxhash64("key"), shards)


def _filters(hot: DataFrame, shard_keys: int) -> DataFrame:
    shards = max(1, -(-hot.count() // shard_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys, room = as_rows(rows["key"].tolist()), max(len(rows), 1)
        while not (made := CuckooFilter(room)).insert(keys):
            room *= 2
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "shards": [shards], "filter": [made.to_bytes()]})

    return hot.select(_shard(F.lit(shards)).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard long, shards long, filter binary")


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Index of docs(doc_id, text); null texts have one empty line. No rows give empty tables."""
    pairs = checkpoint(postings(docs, min_chars))
    refs = checkpoint(_count(pairs))
    return LineIndex(pairs, refs, checkpoint(_filters(refs.where(F.col("n_docs") >= min_docs), shard_keys)), min_docs, shard_keys)


def _renew(index: LineIndex, pairs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over pairs, where only the keys of touched have other counts than before."""
    changed = checkpoint(touched.join(_count(pairs.join(touched, "key", "left_semi")), "key", "left"))
    refs = checkpoint(index.refs.join(touched, "key", "left_anti").unionByName(changed.where("n_docs is not null")))
    enough = F.coalesce("n_docs", F.lit(0)) >= index.min_docs
    was = index.refs.select("key", (F.col("n_docs") >= index.min_docs).alias("was"))
    moves = changed.select("key", enough.alias("now")).join(was, "key", "left").select("key", "now", F.coalesce("was", F.lit(False)).alias("was")).where("now <> was")
    first = index.filters.first()
    if first is None:
        return LineIndex(pairs, refs, checkpoint(_filters(refs.where(F.col("n_docs") >= index.min_docs), index.shard_keys)), index.min_docs, index.shard_keys)
    shards = first["shards"]
    moves = moves.withColumn("shard", _shard(F.lit(shards)))

    def update(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(filters):
            made = CuckooFilter.from_bytes(filters["filter"].iloc[0])
        else:
            made = CuckooFilter(len(rows))
        made.delete(as_rows(rows["key"][~rows["now"]].tolist()))
        fits = made.insert(as_rows(rows["key"][rows["now"]].tolist()))
        shard = (filters if len(filters) else rows)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "shards": [shards], "filter": [made.to_bytes() if fits else None]})

    filters = checkpoint(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard long, shards long, filter binary"))
    if filters.where("filter is null").limit(1).count():  # a shard is full: build anew from the exact counts
        filters = checkpoint(_filters(refs.where(F.col("n_docs") >= index.min_docs), index.shard_keys))
    return LineIndex(pairs, refs, filters, index.min_docs, index.shard_keys)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """Add documents; pairs that the index has already change nothing."""
    new = checkpoint(_missing(postings(docs, min_chars), index.postings))
    return _renew(index, checkpoint(index.postings.unionByName(new)), new.select("key").distinct())


def _missing(pairs: DataFrame, known: DataFrame) -> DataFrame:
    same = [pairs["doc_id"].eqNullSafe(known["doc_id"]), pairs["twin"] == known["twin"], pairs["key"] == known["key"]]
    return pairs.join(known, same, "left_anti")


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take the documents of doc_ids(doc_id) out again."""
    ids = doc_ids.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("_id"))
    touched = checkpoint(index.postings.join(ids, gone, "left_semi").select("key").distinct())
    return _renew(index, checkpoint(index.postings.join(ids, gone, "left_anti")), touched)


def _maybe(index: LineIndex) -> DataFrame:
    """Postings without those that the filters rule out."""
    size = index.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _dealt(index)
    rows = index.filters.collect()  # at most BROADCAST_BYTES
    shards = rows[0]["shards"] if rows else 1
    tables = index.postings.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in rows})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: CuckooFilter.from_bytes(v) for k, v in tables.value.items()}
        for batch in batches:
            shard = batch.column(3).to_numpy(zero_copy_only=False)
            keys = as_rows(batch.column(2).to_pylist())
            hit = np.zeros(len(shard), bool)
            for k, f in made.items():
                own = shard == k
                if own.any():
                    hit[own] = f.contains(keys[own])
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["doc_id", "twin", "key"]).filter(pa.array(hit))

    return index.postings.withColumn("shard", _shard(F.lit(shards))).mapInArrow(kernel, "doc_id long, twin long, key binary")


def _dealt(index: LineIndex, part_postings: int = PART_POSTINGS) -> DataFrame:
    """As _maybe, postings and filters meeting by shard; a shard of more than part_postings goes in parts, each with a copy of the filter."""
    first = index.filters.first()
    if first is None:
        return index.postings.limit(0)
    held = index.postings.withColumn("shard", _shard(F.lit(first["shards"])))
    many = held.groupBy("shard").count().where(F.col("count") > part_postings)
    parts = F.broadcast(many.select("shard", F.ceil(F.col("count") / part_postings).alias("parts")))  # a row for every part_postings rows at most
    own = F.pmod(F.xxhash64("doc_id", "twin", "key"), F.coalesce("parts", F.lit(1)))
    dealt = held.join(parts, "shard", "left").select("shard", own.alias("part"), F.lit(1).alias("kind"), "doc_id", "twin", "key", F.lit(None).cast("binary").alias("filter"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    none = F.lit(None)
    sent = index.filters.join(parts, "shard", "left").select("shard", copies, F.lit(0).alias("kind"), none.cast("long").alias("doc_id"), none.cast("long").alias("twin"), none.cast("binary").alias("key"), "filter")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
            heads = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) == 0)
            filters = [batch.column(6)[int(k)].as_py() for k in heads]
            hit = np.zeros(len(place), bool)
            for a, b, f in zip([0, *heads + 1], [*heads, len(place)], [None, *filters], strict=True):
                if f is not None:
                    at, made = tuple(place[a - 1]), CuckooFilter.from_bytes(f)
                own = a + np.flatnonzero((place[a:b] == at).all(axis=1)) if at is not None else ()
                if len(own):
                    hit[own] = made.contains(as_rows(batch.column(5).take(pa.array(own)).to_pylist()))
            yield pa.RecordBatch.from_arrays(batch.columns[3:6], names=["doc_id", "twin", "key"]).filter(pa.array(hit))

    both = dealt.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    return both.mapInArrow(kernel, "doc_id long, twin long, key binary")


def to_drop(index: LineIndex) -> DataFrame:
    """(doc_id, twin, keys): the keys whose lines each document loses. Bounded by the document's own lines."""
    hot = index.refs.where(F.col("n_docs") >= index.min_docs).select("key", "last_doc", "last_twin")
    last = F.when(F.col("last_doc").isNull(), F.col("twin") == F.col("last_twin")).otherwise(F.coalesce(F.col("doc_id") == F.col("last_doc"), F.lit(False)))
    return _maybe(index).join(hot, "key").where(~last).groupBy("doc_id", "twin").agg(F.collect_list("key").alias("keys"))


def apply(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines dropped from text, and two more columns, n_lines (before) and n_dropped.

    A null text counts as one empty line. All rows of the largest doc_id keep their lines.
    Columns of docs with the names n_lines and n_dropped are replaced; others stay, whatever
    their names. No rows, no result.
    """

    @F.arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def strip(texts: pa.Array, keys: pa.Array) -> pa.Array:
        kept, before, lost = [], [], []
        for text, drop in zip(texts, keys, strict=True):
            lines, drop = (text.as_py() or b"").split(b"\n"), drop.as_py()
            stay = lines
            if drop:
                drop = set(drop)
                stay = [x for x in lines if line_key(x, min_chars) not in drop]
            kept.append(b"\n".join(stay))
            before.append(len(lines))
            lost.append(len(lines) - len(stay))
        give_back()
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(lost, pa.int64())], names=["text", "n_lines", "n_dropped"])

    unnamed, named = F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id")
    drops = to_drop(index).select(unnamed, named, "twin", "keys")
    rows = docs.select(whole_row(docs), F.col("text").cast("binary").alias("text"), *_document(docs)).select("row", "text", unnamed, named, "twin")
    done = rows.join(drops, ["unnamed", "id", "twin"], "left").select("row", strip("text", "keys").alias("done"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = [F.col("done.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    return done.select(*kept, *[F.col(f"done.{c}").alias(c) for c in ("n_lines", "n_dropped")])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """apply(build_index(docs), docs)."""
    return apply(build_index(docs, min_docs, min_chars), docs, min_chars)
