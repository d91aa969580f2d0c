"""Chat formatting: logged snapshots of a conversation collapse into its longest state.

Each turn is hashed together with its position; the exclusive or of the hashes of turns 1
to k is the prefix hash of length k. Exclusive or needs no order, so prefix hashes come
from two levels of windows, over blocks of ``BLOCK`` turn numbers and over the totals of
a conversation's blocks; a conversation of any length is spread over many tasks. An
anti-join of whole conversations with all proper prefixes leaves the maximal ones.

The search moves hashes of turns, and the texts of those alone whose turn number occurs
twice in a conversation and which are ordered by their text. Texts of maximal conversations
are shuffled once, when they are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint

BLOCK = 1024
#: Turn numbers that occur twice whose list is broadcast; a longer one is joined by a shuffle.
BROADCAST_TIES = 1_000_000
_PLACE = ["conv_id", "block"]


def _turns(turns: DataFrame, block: int) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.where("conv_id IS NOT NULL").withColumn("block", F.floor(F.col("turn") / block))


def _hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, block, a, b, tie): hashes of role and text, and both themselves where the turn number occurs twice."""
    ties = checkpoint(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "turn", F.lit(True).alias("tied")))
    if ties.count() <= BROADCAST_TIES:
        ties = F.broadcast(ties)
    a, b = F.xxhash64(F.lit(1), "role", F.lit(1), "text"), F.xxhash64(F.lit(2), "text", F.lit(2), "role")
    return rows.join(ties, ["conv_id", "turn"], "left").select("conv_id", "turn", "block", a.alias("a"), b.alias("b"), F.when(F.col("tied"), F.struct("role", "text")).alias("tie"))


def _places(rows: DataFrame) -> DataFrame:
    """(conv_id, block, skip, n_turns): the turns before each block, and of the conversation."""
    counts = rows.groupBy(_PLACE).agg(F.count("*").alias("n"))
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*_PLACE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"))


def prefix_hashes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, p1, p2): a row for each turn, with the hash of all turns up to it."""
    inner = Window.partitionBy(_PLACE).orderBy("turn", "tie.role", "tie.text")
    numbered = _hashed(rows).withColumn("k", F.row_number().over(inner)).drop("tie", "turn").join(places, _PLACE).withColumn("position", F.col("skip") + F.col("k"))
    for name, mark in (("h1", 1), ("h2", 2)):
        numbered = numbered.withColumn(name, F.xxhash64(F.lit(mark), "position", "a", F.lit(mark), "b"))
    numbered = checkpoint(numbered.select(*_PLACE, "position", "n_turns", "h1", "h2"))
    totals = numbered.groupBy(_PLACE).agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*_PLACE, *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    running = Window.partitionBy(_PLACE).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    prefix = [F.col(f"s{i}").bitwiseXOR(F.bit_xor(f"h{i}").over(running)).alias(f"p{i}") for i in (1, 2)]
    return numbered.join(starts, _PLACE).select("conv_id", "position", "n_turns", *prefix)


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id): conversations that are no proper prefix of another; of equal ones the smallest id."""
    whole = prefixes.where("position = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("position < n_turns").select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id")


def render(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, position, n_turns, role, rendered) for all turns of maximal conversations(conv_id, turn, role, text).

    Concatenated by position, rendered is the conversation in chat markup. Turns are
    ordered by turn, equal ones by role and text; a null turn counts as -1, and so does its
    place. Positions count from 1, so gaps in turn do not matter. Null roles and texts count
    as empty; turns without a conv_id are left out. Repeated rows are turns of their own.
    No rows, no result.
    """
    rows = _turns(turns, block)
    places = checkpoint(_places(rows))
    kept = places.join(maximal(checkpoint(prefix_hashes(rows, places))), "conv_id", "left_semi")
    inner = Window.partitionBy(_PLACE).orderBy("turn", "role", "text")
    placed = rows.join(kept, _PLACE).withColumn("position", (F.col("skip") + F.row_number().over(inner)).cast("long"))
    text = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    return placed.select("conv_id", "position", F.col("n_turns").cast("long").alias("n_turns"), "role", text.alias("rendered"))


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS position,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS (
  SELECT *, sha256(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY position)) AS p FROM turns
), whole AS (SELECT n_turns, p, min(conv_id) AS conv_id FROM prefixes WHERE position = n_turns GROUP BY n_turns, p),
kept AS (
  SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefixes q WHERE q.position = whole.n_turns AND q.p = whole.p AND q.position < q.n_turns)
)
SELECT conv_id, position, n_turns, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept)
"""
