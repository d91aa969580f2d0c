"""The corpus operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import chat, chunks, decontaminate, lang_id, line_dedup, packing, pii, quality, simhash, spans
from latticework.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def _of_kind(spans: str, kind: int) -> Column:
    """The number of spans of a kind. A lambda with a second argument, even one with a default, would get the element's place there."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.to_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.to_text(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or packing.default_tokenizer(), special=True)


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_likeness(table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated run of two sentences and 25 words or more; op9_sentence_spans follows the rule of its SQL."""
    return spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True, rule=spans.PASSAGES)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.label_documents(table(spark, sf_dir, "documents"))


_OP6 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, hot.key IS NOT NULL AND keyed.doc_id <> hot.last_doc AS dropped FROM keyed LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_simhash_bk, op3_quality_crf, op4_chat, op5_pii_contexts, op6_line_dedup, op7_packing, op8_chunk_fingerprints, op9_repeated_runs, op9_sentence_spans, op10_language)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op4_chat": chat.ORACLE, "op6_line_dedup": _OP6, "op9_sentence_spans": spans.ORACLE, "op9_repeated_runs": spans.ORACLE_PASSAGES}
