"""The corpus pipeline: language identification, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, and any others that docs has, whatever their names. ``run`` applies
them one after another. No stage fails on null ids or texts, repeated rows or empty tables;
what it makes of them is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, lang_id, line_dedup, packing, similar
from latticework.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is recognised with a probability of 0.5 or more.

    Each row is judged by its own text; null and empty texts go, repeated rows stay or go together.
    """
    return lang_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a larger doc_id keeps; n_chars follows the text.

    All rows stay. A null text becomes an empty one. Rows of one doc_id are one document;
    rows without a doc_id are documents of their own texts, smaller than any other.
    """
    done = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by a similarity of 0.8 or more on five-word shingles.

    Texts without words, null ones among them, are a group. Rows are apart by doc_id and
    text: those that only share a doc_id are judged each, rows equal in both are one
    document. Rows without a doc_id come after all others; ties go by a hash of the text.
    """
    return similar.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row judged by its own text; null and very short texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null text is its end mark alone, repeated rows are packed each."""
    return packing.pack(docs, packing.default_tokenizer(), special=True)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]
#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
