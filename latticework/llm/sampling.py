"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from latticework.llm.common import checkpoint

_GRAIN = 1 << 40
#: Bytes of features that a sample sends to the driver, about.
SAMPLE_BYTES = 256 << 20


def per_label(rows: DataFrame, label: str, each: int) -> tuple[DataFrame, dict]:
    """About ``each`` rows (twice as many at most) of every label by a hash of doc_id, and the count of all rows by label.

    All labels take part; a row of counts for each is sent to the driver. Rows are the same
    whenever the table is the same, and no row is sorted or sent to one task.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).collect()}
    if not counts:
        return rows.limit(0), counts
    share = F.when(F.lit(False), F.lit(0).cast("long"))  # one flat expression, however many labels
    for value, n in counts.items():
        share = share.when(F.col(label) == F.lit(value), F.lit(min(_GRAIN, -(-_GRAIN * each // n))))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(_GRAIN)) < share)
    return chosen.limit(2 * each * len(counts)), counts


def bounded(features: DataFrame, size: Column, limit: int = SAMPLE_BYTES) -> list[Row]:
    """Distinct rows of features, or about limit bytes of them by a hash of the row, in one order always.

    Rows that repeat a doc_id are rows of their own, so that however many there are, no more
    than the limit reaches the driver.
    """
    held = checkpoint(features.distinct())
    total = held.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total > limit:
        held = held.where(F.pmod(F.xxhash64(*held.columns), F.lit(_GRAIN)) < _GRAIN * limit // total)
    return sorted(held.collect())
