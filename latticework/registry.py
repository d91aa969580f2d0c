"""All queries of the frame engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.plans import crystals, points, polyhedra, reports, sources, tracks

_PLANS = (points, polyhedra, crystals, reports, tracks, sources)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.chordless_rings(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in _PLANS for f in plan.FIXED}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
