"""The registered queries over the driver's tables, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.plans import chunks, evidence, facts, jobs, layouts, reviews, risks, schemes, scores


Query = Callable[[SparkSession, str], DataFrame]
MODULES = [scores, risks, reviews, chunks, evidence, layouts, schemes, facts, jobs]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["m14_evaluation_totals"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
