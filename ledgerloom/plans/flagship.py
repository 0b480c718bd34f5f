"""From foundation facts to the overall belief of every company (the six-variable model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beliefs, variables
from ..sources import adapters
from . import model


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"))


def foundation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, code, value, reason`` of the six variables, without reliability."""
    who, as_of = companies(spark, sf_dir), adapters.as_of()
    return variables.together(
        who,
        variables.financial_part(adapters.facts(spark, sf_dir), ("F1.1", "F2.2", "F2.3"), "foundation"),
        variables.lateness_part(adapters.obligations(spark, sf_dir), {"ACCOUNTS": "G1.1", "CONFIRMATION": "G1.2"}, as_of, "foundation"),
        variables.tenure_part(adapters.directors(spark, sf_dir), as_of),
    )


def reference_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beliefs.memberships(foundation_values(spark, sf_dir), model.variables(spark))


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, node, level, low, high, unknown`` of the two domains and the whole."""
    return beliefs.aggregate_tree(reference_beliefs(spark, sf_dir), model.hierarchy(spark), levels=2)
