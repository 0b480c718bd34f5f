"""Versioned risk model: variables, reference levels, hierarchy. Small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the model: code, domain, level at which risk is low, level at which it is high, unit.
VARIABLES = (
    ("G1.1", "GOVERNANCE", 0.0, 90.0, "days"),
    ("G1.2", "GOVERNANCE", 0.0, 30.0, "days"),
    ("G2.1", "GOVERNANCE", 0.0, 0.5, "ratio"),
    ("G2.2", "GOVERNANCE", 5.0, 1.0, "years"),
    ("G2.3", "GOVERNANCE", 0.0, 0.5, "ratio"),
    ("G3.1", "GOVERNANCE", 0.0, 2.0, "count"),
    ("F1.1", "FINANCIAL", 0.1, 0.0, "ratio"),
    ("F1.2", "FINANCIAL", 0.0, -0.2, "ratio"),
    ("F2.2", "FINANCIAL", 1.5, 1.1, "ratio"),
    ("F2.3", "FINANCIAL", 1.0, 0.7, "ratio"),
    ("F3.1", "FINANCIAL", 0.2, 0.6, "ratio"),
)
# The variables of each model version.
MEMBERS = {
    "1": tuple(v[0] for v in VARIABLES),
    "1.1": ("G1.1", "G1.2", "G2.2", "F1.1", "F2.2", "F2.3", "F3.1"),
    "1.2": ("G1.1", "G1.2", "G2.2", "F1.1", "F2.2", "F2.3"),
}
CURRENT = "1.2"
DOMAIN_WEIGHTS = (("GOVERNANCE", 0.4), ("FINANCIAL", 0.6))
# Fixed values of the historical three-level model: parent, child, weight, level (the deepest is combined first).
HISTORICAL = (
    ("OVERALL", "GOVERNANCE", 0.4, 1), ("OVERALL", "FINANCIAL", 0.6, 1),
    ("GOVERNANCE", "G1", 0.3, 2), ("GOVERNANCE", "G2", 0.45, 2), ("GOVERNANCE", "G3", 0.25, 2),
    ("FINANCIAL", "F1", 0.35, 2), ("FINANCIAL", "F2", 0.4, 2), ("FINANCIAL", "F3", 0.25, 2),
    ("G1", "G1.1", 0.6, 3), ("G1", "G1.2", 0.4, 3),
    ("G2", "G2.1", 0.4, 3), ("G2", "G2.2", 0.25, 3), ("G2", "G2.3", 0.35, 3), ("G3", "G3.1", 1.0, 3),
    ("F1", "F1.1", 0.65, 3), ("F1", "F1.2", 0.35, 3), ("F2", "F2.2", 0.6, 3), ("F2", "F2.3", 0.4, 3), ("F3", "F3.1", 1.0, 3),
)


def current_hierarchy() -> tuple[tuple[str, str, float, int], ...]:
    """Equal weights inside the domains of the current model."""
    edges = [("OVERALL", d, w, 1) for d, w in DOMAIN_WEIGHTS]
    for d, _ in DOMAIN_WEIGHTS:
        inside = [v[0] for v in VARIABLES if v[1] == d and v[0] in MEMBERS[CURRENT]]
        edges += [(d, c, 1 / len(inside), 2) for c in inside]
    return tuple(edges)


def variables(spark: SparkSession, version: str = CURRENT) -> DataFrame:
    """The variables of a version; an unknown version is an error, never another one."""
    if version not in MEMBERS:
        raise ValueError(f"unknown model version {version}")
    rows = [(version, *v) for v in VARIABLES if v[0] in MEMBERS[version]]
    return spark.createDataFrame(rows, "model_version string, code string, domain string, low_ref double, high_ref double, unit string")


def hierarchy(spark: SparkSession, edges=None) -> DataFrame:
    return spark.createDataFrame(list(edges or current_hierarchy()), "parent string, child string, weight double, level int")


def config_issues(variables: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``(issue, subject)``: weights of a parent that do not sum to 1; variables that no domain has; children that are no variables."""
    weights = hierarchy.groupBy("parent").agg(F.sum("weight").alias("w")).filter(F.abs(F.col("w") - 1) > 1e-8).select(F.lit("WEIGHTS_NOT_ONE").alias("issue"), F.col("parent").alias("subject"))
    leaves = hierarchy.join(hierarchy.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select(F.col("child").alias("code"))
    missing = variables.select("code").exceptAll(leaves).select(F.lit("VARIABLE_WITHOUT_DOMAIN"), "code")
    unknown = leaves.exceptAll(variables.select("code")).select(F.lit("CHILD_IS_NO_VARIABLE"), "code")
    return weights.union(missing).union(unknown)
