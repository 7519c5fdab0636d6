"""Measured privacy reports (A9) over equivalence classes of a released table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import col


def equivalence_classes(df: DataFrame, qi: list[str], sa: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per QI tuple: class size and, with an SA, its diversity.

    Two partial aggregations (per (class, sa), then per class), so a hot class
    is combined map-side and never gathered in one task.
    """
    w = col(weight) if weight else F.lit(1)
    keys = [col(c) for c in qi]
    if sa is None:
        return df.groupBy(*keys).agg(F.sum(w).cast("long").alias("class_size"))
    per_sa = df.groupBy(*keys, col(sa).alias("__sa")).agg(F.sum(w).cast("long").alias("__n"))
    return per_sa.groupBy(*keys).agg(
        F.sum("__n").alias("class_size"),
        F.count("*").alias("distinct_sa"),
        F.max("__n").alias("max_sa_count"),
    ).withColumn("max_sa_share", F.col("max_sa_count") / F.col("class_size"))


def privacy_report(df: DataFrame, qi: list[str], sa: str | None = None, weight: str | None = None) -> DataFrame:
    """A9 (re-aimed as a measured report): one row with class statistics of the data itself."""
    classes = equivalence_classes(df, qi, sa, weight)
    aggs = [
        F.sum("class_size").alias("n_records"),
        F.count("*").alias("n_classes"),
        F.min("class_size").alias("min_class_size"),
        F.sum(F.when(F.col("class_size") == 1, 1).otherwise(0)).alias("unique_records"),
        (F.lit(1.0) / F.min("class_size")).alias("max_reid_risk"),
    ]
    if sa is not None:
        aggs += [F.min("distinct_sa").alias("min_distinct_sa"), F.max("max_sa_share").alias("max_sa_share")]
    return classes.agg(*aggs)
