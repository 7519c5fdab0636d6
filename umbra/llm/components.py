"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """id, label of every node of ``links`` (a, b): the smallest id that it is connected to.

    Each round takes the smallest label among the neighbours, then the label of that label, so chains
    shorten by half; rounds end when no label changes. Labels are written and read again each round.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = cut_lineage(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low")))
        jump = step.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        labels_next = cut_lineage(step.join(jump, "low").select("id", F.least("low", "lower").alias("label"), (F.col("label") != F.least("low", "lower")).alias("moved")))
        labels = labels_next.select("id", "label")
        if labels_next.where("moved").isEmpty():
            return labels
