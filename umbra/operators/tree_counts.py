"""noisy counts of the classes of a grouped release, consistent along the tree of its splits.

Every partition of the tree gets a count with Laplace noise: a record is counted once a level, so with h levels the scale is
h / epsilon. Constrained inference then finds the counts nearest to the noisy ones (in least squares) in which
children sum to their parent: from the leaves up, each partition's count is averaged with the sum of its
children by their variances; from the root down, what a parent has more than its children is shared out by their variances.
There is one small join a level of the tree, whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey, laplace
from umbra.operators.mondrian import MondrianResult
from umbra.operators.noisy import DECIMALS, LedgerEntry, check_epsilon
from umbra.session import Stages, cut_lineage


def split_tree(result: MondrianResult) -> DataFrame:
    """node, parent, level, leaf, n of every partition of a run with ``trace``."""
    path = result.classes.select("size", "cls", F.concat("above", F.array("cls")).alias("path"))
    steps = path.select("size", "cls", "path", F.posexplode("path").alias("level", "node"))
    return steps.groupBy("node").agg(F.max("level").alias("level"), F.max(F.get(F.col("path"), F.col("level") - 1)).alias("parent"),
                                     F.max(F.col("node") == F.col("cls")).alias("leaf"), F.sum("size").alias("n"))


def count_purpose(epsilon: float, levels: int) -> str:
    return f"tree count/{float(epsilon)!r}/{levels}"


def consistent_counts(result: MondrianResult, epsilon: float, noise: NoiseKey, decimals: int | None = DECIMALS,
                      diagnostic: bool = False) -> tuple[DataFrame, list[LedgerEntry]]:
    """node, parent, level, leaf, noisy_count of every partition, each the sum of its children; with ``diagnostic`` also the
    exact n and the ``plain`` noisy count before the inference (their rounding to ``decimals`` is the only deviation)."""
    check_epsilon(epsilon)
    stages = Stages(result.classes.sparkSession)
    tree = stages.write(split_tree(result))
    top = tree.agg(F.max("level")).first()[0]
    if top is None:
        return tree.select("node", "parent", "level", "leaf", F.lit(0.0).alias("noisy_count")), []
    levels = top + 1
    draw = laplace(noise.uniform(count_purpose(epsilon, levels), "node"), levels / epsilon)
    tree = stages.write(tree.withColumn("plain", F.col("n") + draw))
    up: list[DataFrame] = []            # by level: best count from below, its variance, and the children's
    for level in range(top, -1, -1):
        own = tree.where(F.col("level") == level)
        if up:
            below = up[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("z").alias("s"), F.sum("v").alias("sv"))
            own = own.join(below, "node", "left")
        else:
            own = own.withColumns({"s": F.lit(None).cast("double"), "sv": F.lit(None).cast("double")})
        v = F.when(F.col("leaf"), 1.0).otherwise(F.col("sv") / (F.col("sv") + 1))
        up.append(stages.write(own.withColumn("v", v).withColumn("z", F.when(F.col("leaf"), F.col("plain")).otherwise(F.col("v") * (F.col("plain") + F.col("s") / F.col("sv"))))))
    down, out = None, None
    for rows in reversed(up):
        if down is None:
            rows = rows.withColumn("x", F.col("z"))
        else:
            parents = down.select(F.col("node").alias("parent"), ((F.col("x") - F.col("s")) / F.col("sv")).alias("over"))
            rows = rows.join(parents, "parent").withColumn("x", F.col("z") + F.col("over") * F.col("v"))
        down = stages.write(rows.select("node", "parent", "level", "leaf", "n", "plain", "s", "sv", "x"))
        out = down if out is None else out.unionByName(down)
    rounded = lambda c: F.round(c, decimals) if decimals is not None else F.col(c)
    out = out.select("node", "parent", "level", "leaf", rounded("x").alias("noisy_count"), *([F.col("n"), F.col("plain")] if diagnostic else []))
    out = cut_lineage(out)
    stages.release()
    return out, [LedgerEntry("laplace", "noisy_count", float(epsilon), 0.0, float(levels))]


def noisy_release(result: MondrianResult, epsilon: float, noise: NoiseKey) -> tuple[DataFrame, list[LedgerEntry]]:
    """F1 after grouping: the labels of every class with its consistent noisy count (not below 0)."""
    counts, entries = consistent_counts(result, epsilon, noise)
    labels = result.classes.select(F.col("cls").alias("node"), *[F.col(f"label_{i}").alias(c) for i, c in enumerate(result.schema.qi)])
    out = labels.join(counts.where("leaf").select("node", "noisy_count"), "node")
    return out.select(*[F.col(f"`{c}`") for c in result.schema.qi], F.greatest(F.lit(0.0), F.col("noisy_count")).alias("noisy_count")), entries
