"""Domain profiles and generalization hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import col
from umbra.session import cut_lineage


def _long(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias("attr"), col(c).cast(cast).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*items))).where(F.col("value").isNotNull())


def value_support(df: DataFrame, cols: list[str], cast: str = "double") -> DataFrame:
    """A1 support: (attr, value, support) for every value of every listed column, one pass."""
    return _long(df, cols, cast).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("support"))


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A1: per numeric attribute min, max, range and distinct count (all columns in one pass)."""
    return value_support(df, cols).groupBy("attr").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum("support").alias("n"))


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: per categorical attribute the exact distinct count (the root's leaf_num)."""
    return value_support(df, cols, "string").groupBy("attr").agg(
        F.count(F.lit(1)).alias("leaf_num"), F.sum("support").alias("n"))


def flat_edges(df: DataFrame, cols: list[str], root: str = "*") -> DataFrame:
    """Edges (attr, child, parent) of the two-level hierarchy ``* -> value`` built from the data.

    A value literally equal to the root symbol is not a child of itself.
    """
    return (_long(df, cols, "string").where(F.col("value") != root).select("attr", "value").distinct()
            .select("attr", F.col("value").alias("child"), F.lit(root).alias("parent")))


def hierarchy(edges: DataFrame) -> DataFrame:
    """A3: from (attr, child, parent) edges to (attr, node, level, leaf_num, is_leaf).

    ``leaf_num`` = number of leaves a node covers (0 for a leaf). See ``climb``.
    """
    rows = climb(edges).select("attr", "node", "level", "leaves", "is_leaf")
    return rows.select("attr", "node", "level", F.when(F.col("is_leaf"), 0).otherwise(F.col("leaves")).cast("long").alias("leaf_num"), "is_leaf")


def climb(edges: DataFrame, paths: bool = False) -> DataFrame:
    """attr, node, level, leaves, is_leaf of every node of a forest; ``path``: the nodes from the root to it.

    Pointers double: after round r a node knows its ancestor 2^r steps up, the steps taken, and the leaves
    among its descendants less than 2^r steps down. A round adds to each node what the nodes that point to it
    hold, so the rounds are the logarithm of the depth and no table is larger than the nodes (with
    ``paths``: than all paths). Two parents of one node and cycles are errors.
    """
    edges = cut_lineage(edges.select("attr", "child", "parent").distinct())
    nodes = edges.select("attr", F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(False).alias("inner")).unionByName(
        edges.select("attr", F.col("parent").alias("node"), F.lit(None).cast("string").alias("up"), F.lit(True).alias("inner")))
    nodes = nodes.groupBy("attr", "node").agg(F.max("up").alias("up"), F.count("up").alias("parents"), (~F.max("inner")).alias("is_leaf"))
    nodes = cut_lineage(nodes.select("attr", "node", "up", "parents", "is_leaf", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level"),
                                     F.col("is_leaf").cast("long").alias("leaves"), *([F.array("node").alias("path")] if paths else [])))
    n, most, open_ = nodes.agg(F.count(F.lit(1)), F.max("parents"), F.count("up")).first()
    if n and most > 1:
        raise ValueError("a node of the hierarchy has two parents")
    rounds = 0
    while open_:
        if 1 << rounds > n:                        # more steps up than there are nodes
            raise ValueError("the hierarchy has a cycle")
        below = nodes.where("up IS NOT NULL").groupBy("attr", F.col("up").alias("node")).agg(F.sum("leaves").alias("more"))
        above = nodes.select("attr", F.col("node").alias("up"), F.col("up").alias("higher"), F.col("level").alias("steps"), *([F.col("path").alias("rest")] if paths else []))
        nodes = nodes.join(below, ["attr", "node"], "left").join(above, ["attr", "up"], "left")
        longer = [F.concat("path", F.coalesce("rest", F.array().cast("array<string>"))).alias("path")] if paths else []
        nodes = cut_lineage(nodes.select("attr", "node", F.col("higher").alias("up"), "is_leaf", (F.col("level") + F.coalesce("steps", F.lit(0))).alias("level"),
                                         (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), *longer))
        open_ = nodes.where("up IS NOT NULL").count()
        rounds += 1
    return nodes.select("attr", "node", "level", "leaves", "is_leaf", *([F.reverse("path").alias("path")] if paths else []))


def leaf_paths(edges: DataFrame) -> DataFrame:
    """attr, value, root, path, widths of every leaf: ``path`` leads from below the root to the leaf; ``widths``
    are the shares of all leaves that the root and each node of the path cover (0 for the leaf)."""
    nodes = cut_lineage(climb(edges, paths=True))
    steps = nodes.where("is_leaf").select("attr", F.col("node").alias("value"), F.posexplode("path").alias("at", "node"))
    widths = nodes.select("attr", "node", F.when(F.col("is_leaf"), 0).otherwise(F.col("leaves")).alias("leaf_num"))
    one = F.struct("at", "node", "leaf_num")
    rows = steps.join(widths, ["attr", "node"]).groupBy("attr", "value").agg(F.sort_array(F.collect_list(one)).alias("s"))     # one path: its depth
    return rows.select("attr", "value", F.col("s")[0]["node"].alias("root"), F.slice(F.transform("s", lambda x: x["node"]), F.lit(2), F.size("s")).alias("path"),
                       F.transform("s", lambda x: x["leaf_num"] / F.col("s")[0]["leaf_num"]).alias("widths"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a (sensitive) column."""
    return df.select(col(column)).where(col(column).isNotNull()).distinct()
