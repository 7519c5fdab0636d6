"""Exponential mechanism and randomized sensitive attributes.

Options live in a candidates DataFrame ``(selection_id, option, utility)``; every selection
is an aggregate per ``selection_id`` (partial aggregation, no group gathered in one task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey, gumbel
from umbra.functions.text import col
from umbra.operators.noisy import LedgerEntry, check_epsilon, check_sensitivity


def exponential_weights(cands: DataFrame, epsilon: float, sensitivity: float, group: str = "selection_id",
                        utility: str = "utility") -> DataFrame:
    """``p = exp(x - max x) / sum exp(...)`` with ``x = eps*u/(2*sens)`` per group.

    Max and sum are grouped aggregates joined back (not a window), so a selection with a huge
    option set is still combined map-side.
    """
    check_epsilon(epsilon)
    check_sensitivity(sensitivity)
    x = F.lit(epsilon / (2.0 * sensitivity)) * col(utility).cast("double")
    c = cands.withColumn("__x", x)
    mx = c.groupBy(group).agg(F.max("__x").alias("__mx"))
    e = c.join(mx, group).withColumn("__e", F.exp(F.col("__x") - F.col("__mx")))
    tot = e.groupBy(group).agg(F.sum("__e").alias("__tot"))
    return e.join(tot, group).withColumn("probability", F.col("__e") / F.col("__tot")).drop("__x", "__mx", "__e", "__tot")


def selection_purpose(epsilon: float, sensitivity: float) -> str:
    return f"select/{float(epsilon)!r}/{float(sensitivity)!r}"


def exponential_select(cands: DataFrame, epsilon: float, sensitivity: float, noise: NoiseKey, group: str = "selection_id",
                       option: str = "option", utility: str = "utility", with_probability: bool = False) -> DataFrame:
    """One option per selection by Gumbel-max (argmax of eps*u/(2 sens) + Gumbel noise).

    Equivalent in distribution to sampling from E1's softmax. ``with_probability`` adds the exact (so not
    private) probability of the pick: one aggregate finds pick and largest utility, one sums the weights.
    """
    check_epsilon(epsilon)
    check_sensitivity(sensitivity)
    x = F.lit(epsilon / (2.0 * sensitivity)) * col(utility).cast("double")
    score = x + gumbel(noise.uniform(selection_purpose(epsilon, sensitivity), col(group), col(option)))
    c = cands.withColumns({"__x": x, "__score": score})
    aggs = [F.max_by(F.struct(col(option).alias("o"), F.col("__x").alias("x")), F.col("__score")).alias("__best"), F.count(F.lit(1)).alias("n_options")]
    if with_probability:
        aggs += [F.max("__x").alias("__mx")]
    picked = c.groupBy(group).agg(*aggs)
    out = picked.select(group, F.col("__best.o").alias("selected"), "n_options", *(["__best", "__mx"] if with_probability else []))
    if not with_probability:
        return out
    tot = c.join(picked.select(group, "__mx"), group).groupBy(group).agg(F.sum(F.exp(F.col("__x") - F.col("__mx"))).alias("__tot"))
    return out.join(tot, group).select(group, "selected", "n_options", (F.exp(F.col("__best.x") - F.col("__mx")) / F.col("__tot")).alias("probability"))


def top_k_probabilities(cands: DataFrame, epsilon: float, sensitivity: float, k: int = 3,
                        group: str = "selection_id", option: str = "option", utility: str = "utility") -> DataFrame:
    """The k most likely options per selection (k capped to the option count; ties by option).

    Diagnostic only: exact probabilities are not themselves private.
    """
    w = exponential_weights(cands, epsilon, sensitivity, group, utility)
    rk = Window.partitionBy(group).orderBy(F.col("probability").desc(), col(option).asc())
    return w.withColumn("rank", F.row_number().over(rk)).where(F.col("rank") <= k)


def utility_counts(df: DataFrame, category: str, group_value: str = "s0") -> DataFrame:
    """Utilities computed from the data: ``count`` per category (sensitivity 1)."""
    return (df.where(col(category).isNotNull()).groupBy(col(category).alias("option"))
            .agg(F.count(F.lit(1)).cast("double").alias("utility"))
            .withColumn("selection_id", F.lit(group_value)))


def selection_entry(epsilon: float, selections: int, target: str = "selected", sensitivity: float = 1.0) -> list[LedgerEntry]:
    """E5: ledger rows of a batch of selections over one data set: they compose in sequence."""
    return [LedgerEntry("exponential", target, float(epsilon) * selections, 0.0, float(sensitivity))]


def selection_statistics(selected: DataFrame, epsilon: float, sensitivity: float) -> DataFrame:
    """E5: number of selections made and their parameters, from the selections themselves."""
    return selected.agg(F.count(F.lit(1)).alias("total_selections")).select(
        F.lit(float(epsilon)).alias("epsilon"), F.lit(float(sensitivity)).alias("sensitivity"), "total_selections")


DOMAIN_GROUPS = 256


def _domain(df: DataFrame, sa: str) -> DataFrame:
    """Distinct SA values with a dense 0-based index, in order of (two digest digits, value).

    Values are ranked inside DOMAIN_GROUPS groups; only one row a group is added up in order."""
    d = df.select(col(sa).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    d = d.withColumn("__g", F.substring(F.sha2(F.col("__v").cast("string"), 256), 1, 2))
    sizes = d.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))      # DOMAIN_GROUPS rows at most
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__v"))
    return d.withColumn("__r", rank).join(F.broadcast(offsets), "__g").select("__v", (F.col("__o") + F.col("__r") - 1).alias("__i"))


def randomize_sa(df: DataFrame, sa: str, epsilon: float, key, noise: NoiseKey, mode: str = "krr") -> DataFrame:
    """Randomized sensitive attribute.

    ``mode='krr'``: k-ary randomized response, keep with e^eps/(e^eps + n - 1), else a uniformly
    chosen *other* value (eps-LDP). ``mode='compat'``: with probability eps/100 replace by a
    uniformly chosen value of the domain (no DP guarantee; larger eps replaces *more*).
    Replacement values come from an equi-join on a random index into the domain table; rows that
    keep their value get spread negative indexes, so they share no key.
    """
    check_epsilon(epsilon)
    dom = _domain(df, sa)
    n = dom.count()
    if n == 0:
        return df
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    u1 = noise.uniform(f"response/{mode}/{sa}/{float(epsilon)!r}/keep", *keys)
    u2 = noise.uniform(f"response/{mode}/{sa}/{float(epsilon)!r}/pick", *keys)
    own = df.join(dom.select(F.col("__v").alias("__own_v"), F.col("__i").alias("__own")),
                  col(sa) == F.col("__own_v"), "left")
    if mode == "compat":
        flip = u1 < F.lit(epsilon / 100.0)
        target = F.floor(u2 * n).cast("long")
    elif mode == "krr":
        keep = math.exp(epsilon) / (math.exp(epsilon) + n - 1)
        flip = (u1 >= F.lit(keep)) & F.lit(n > 1)
        j = F.floor(u2 * (n - 1)).cast("long")
        target = F.when(j >= F.col("__own"), j + 1).otherwise(j)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = F.lit(-1) - F.floor(u2 * 100_000).cast("long")
    own = own.withColumn("__t", F.when(flip & F.col("__own").isNotNull(), target).otherwise(kept))
    rep = dom.select(F.col("__i").alias("__t"), F.col("__v").alias("__new"))
    out = own.join(rep, "__t", "left")
    return out.withColumn(sa, F.coalesce(F.col("__new"), col(sa))).drop("__own_v", "__own", "__t", "__new")
