"""Releases that protect persons, not rows: bounded contributions, unknown groups, private quantiles.

A person with many rows would change a count by as many. ``bound_rows`` keeps at most m rows a person, by a keyed draw,
so that a sum of values in [lo, hi] changes by a known amount when a person comes or goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey, gumbel, laplace
from umbra.functions.text import col
from umbra.operators.noisy import DECIMALS, LedgerEntry, check_epsilon, clip
from umbra.operators.ranks import running
from umbra.operators.threshold import _group_keys, over_domain
from umbra.session import Stages, cut_lineage

SALTS = 64


def bound_rows(df: DataFrame, person: str, row_key, m: int, noise: NoiseKey) -> DataFrame:
    """At most ``m`` rows of each person: those with the least keyed draws. A null person or key is an error.

    Two steps, so that a person with a third of all rows is never one task: m of each of ``SALTS`` slices of a
    person's rows, then m of those that are left."""
    if m < 1:
        raise ValueError("a person contributes at least one row")
    keys = list(row_key) if isinstance(row_key, (list, tuple)) else [row_key]
    rows = df.withColumn("__u", noise.uniform(bound_purpose(m), person, *keys))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__u"), F.lit(SALTS)))
    order = [F.col("__u"), *[col(k) for k in keys]]
    for part in (["__salt"], []):
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(col(person), *part).orderBy(*order))).where(F.col("__n") <= m)
    return rows.drop("__u", "__salt", "__n")


def bound_purpose(m: int) -> str:
    return f"bound/{m}"


def sum_sensitivity(m: int, lo: float, hi: float) -> float:
    """What a person's m values in [lo, hi] can change a sum by, if the person comes, goes or is replaced."""
    if not lo < hi:
        raise ValueError("values are clipped to a range lo < hi")
    return m * max(abs(lo), abs(hi), hi - lo)


def person_count(df: DataFrame, by: list[str], person: str, row_key, m: int, epsilon: float, noise: NoiseKey, domain=None,
                 diagnostic: bool = False) -> tuple[DataFrame, list[LedgerEntry]]:
    """E11 for persons: rows per group, at most ``m`` rows a person over all groups, plus Lap(m/epsilon), rounded, at least 0."""
    check_epsilon(epsilon)
    counts = over_domain(bound_rows(df, person, row_key, m, noise), by, {"true_count": F.lit(1).cast("long")}, domain)
    draw = laplace(noise.uniform(f"person count/{m}/{float(epsilon)!r}", *_group_keys(by)), m / epsilon)
    out = counts.withColumn("noisy_count", F.greatest(F.lit(0), F.round(F.col("true_count") + draw).cast("long")))
    return out if diagnostic else out.drop("true_count"), [LedgerEntry("laplace", "noisy_count", float(epsilon), 0.0, float(m))]


def person_sum(df: DataFrame, by: list[str], value: str, person: str, row_key, m: int, lo: float, hi: float, epsilon: float, noise: NoiseKey, domain=None,
               decimals: int | None = DECIMALS, diagnostic: bool = False) -> tuple[DataFrame, list[LedgerEntry]]:
    """D7 for persons: sums of clipped values per group, at most ``m`` rows a person, plus Laplace noise of ``sum_sensitivity``."""
    check_epsilon(epsilon)
    s = sum_sensitivity(m, lo, hi)
    rows = bound_rows(df.where(col(value).isNotNull()), person, row_key, m, noise)
    sums = over_domain(rows, by, {"true_sum": clip(col(value), lo, hi)}, domain)
    draw = laplace(noise.uniform(f"person sum/{m}/{s!r}/{float(epsilon)!r}", *_group_keys(by)), s / epsilon)
    noisy = F.col("true_sum") + draw
    out = sums.withColumn("noisy_sum", F.round(noisy, decimals) if decimals is not None else noisy)
    return out if diagnostic else out.drop("true_sum"), [LedgerEntry("laplace", "noisy_sum", float(epsilon), 0.0, s)]


def person_proportion(df: DataFrame, by: list[str], indicator: Column, person: str, row_key, m: int, epsilon: float, noise: NoiseKey,
                      domain=None, decimals: int | None = DECIMALS) -> tuple[DataFrame, list[LedgerEntry]]:
    """E12 for persons without a public group size: noisy hits over noisy rows, half of epsilon each, in [0, 1]; a group with
    no noisy row has no proportion."""
    check_epsilon(epsilon)
    rows = bound_rows(df, person, row_key, m, noise)
    got = over_domain(rows, by, {"n": F.lit(1).cast("long"), "hits": F.coalesce(indicator.cast("long"), F.lit(0).cast("long"))}, domain)
    draw = lambda what: laplace(noise.uniform(f"person proportion/{what}/{m}/{float(epsilon)!r}", *_group_keys(by)), 2 * m / epsilon)
    n, hits = F.col("n") + draw("rows"), F.col("hits") + draw("hits")
    p = F.when(n >= 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits / n)))
    out = got.withColumn("noisy_proportion", F.round(p, decimals) if decimals is not None else p)
    return out.select(*[col(c) for c in by], "noisy_proportion"), [LedgerEntry("laplace", "noisy_proportion", float(epsilon), 0.0, 2.0 * m)]


def selection_threshold(m: int, epsilon: float, delta: float) -> float:
    """A group that only one person is in passes with so small a probability that, over the m groups a person may be in,
    any passes with probability ``delta`` at most."""
    check_epsilon(epsilon)
    if not 0 < delta < 1:
        raise ValueError("the choice of groups needs 0 < delta < 1")
    p = -math.expm1(math.log1p(-delta) / m)
    return 1 + (m / epsilon) * max(math.log(1 / (2 * p)), 0.0) if p < 0.5 else 1.0


def unknown_groups(df: DataFrame, by: list[str], person: str, m: int, epsilon: float, delta: float, noise: NoiseKey,
                   diagnostic: bool = False) -> tuple[DataFrame, list[LedgerEntry]]:
    """E11 without a public domain: persons per group, at most ``m`` groups a person, plus Lap(m/epsilon); a group is
    released only if its noisy count reaches ``selection_threshold``."""
    limit = selection_threshold(m, epsilon, delta)
    pairs = df.select(col(person), *[col(c) for c in by]).distinct().withColumn("__group", F.concat_ws("\u001f", *_group_keys(by)))
    counts = bound_rows(pairs, person, "__group", m, noise).groupBy(*[col(c) for c in by]).agg(F.count(F.lit(1)).alias("true_count"))
    draw = laplace(noise.uniform(f"unknown groups/{m}/{float(epsilon)!r}/{float(delta)!r}", *_group_keys(by)), m / epsilon)
    out = counts.withColumn("__noisy", F.col("true_count") + draw).where(F.col("__noisy") >= limit)
    out = out.withColumn("noisy_count", F.round("__noisy").cast("long")).drop("__noisy")
    return out if diagnostic else out.drop("true_count"), [LedgerEntry("laplace", "noisy_count", float(epsilon), float(delta), float(m))]


def quantile_purpose(q: float, epsilon: float) -> str:
    return f"quantile/{float(q)!r}/{float(epsilon)!r}"


def private_quantiles(df: DataFrame, value: str, quantiles: list[float], lo: float, hi: float, epsilon: float, noise: NoiseKey,
                      by: list[str] = (), decimals: int | None = DECIMALS) -> tuple[DataFrame, list[LedgerEntry]]:
    """Quantiles of each group by the exponential mechanism over the intervals between its sorted, clipped values.

    An interval after ``before`` values has utility -|before - q n| (it changes by 1 at most when a row comes or goes) and
    weighs its length; the answer is a uniform point of the interval drawn. Each quantile spends ``epsilon``. Ranks are
    running sums over range partitions of the distinct values, and a group's size and ends meet its values by group and run
    of the order, so no group and no table is sorted or joined in one task. Null values do not count; a group without
    values has no answer."""
    check_epsilon(epsilon)
    if not lo < hi or any(not 0 <= q <= 1 for q in quantiles) or not quantiles:
        raise ValueError("quantiles lie in [0, 1] of values clipped to a range lo < hi")
    by = list(by)
    keys = [F.col(f"__by{i}") for i in range(len(by))]
    names = [f"__by{i}" for i in range(len(by))]
    rows = df.where(col(value).isNotNull()).select(*[col(c).alias(n) for c, n in zip(by, names)], clip(col(value), lo, hi).alias("v"))
    freq = rows.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c"))
    stages = Stages(df.sparkSession)
    ranked = stages.write(running(freq, [*names, "v"], F.col("c"), stages, carry=["v"], run="__run"))
    # one row for what a group has in a run of the order; a group's sums go back to these, and from there to the rows
    parts = ranked.groupBy(*names, "__run").agg(F.min("before").alias("__start"), F.sum("c").alias("n"), F.max("v").alias("__top"))
    # the first value of a group has no value before it in the group
    groups = parts.groupBy(*names).agg(F.min("__start").alias("__start"), F.sum("n").alias("n"), F.max("__top").alias("__top"))
    parts = parts.select(F.col("__run").alias("g__run"), *[F.col(n).alias(f"g{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"g{n}"))
    if names:
        groups = stages.write(parts.join(groups, same).drop(*names))
        r = ranked.join(groups, (F.col("__run") == F.col("g__run")) & same)
    else:
        r = ranked.crossJoin(F.broadcast(groups))       # one row without groups
    r = r.withColumn("before", F.col("before") - F.col("__start"))
    low = F.when(F.col("before") == 0, F.lit(float(lo))).otherwise(F.col("prev_v"))
    ends = F.array(F.struct(F.col("before").alias("rank"), low.alias("a"), F.col("v").alias("b")),
                   F.struct(F.col("n").alias("rank"), F.col("v").alias("a"), F.when(F.col("v") == F.col("__top"), F.lit(float(hi))).alias("b")))
    spans = r.select(*names, "n", F.explode(ends).alias("s")).where("s.b > s.a")
    group_keys = _group_keys(names)
    spans = spans.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    def per_quantile(expr):
        out = F.lit(None).cast("double")
        for q in quantiles:
            out = F.when(F.col("q") == float(q), expr(q)).otherwise(out)
        return out
    draw = per_quantile(lambda q: gumbel(noise.uniform(quantile_purpose(q, epsilon), F.col("s.rank"), *group_keys)))
    score = -F.lit(epsilon / 2) * F.abs(F.col("s.rank") - F.col("q") * F.col("n")) + F.log(F.col("s.b") - F.col("s.a")) + draw
    # both ends are of the same interval, also if scores tie; numbers alone, unlike a struct, need no sort of the intervals
    best = spans.withColumn("__score", score).groupBy(*names, "q").agg(*[F.max_by(f"s.{x}", "__score").alias(x) for x in ("a", "b")])
    u = per_quantile(lambda q: noise.uniform(quantile_purpose(q, epsilon) + "/point", *group_keys))
    point = F.col("a") + u * (F.col("b") - F.col("a"))
    out = cut_lineage(best.select(*[k.alias(c) for k, c in zip(keys, by)], "q", (F.round(point, decimals) if decimals is not None else point).alias("noisy_quantile")))
    stages.release()
    return out, [LedgerEntry("exponential", "noisy_quantile", float(epsilon) * len(quantiles), 0.0, 1.0)]


def utilities(df: DataFrame, option: str, utility: Column, selection: str | None = None) -> DataFrame:
    """Options with any aggregate Column as their utility, per ``selection`` if given; for ``exponential_select``.

    The caller answers for the sensitivity: what one row, or one person's bounded rows, can change the aggregate by."""
    keys = [(col(selection) if selection else F.lit("s0")).alias("selection_id"), col(option).alias("option")]
    return df.where(col(option).isNotNull()).groupBy(*keys).agg(utility.cast("double").alias("utility"))
