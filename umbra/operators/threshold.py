"""Above-threshold answers and noisy counts / proportions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey, gaussian, laplace
from umbra.functions.text import col
from umbra.operators.noisy import DECIMALS, LedgerEntry, check_epsilon


def threshold_scales(epsilon: float, delta: float, mode: str, max_positives: int) -> tuple[float, float, float]:
    """Noise scales of the threshold, of each query and of each answer."""
    if mode == "compat":
        both = math.sqrt(32 * math.log(1 / delta)) / epsilon if delta > 0 else 2.0 / epsilon
        return both, both, 2.0 / epsilon
    share = epsilon / 3.0
    return 1.0 / share, 2.0 * max_positives / share, max_positives / share


def above_threshold(queries: DataFrame, threshold: float, epsilon: float, noise: NoiseKey, delta: float = 0.0,
                    batch: str = "batch_id", query: str = "query_id", value: str = "value",
                    mode: str = "svt", max_positives: int = 1, decimals: int | None = DECIMALS,
                    diagnostic: bool = False) -> DataFrame:
    """Answer ``value`` if ``value + nu >= threshold + rho`` else null.

    rho is drawn once per batch and nu once per query (a new ``batch_id`` or release draws anew: E10).
    ``mode='svt'`` is the sparse vector of Lyu, Su and Li (2017), with a third of epsilon each for the
    threshold (Lap(3/eps)), the comparisons (Lap(6c/eps)) and the answers (Lap(3c/eps)), where c is
    ``max_positives``. With these scales one draw of the threshold covers all c positives. Only the
    first c positives of a batch, in order of the unique ``query``, are answered; then it halts.
    ``mode='compat'``: threshold and query noise Laplace 2/eps (Gaussian sqrt(32 ln(1/delta))/eps when
    delta > 0), answer noise Laplace 2/eps, never halts. Exact values are dropped, unless ``diagnostic``.
    """
    check_epsilon(epsilon)
    if mode not in ("compat", "svt"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "svt" and (delta != 0 or max_positives < 1):
        raise ValueError("the sparse vector takes delta 0 and at least one positive")
    if not 0 <= delta <= 1:
        raise ValueError(f"delta {delta} is no probability")
    tscale, qscale, ascale = threshold_scales(epsilon, delta, mode, max_positives)
    tag = f"{mode}/{float(threshold)!r}/{float(epsilon)!r}/{float(delta)!r}/{max_positives}"

    def draw(what, scale, *keys):
        if mode == "compat" and delta > 0 and what != "answer":
            return gaussian(noise.uniform(f"at/{what}/1/{tag}", *keys), noise.uniform(f"at/{what}/2/{tag}", *keys), scale)
        return laplace(noise.uniform(f"at/{what}/{tag}", *keys), scale)

    rho, nu = draw("threshold", tscale, col(batch)), draw("query", qscale, col(batch), col(query))
    q = queries.withColumn("above", col(value).cast("double") + nu >= F.lit(float(threshold)) + rho)
    if mode == "svt":
        nth = F.row_number().over(Window.partitionBy(batch).orderBy(query))
        # the limit prunes each task to c rows a batch before they meet
        first = q.where("above").select(col(batch).alias("__b"), col(query).alias(query)).withColumnRenamed("__b", batch).withColumn("__n", nth)
        cut = first.where(F.col("__n") <= max_positives).groupBy(batch).agg(F.max(query).alias("__cut"))
        q = q.join(cut, batch, "left").withColumn("above", F.coalesce(F.col("above") & (col(query) <= F.col("__cut")), F.lit(False))).drop("__cut")
    answer = col(value).cast("double") + draw("answer", ascale, col(batch), col(query))
    q = q.withColumn("answer", F.when(F.col("above"), F.round(answer, decimals) if decimals is not None else answer))
    return q if diagnostic else q.drop(value)


def threshold_entry(epsilon: float, target: str = "answer", delta: float = 0.0) -> list[LedgerEntry]:
    """Ledger row of one sparse-vector batch: all of epsilon, however many queries were asked."""
    return [LedgerEntry("above_threshold", target, float(epsilon), float(delta), 1.0)]


def threshold_statistics(answers: DataFrame, epsilon: float, threshold: float, delta: float = 0.0,
                         batch: str = "batch_id") -> DataFrame:
    """Per batch: queries answered, positives and the parameters (never the noisy threshold)."""
    return answers.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_queries"), F.sum(F.col("above").cast("int")).alias("positives"),
    ).withColumns({"epsilon": F.lit(float(epsilon)), "delta": F.lit(float(delta)), "threshold": F.lit(float(threshold))})


def _group_keys(by: list[str]) -> list:
    """Noise keys of a group; a null value is told from every text."""
    return [F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("null")) for c in by]


def over_domain(rows: DataFrame, by: list[str], aggs: dict[str, Column], domain) -> DataFrame:
    """One row a group; with a public ``domain`` (a frame, or a list of keys) exactly its groups, empty ones included.

    Domain rows join the data as rows without weight, so one aggregate does it, and nulls are keys like others."""
    keys = [col(c) for c in by]
    if domain is None:
        return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in aggs.items()])
    if isinstance(domain, DataFrame):
        known = domain.select(*keys)
    else:
        kinds = dict(rows.dtypes)
        items = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, key if isinstance(key, tuple) else (key,))]) for key in domain]
        known = rows.sparkSession.range(1).select(F.inline(F.array(*items)))
    own = rows.select(*keys, *[x.alias(f"__{n}") for n, x in aggs.items()], F.lit(False).alias("__public"))
    none = known.select(*keys, *[F.lit(None).cast(own.schema[f"__{n}"].dataType).alias(f"__{n}") for n in aggs], F.lit(True).alias("__public"))
    out = own.unionByName(none).groupBy(*keys).agg(*[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(n) for n in aggs], F.max("__public").alias("__public"))
    return out.where("__public").drop("__public")


def noisy_count(df: DataFrame, by: list[str], epsilon: float, noise: NoiseKey, domain: DataFrame | list | None = None,
                total: int | None = None, diagnostic: bool = False) -> DataFrame:
    """``count`` per group + Lap(1/eps), rounded, at least 0 and at most the public ``total``, if given.

    With a public ``domain`` of keys (a frame, or a list of keys) every key is released, so empty groups are not revealed by their
    absence; null keys count like others. Disjoint groups compose in parallel (eps once). The exact
    count is dropped, unless ``diagnostic``.
    """
    check_epsilon(epsilon)
    counts = over_domain(df, by, {"true_count": F.lit(1).cast("long")}, domain)
    draw = laplace(noise.uniform(f"count/{float(epsilon)!r}", *_group_keys(by)), 1.0 / epsilon)
    noisy = F.greatest(F.lit(0), F.round(F.col("true_count").cast("double") + draw).cast("long"))
    out = counts.withColumn("noisy_count", noisy if total is None else F.least(F.lit(int(total)), noisy))
    return out if diagnostic else out.drop("true_count")


def noisy_proportion(df: DataFrame, indicator, epsilon: float, noise: NoiseKey, by: list[str] | None = None,
                     decimals: int | None = DECIMALS, diagnostic: bool = False) -> DataFrame:
    """``avg(indicator)`` + Lap(1/(n*eps)) clamped to [0, 1], per group. The group size n is public
    here; the exact proportion is dropped, unless ``diagnostic``."""
    check_epsilon(epsilon)
    by = by or []
    g = df.groupBy(*[col(c) for c in by]).agg(F.count(F.lit(1)).alias("n"),
                                               F.avg(indicator.cast("double")).alias("true_proportion"))
    scale = F.lit(1.0) / (F.col("n") * F.lit(float(epsilon)))
    draw = laplace(noise.uniform(f"proportion/{float(epsilon)!r}", *_group_keys(by)), scale)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("true_proportion") + draw))
    out = g.where(F.col("n") > 0).withColumn("noisy_proportion", F.round(p, decimals) if decimals is not None else p)
    return out if diagnostic else out.drop("true_proportion")


def count_entry(epsilon: float, target: str) -> list[LedgerEntry]:
    """Ledger row of a table of noisy counts or proportions of disjoint groups."""
    return [LedgerEntry("laplace", target, float(epsilon), 0.0, 1.0)]
