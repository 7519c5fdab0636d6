"""Release policies (F4) and presets (F5), as tables that releases are checked and scaled against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from umbra.functions.noise import NoiseKey
from umbra.operators.mondrian import KProfile, k_anonymize, k_profile
from umbra.operators.noisy import LedgerEntry
from umbra.operators.tree_counts import noisy_release
from umbra.schema import PrivacySchema

# Total epsilon of each privacy level.
PRIVACY_LEVELS = {"VERY_HIGH": 0.01, "HIGH": 0.1, "MEDIUM": 0.5, "LOW": 1.0, "VERY_LOW": 5.0}

# How the mechanisms share a budget, and sensitivities by column.
MECHANISM_SHARES = {"laplace": 0.3, "exponential": 0.1, "above_threshold": 0.1}
DEFAULT_SENSITIVITY = {"age": 80.0, "salary": 100000.0, "hours": 100.0}
CREDIT_SENSITIVITY = {"age": 80.0, "annual_income": 100000.0, "credit_limit": 50000.0, "credit_utilization": 100.0}

# Presets -> (level, delta, sensitivities); the level overrides any caller epsilon.
PRESETS = {
    "high_privacy": ("VERY_HIGH", 0.0, DEFAULT_SENSITIVITY),
    "balanced": ("MEDIUM", 0.0, DEFAULT_SENSITIVITY),
    "utility_focused": ("LOW", 0.0, DEFAULT_SENSITIVITY),
    "credit_scoring": ("MEDIUM", 0.0, CREDIT_SENSITIVITY),
    "research_dataset": ("HIGH", 1e-6, DEFAULT_SENSITIVITY),
}

# The defaults of a combined policy.
POLICY_DEFAULTS = {
    "k": 5, "l": 2, "epsilon": 0.3, "delta": 0.0, "max_loss_percent": 30.0, "noise_after_grouping": True,
    "quasi_identifiers": ("age", "occupation", "education", "marital_status"), "sensitive": ("income", "capital_gain", "capital_loss"),
}
#: What each setting must satisfy, in words and as a test.
RULES = (
    ("k", "groups need at least one record", lambda v: v >= 1),
    ("l", "groups need at least one sensitive value", lambda v: v >= 1),
    ("epsilon", "the noise budget is above 0", lambda v: v > 0),
    ("delta", "delta is a probability below 1", lambda v: 0 <= v < 1),
    ("max_loss_percent", "a share of lost information lies between 0 and 100", lambda v: 0 <= v <= 100),
    ("quasi_identifiers", "name at least one quasi-identifier", lambda v: len(v) > 0),
)


def policy(**settings) -> dict:
    """a combined policy: the defaults with ``settings`` put over them, checked against RULES."""
    unknown = set(settings) - set(POLICY_DEFAULTS)
    if unknown:
        raise ValueError(f"a policy has no setting {sorted(unknown)}")
    out = POLICY_DEFAULTS | settings
    broken = [f"{name}={out[name]!r}: {words}" for name, words, holds in RULES if not holds(out[name])]
    if broken:
        raise ValueError("; ".join(broken))
    return out


def gate(ncp: DataFrame, rules: dict) -> DataFrame:
    """information loss of a release (column ``ncp``, percent) with whether the policy accepts it."""
    return ncp.withColumn("accepted", F.col("ncp") <= F.lit(float(rules["max_loss_percent"])))


def preset(name: str) -> dict:
    """one preset as parameters. The mechanisms share the level's total epsilon, so that a release
    with all of them spends no more than it."""
    if name not in PRESETS:
        raise ValueError(f"{name!r} is none of the presets {', '.join(sorted(PRESETS))}")
    level, delta, sens = PRESETS[name]
    total, parts = PRIVACY_LEVELS[level], sum(MECHANISM_SHARES.values())
    return {"preset": name, "privacy_level": level, "total_epsilon": total, "delta": delta,
            **{f"epsilon_{m}": total * s / parts for m, s in MECHANISM_SHARES.items()}, "sensitivities": dict(sens)}


def presets_frame(spark: SparkSession) -> DataFrame:
    """F5 as a lookup table (one row a preset: safe to broadcast)."""
    columns = ["preset", "privacy_level", "total_epsilon", "delta", *(f"epsilon_{m}" for m in MECHANISM_SHARES), "sensitivities"]
    return spark.createDataFrame(
        [tuple(preset(name)[c] for c in columns) for name in PRESETS],
        "preset string, privacy_level string, total_epsilon double, delta double, " + ", ".join(f"epsilon_{m} double" for m in MECHANISM_SHARES)
        + ", sensitivities map<string,double>")


class PolicyRefused(ValueError):
    """No k that a policy allows keeps the loss within its limit."""


def policy_schema(df: DataFrame, rules: dict) -> PrivacySchema:
    """The quasi-identifiers and the first sensitive attribute of a policy that ``df`` has, numeric ones by their type."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    qi = [c for c in rules["quasi_identifiers"] if c in df.columns]
    sa = [c for c in rules["sensitive"] if c in df.columns and c not in qi]
    return PrivacySchema(qi=qi, numeric=[c for c in qi if c in numeric], sa=sa[0] if sa else None)


def enforce(df: DataFrame, rules: dict, k_max: int = 50, hierarchies: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """F4 in action: the release with the largest k from the policy's own to ``k_max`` whose loss stays within its limit and whose
    classes all hold ``l`` sensitive values, and the losses of every k with ``accepted`` and ``chosen``. All k come from one run. If no
    k is accepted, there is no release."""
    profile, losses, best = _accepted(df, rules, k_max, hierarchies)
    return profile.release(best), losses


def enforce_with_noise(df: DataFrame, rules: dict, noise: NoiseKey, k_max: int = 50, hierarchies: dict | None = None) -> tuple[DataFrame, list[LedgerEntry]]:
    """The same policy with ``noise_after_grouping``: classes of the accepted k with counts that have the policy's epsilon of noise
    and are consistent along the splits; without it, the exact counted release. Both with their ledger rows."""
    profile, _, best = _accepted(df, rules, k_max, hierarchies)
    if not rules["noise_after_grouping"]:
        return profile.release(best), []
    profile.result.release()
    return noisy_release(k_anonymize(df, policy_schema(df, rules), k=best, hierarchies=hierarchies, trace=True), rules["epsilon"], noise)


def decisions(df: DataFrame, rules: dict, k_max: int, hierarchies: dict | None = None) -> tuple[KProfile, DataFrame, int | None]:
    """The run over all k, the losses of every k with ``accepted`` and ``chosen``, and the chosen k, None if no k is accepted."""
    schema = policy_schema(df, rules)
    profile = k_profile(df, schema, rules["k"], max(k_max, rules["k"]), hierarchies)
    losses = gate(profile.losses(), rules)
    if rules["l"] > 1 and schema.sa:
        losses = losses.join(profile.diversity(), "k").withColumn("accepted", F.col("accepted") & (F.col("min_distinct_sa") >= rules["l"])).drop("min_distinct_sa")
    best = losses.where("accepted").agg(F.max("k")).first()[0]
    return profile, losses.withColumn("chosen", F.lit(False) if best is None else F.col("k") == F.lit(best)), best


def _accepted(df: DataFrame, rules: dict, k_max: int, hierarchies: dict | None) -> tuple[KProfile, DataFrame, int]:
    profile, losses, best = decisions(df, rules, k_max, hierarchies)
    if best is None:
        profile.result.release()
        raise PolicyRefused(f"no k from {rules['k']} on keeps the loss within {rules['max_loss_percent']} percent and {rules['l']} sensitive values in each class")
    return profile, losses, best
