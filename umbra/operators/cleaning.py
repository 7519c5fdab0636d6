"""Cleaning and generalization of raw census-style records.

``clean`` is one lazy plan: a single projection for trimming and sentinels,
a label encode, a null filter that Catalyst pushes toward the scan, the
decade bin, and the distinct-value continent lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from umbra.functions.countries import continent_lookup
from umbra.functions.text import bin_label, col, label_encode, null_if_sentinel, strip_trailing

# Fixed values of the census cleaning.
SENTINEL_COLUMNS = ["workclass", "occupation", "native-country"]
DROPPED_COLUMNS = ["fnlwgt"]
INCOME_CODES = {"<=50K": 0, ">50K": 1}
CRITICAL_COLUMNS = ["age", "sex", "marital-status", "occupation", "native-country", "income"]


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column in one projection."""
    return df.select(*[
        F.trim(col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else col(f.name)
        for f in df.schema.fields
    ])


def nullify_sentinels(df: DataFrame, columns: list[str] = SENTINEL_COLUMNS, sentinel: str = "?") -> DataFrame:
    """Sentinel -> null on the listed columns that are present."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: null_if_sentinel(col(c), sentinel) for c in present}) if present else df


def drop_columns(df: DataFrame, columns: list[str] = DROPPED_COLUMNS) -> DataFrame:
    """C3."""
    return df.drop(*[c for c in columns if c in df.columns])


def encode_label(df: DataFrame, column: str = "income", mapping: dict[str, int] = INCOME_CODES,
                 strip_all: bool = False) -> DataFrame:
    """C4 + C5: strip the trailing period then map labels to codes (unknown -> null)."""
    return df.withColumn(column, label_encode(strip_trailing(col(column), ".", strip_all), mapping))


def drop_unknown_label(df: DataFrame, column: str = "income") -> DataFrame:
    """C6."""
    return df.where(col(column).isNotNull())


def drop_critical_nulls(df: DataFrame, critical: list[str] = CRITICAL_COLUMNS) -> DataFrame:
    """Drop rows with a null in the critical set (only the columns present)."""
    return df.dropna(subset=[c for c in critical if c in df.columns])


def drop_any_nulls(df: DataFrame) -> DataFrame:
    """The strict variant (any null drops the row)."""
    return df.dropna("any")


def add_age_group(df: DataFrame, source: str = "age", out: str = "age_group", width: int = 10) -> DataFrame:
    """C9."""
    return df.withColumn(out, bin_label(col(source), width))


def add_continent(df: DataFrame, source: str = "native-country", out: str = "continent_code") -> DataFrame:
    """C10-C14 over distinct values, joined back."""
    return continent_lookup(df, source, out)


def clean(df: DataFrame, drop_policy: str = "critical", label: str = "income",
          generalize: bool = True) -> DataFrame:
    """Trim -> '?' to null -> drop fnlwgt -> label encode -> null filter -> age_group -> continent.

    ``drop_policy='critical'`` is the Spark cleaner (C7); ``'any'`` is the strict one (C8,
    evaluated before dropping ``fnlwgt`` so a null there also drops the row).
    """
    out = nullify_sentinels(trim_strings(df))
    if drop_policy == "any":
        out = drop_columns(drop_any_nulls(encode_label(out, label, strip_all=True)))
    elif drop_policy == "critical":
        out = drop_critical_nulls(encode_label(drop_columns(out), label))
    else:
        raise ValueError(f"unknown drop_policy {drop_policy!r}")
    if generalize:
        out = add_continent(add_age_group(out))
    return out
