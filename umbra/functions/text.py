"""Scalar string/number functions used by cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def null_if_sentinel(c: Column, sentinel: str = "?") -> Column:
    """A sentinel value becomes null."""
    return F.nullif(c, F.lit(sentinel))


def strip_trailing(c: Column, char: str = ".", all_of_them: bool = False) -> Column:
    """C4: remove one trailing ``char`` (or every trailing one, then trim again)."""
    pattern = "\\" + char + ("+$" if all_of_them else "$")
    out = F.regexp_replace(F.trim(c), pattern, "")
    return F.trim(out) if all_of_them else out


def label_encode(c: Column, mapping: dict[str, int]) -> Column:
    """Map labels to integer codes, anything else to null."""
    expr = None
    for label, code in mapping.items():
        expr = (F.when(c == label, F.lit(code)) if expr is None else expr.when(c == label, F.lit(code)))
    return expr.otherwise(F.lit(None)).cast("int")


def bin_label(c: Column, width: int = 10) -> Column:
    """Half-open bin label ``lo-hi`` with ``lo = floor(v/width)*width`` (30..39 -> ``30-40``)."""
    lo = (F.floor(c / F.lit(width)) * F.lit(width)).cast("long")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + F.lit(width)).cast("string"))


def normalize_country(c: Column) -> Column:
    """Trim, ``-`` -> space, ``&`` -> ``and``, drop ``(...)`` greedily, collapse blanks."""
    out = F.replace(F.replace(F.trim(c), F.lit("-"), F.lit(" ")), F.lit("&"), F.lit("and"))
    out = F.regexp_replace(out, r"\(.*\)", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
