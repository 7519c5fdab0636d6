"""Word arrays, word-window hashes and other column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text that is not null, in order; an empty array if there are none."""
    return F.array_remove(F.split(text, SPLIT), "")


def window_hashes(words_col: Column, width: int) -> Column:
    """One 64-bit hash for each run of ``width`` consecutive words; none for shorter texts.

    ``words_col`` must be a plain column (or a lambda's variable): it is looked up once for each run.
    """
    n = F.size(words_col)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)),
                                          lambda i: F.xxhash64(F.slice(words_col, i, width)))
                  ).otherwise(F.array().cast("array<bigint>"))
