"""Helpers shared by the text operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401  (re-exported)

#: Rows of one Arrow batch sent to a Python worker: a batch of ordinary texts is a few MB, and one of
#: texts of 100 KB stays below 30 MB.
BATCH_ROWS = 256


def by_value(module_name: str) -> None:
    """Let tasks get the functions of a module by value, so executors need no install of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, and with them the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no model may learn labels from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def spread(doc_id: Column, seed: int = 0) -> Column:
    """A uniform value in [0, 1) from an id, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: higher-order functions would compute an outer
    expression again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``_row`` beside the named columns, so that none of its names clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])
