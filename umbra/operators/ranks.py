"""Global order without a global window: positions and running sums of range-partitioned rows.

Rows are sorted by range, so partition i holds smaller keys than partition i+1. Sums run inside short runs of a partition; only
one row a run (its total and its last row) meets on the driver to be added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import col
from umbra.session import Stages

#: Of monotonically_increasing_id, whose lower 33 bits are the row number within a partition: a run has at most 2^16 rows, all of
#: one partition, and runs are dealt out evenly.
RUN_BITS = 16


def running(df: DataFrame, keys: list[str], weight: Column, stages: Stages, carry: list[str] = (), run: str | None = None) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` (long) over all rows before this one in the order of ``keys``, and for
    each column c of ``carry`` its value one row before as ``prev_c``. Rows should differ in ``keys``: rows with equal
    keys fall into one partition. Nulls come first. ``run`` names a column for the number of the row's run."""
    order = [col(k).asc_nulls_first() for k in keys]
    rows = df.withColumn("__w", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stages.write(rows.withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__run", F.shiftright("__id", RUN_BITS))
    own = Window.partitionBy("__run").orderBy("__id")
    inside = F.coalesce(F.sum("__w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = rows.groupBy("__run").agg(F.sum("__w").alias("total"), *[F.max_by(col(c), "__id").alias(f"last_{c}") for c in carry])
    before, starts, prev = 0, [], [None] * len(carry)
    for r in sorted(last.collect(), key=lambda r: r["__run"]):              # one row a run
        starts.append((r["__run"], before, *prev))
        before, prev = before + r["total"], [r[f"last_{c}"] for c in carry]
    kinds = dict(df.dtypes)
    starts = df.sparkSession.createDataFrame(starts, ", ".join(["__run long", "__start long", *[f"`__last_{c}` {kinds[c]}" for c in carry]]))
    rows = rows.withColumns({"__inside": inside, "__first": F.row_number().over(own) == 1, **{f"__lag_{c}": F.lag(col(c)).over(own) for c in carry}})
    rows = rows.join(F.broadcast(starts), "__run")                          # one row a run
    return rows.select(*[col(c) for c in df.columns], *([F.col("__run").alias(run)] if run else []), (F.col("__start") + F.col("__inside")).alias("before"),
                       *[F.when(F.col("__first"), F.col(f"`__last_{c}`")).otherwise(F.col(f"`__lag_{c}`")).alias(f"prev_{c}") for c in carry])
