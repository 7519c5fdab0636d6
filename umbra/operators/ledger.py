"""Privacy ledger: what each release spent.

A ledger is a small DataFrame ``(release_id, mechanism, target, epsilon, delta, sensitivity,
released_values)``; ``released_values`` is measured on the release itself, so the ledger
reflects what was actually published.

Losses add up (sequential composition), or are composed as Renyi divergences: every row has a curve over
``ORDERS``, curves add, and the sum is turned into an epsilon at a chosen delta.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.text import col
from umbra.operators.noisy import LedgerEntry

LEDGER_SCHEMA = ("release_id string, mechanism string, target string, epsilon double, delta double, "
                 "sensitivity double")
_ENTRY_FIELDS = "release_id: string, mechanism: string, target: string, epsilon: double, delta: double, sensitivity: double"
ENTRY_FILE = re.compile(r"entry-([0-9]{9,})\.json")
#: Orders of the Renyi curves.
ORDERS = (*(1 + x / 20 for x in range(1, 20)), *(2 + x / 4 for x in range(0, 32)), *range(10, 64), *(64 * 2 ** (x / 4) for x in range(0, 29)))


class BudgetExceeded(ValueError):
    pass


class ReleaseReused(ValueError):
    pass


class LedgerDamaged(ValueError):
    pass


def refuse_reuse(ledger: DataFrame, release_id: str) -> None:
    """A release id fixes the noise, so it must not be released a second time."""
    if not ledger.where(F.col("release_id") == release_id).isEmpty():
        raise ReleaseReused(f"{release_id!r} is in the ledger; take a new release id")


def ledger_frame(spark: SparkSession, entries: list[LedgerEntry], release_id: str) -> DataFrame:
    rows = [(release_id, e.mechanism, e.target, float(e.epsilon), float(e.delta),
             None if e.sensitivity is None else float(e.sensitivity)) for e in entries]
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def measured_ledger(release: DataFrame, entries: list[LedgerEntry], release_id: str) -> DataFrame:
    """Ledger rows joined with the number of non-null released values per target (one aggregate)."""
    spark = release.sparkSession
    led = ledger_frame(spark, entries, release_id)
    targets = [e.target for e in entries if e.target in release.columns]
    if not targets:
        return led.withColumn("released_values", F.lit(None).cast("long"))
    counts = release.agg(*[F.count(col(t)).alias(t) for t in targets])
    items = [F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("long").alias("released_values")) for t in targets]
    return led.join(counts.select(F.inline(F.array(*items))), "target", "left")


def budget_status(ledger: DataFrame, budget: float) -> DataFrame:
    """Per mechanism allocated, spent (sequential composition), remaining = max(0, budget - spent)."""
    return ledger.groupBy("mechanism").agg(
        F.sum("epsilon").alias("epsilon_spent"), F.count(F.lit(1)).alias("num_queries"),
    ).select("mechanism", F.lit(float(budget)).alias("epsilon_allocated"), "epsilon_spent",
             F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("epsilon_spent")).alias("epsilon_remaining"),
             "num_queries")


def renyi_loss(mechanism: Column, epsilon: Column, delta: Column, order: Column) -> Column:
    """Renyi divergence of one release at an order above 1.

    Laplace: its closed form. Gaussian: order / (2 sigma^2) for the sigma that D4 takes from (epsilon, delta). Others
    are only known to be epsilon-private: the least of epsilon, order epsilon^2 / 2 and, for the
    exponential mechanism, order epsilon^2 / 8 (its range is bounded)."""
    a, e = order, epsilon
    # log of a/(2a-1) exp((a-1)e) + (a-1)/(2a-1) exp(-ae), by its larger term
    laplace = e + (F.log(a / (2 * a - 1)) + F.log1p((a - 1) / a * F.exp(-(2 * a - 1) * e))) / (a - 1)
    gaussian = a * e * e / (4 * F.log(F.lit(1.25) / delta))
    pure = F.least(e, a * e * e / 2)
    return (F.when((mechanism == "gaussian") & (delta > 0), gaussian).when((mechanism == "laplace") & (delta == 0), F.least(laplace, pure))
            .when(mechanism == "exponential", F.least(pure, a * e * e / 8)).when(delta == 0, pure))


def renyi_curve(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order, loss: the composed curve of the ledger's releases. A release that is no Renyi mechanism (a delta of
    another kind than the Gaussian's) makes its curve null."""
    e, d, m = F.col("epsilon").cast("double"), F.coalesce(F.col("delta").cast("double"), F.lit(0.0)), F.col("mechanism")
    rows = ledger.select(*(by or []), m, e.alias("epsilon"), d.alias("delta"), F.explode(F.array(*[F.lit(float(x)) for x in ORDERS])).alias("order"))
    loss = renyi_loss(F.col("mechanism"), F.col("epsilon"), F.col("delta"), F.col("order"))
    return rows.withColumn("loss", loss).groupBy(*(by or []), "order").agg(F.when(F.count_if(F.col("loss").isNull()) == 0, F.sum("loss")).alias("loss"))


def composed_epsilon(ledger: DataFrame, delta: float, by: list[str] | None = None) -> DataFrame:
    """Releases, epsilon_sequential, epsilon_composed: what all releases lose together at ``delta``.

    The curve is turned into epsilon by the least over the orders of
    loss + log((order-1)/order) - (log delta + log order)/(order-1). Plain addition counts too, if all deltas together stay
    within ``delta``."""
    if not 0 < delta < 1:
        raise ValueError("a composed loss needs 0 < delta < 1")
    o = F.col("order")
    at = F.col("loss") + F.log((o - 1) / o) - (F.lit(math.log(delta)) + F.log(o)) / (o - 1)
    best = renyi_curve(ledger, by).groupBy(*(by or [])).agg(F.min(F.when(at.isNotNull(), F.greatest(at, F.lit(0.0)))).alias("renyi"))
    total = ledger.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("releases"), F.coalesce(F.sum("epsilon"), F.lit(0.0)).alias("epsilon_sequential"),
                                            F.coalesce(F.sum("delta"), F.lit(0.0)).alias("deltas"))
    both = total.join(best, by, "left") if by else total.crossJoin(F.broadcast(best))      # one row each
    plain = F.when(F.col("deltas") <= delta, F.col("epsilon_sequential"))
    return both.select(*(by or []), "releases", "epsilon_sequential", F.least(plain, F.col("renyi")).alias("epsilon_composed"))


def check_budget(ledger: DataFrame, budget: float, requested: float = 0.0, enforce: bool = True, delta: float | None = None) -> float:
    """Raise before a release when spent + requested would exceed the budget; returns spent. With ``delta`` what
    was spent is the composed loss at it."""
    if delta is not None:
        got = composed_epsilon(ledger, delta).first()
        spent = got["epsilon_composed"] if got["releases"] else 0.0
        if spent is None:
            raise BudgetExceeded(f"the releases together have no bound at delta {delta}")
    else:
        spent = ledger.agg(F.coalesce(F.sum("epsilon"), F.lit(0.0)).alias("s")).first()["s"]
    if enforce and spent + requested > budget + 1e-12:
        raise BudgetExceeded(f"the release asks for epsilon {requested:.6f}, but {budget - spent:.6f} of {budget:.6f} is left")
    return spent


def privacy_report(ledger: DataFrame) -> DataFrame:
    """epsilon of each mechanism and target, with the values it released if they were measured, and the total."""
    extra = [F.sum("released_values").alias("released_values")] if "released_values" in ledger.columns else []
    per = ledger.groupBy("mechanism", "target").agg(F.sum("epsilon").alias("epsilon"), *extra)
    total = ledger.agg(F.sum("epsilon").alias("total_epsilon"), F.count(F.lit(1)).alias("mechanisms_registered"))
    return per.crossJoin(F.broadcast(total))        # one row of totals


# ---- the stored ledger ---------------------------------------------------------------------------------

def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """number, digest and text of each entry file; None if there is no ledger."""
    fs, folder = _file_system(spark, path)
    if not fs.exists(folder):
        return None
    files = [(x.getPath().getName(), x.getLen()) for x in fs.listStatus(folder) if not x.getPath().getName().startswith((".", "_"))]
    strange = sorted(name for name, size in files if not size or not ENTRY_FILE.fullmatch(name))     # readers skip empty files
    if strange:
        raise LedgerDamaged(f"the ledger folder holds files that are no entries: {strange[:5]}")
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "entry-*.json").text(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), ENTRY_FILE.pattern, 1).cast("long")
    return rows.select(number.alias("number"), F.sha2("value", 256).alias("digest"), "value")


def _entries(spark: SparkSession, path: str) -> tuple[DataFrame, int, str]:
    """Ledger rows, number of entries and digest of the last one. Anything missing or altered is an error."""
    files = _stored(spark, path)
    if files is None:
        return spark.createDataFrame([], LEDGER_SCHEMA), 0, ""
    rows = files.select("number", "digest", F.from_json("value", f"previous string, entries array<struct<{_ENTRY_FIELDS}>>", {"mode": "FAILFAST"}).alias("j"))
    rows = rows.select("number", "digest", "j.previous", "j.entries")
    try:
        chain = sorted(tuple(r) for r in rows.select("number", "digest", "previous", F.size("entries")).collect())      # a few words a release
    except Exception as exc:
        raise LedgerDamaged("an entry of the ledger cannot be read") from exc
    before = ""
    for at, (number, digest, previous, size) in enumerate(chain):
        if number != at + 1 or previous != before or not size or size < 1:
            raise LedgerDamaged(f"entry {at + 1} of the ledger is missing or was altered")
        before = digest
    return rows.select(F.explode("entries").alias("e")).select("e.*"), len(chain), before


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; empty only if its folder does not exist or holds nothing. A ledger that cannot be read,
    lacks an entry or was altered is an error: it must not pass for an unspent budget."""
    return _entries(spark, path)[0]


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file only if it is absent, whole or not at all; False if it exists.

    A complete temporary file is linked (local files) or renamed without overwriting (a store's own atomic
    rename) to its name."""
    fs, target = _file_system(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(hidden.toUri().getPath(), target.toUri().getPath())
        else:
            jvm = spark._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(hidden, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as exc:
        if "FileAlreadyExists" in str(exc.java_exception):
            return False
        raise
    finally:
        fs.delete(hidden, False)


def commit(entries: DataFrame, path: str, budget: float | None = None, delta: float | None = None, reuse: bool = False) -> int:
    """Enters a release in the stored ledger, if the budget allows it; returns the number of its entry.

    The ledger is a chain of files ``entry-<number>.json``, each with the digest of the one before, and each created only
    if absent. Budget and release ids are checked against exactly the entries before it: whoever loses the
    race for a number reads the ledger again, with the winner's entry, and checks again. So of two releases that
    together overspend, one is refused. ``delta``: the budget holds for the composed (epsilon, delta) loss.
    ``reuse``: entries of known releases are left as they are (a replay)."""
    spark = entries.sparkSession
    new = [r.asDict() for r in entries.select(*[f.split()[0] for f in LEDGER_SCHEMA.split(", ")]).collect()]      # one release
    ids = sorted({r["release_id"] for r in new})
    frame = spark.createDataFrame([tuple(r.values()) for r in new], LEDGER_SCHEMA)
    fs, folder = _file_system(spark, path)
    fs.mkdirs(folder) if not fs.exists(folder) else None
    while True:
        earlier, n, digest = _entries(spark, path)
        known = {r["release_id"] for r in earlier.where(F.col("release_id").isin(ids)).select("release_id").distinct().collect()}
        if known and not reuse:
            raise ReleaseReused(f"{sorted(known)} are in the ledger; take a new release id")
        if known == set(ids):
            return n
        if budget is not None:
            check_budget(earlier.unionByName(frame), budget, delta=delta)
        if _create(spark, f"{path.rstrip('/')}/entry-{n + 1:09d}.json", json.dumps({"previous": digest, "entries": [r for r in new if r["release_id"] not in known]})):
            return n + 1


def store_ledger(entries: DataFrame, path: str) -> None:
    """Adds the rows of a release to the stored ledger, without a budget."""
    commit(entries, path)
