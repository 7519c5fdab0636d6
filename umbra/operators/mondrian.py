"""Mondrian multidimensional partitioning for k-anonymity (M1) and l-diversity (M9) on Spark.

Design (all work on executors, nothing whole on the driver):

1. **Compress** the input to weighted tuples ``(qi..., sa, n)``; a hot value becomes one row.
2. **Rounds**: every active partition ``pid`` evaluates *all* its dimensions in one set of
   aggregates over the unpivoted tuples ``(pid, dim, v, g, sa, n)``, read once:
   numeric dims get the exact weighted lower median (A5) with its successor, categorical
   dims the multiway feasibility test over the children ``g`` of the current label (M4/M8).
   The first feasible dimension in the order (stored normalized width desc, QI index asc) is chosen per
   partition with one ``min()`` over ``(-width, dim)`` structs (M2); numeric dims ordered before it are
   tightened to their true bounds (the lazy tightening of M3); partitions with no feasible
   dimension are finished (M5).
3. **Hand-off**: partitions with at most ``local_threshold`` tuples are finished by the same
   rules inside ``groupBy(pid).applyInPandas`` (bounded memory per task, many in parallel).
4. **Labels** (M6): one ``groupBy(class)`` gives numeric ``lo,hi`` and the categorical node.

A categorical QI generalizes along a tree. Without one given, that is ``* -> value``. With one, each
tuple carries the path of its value below the root, so the child of a partition's label that covers a
tuple is the path's next step: no join is needed in a round, and the label is the lowest common ancestor.

Window groups of the median never exceed ``median_window_limit`` distinct values: larger
(pid, dim) groups first narrow an equi-width bucket range around the median position.
Each round's state is cut from the lineage with a reliable checkpoint.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import cloudpickle

from umbra.functions.text import col
from umbra.operators import mondrian_local
from umbra.operators.mondrian_local import LocalSpec, solve_partition
from umbra.operators.profile import leaf_paths
from umbra.schema import PrivacySchema
from umbra.session import Stages, cut_lineage

STAR = "*"
FEW_PIDS = 1_000            # partition ids that a filter names; more are joined

# The in-task solver is shipped inside the task closure, so executors need only numpy/pandas
# (not this package) on their Python path.
cloudpickle.register_pickle_by_value(mondrian_local)


@dataclass
class MondrianResult:
    assignments: DataFrame      # (cls, qi..., [sa], n, lab_j...) one row per compressed tuple
    classes: DataFrame          # (cls, size, lo_i, hi_i, label_i...) one row per equivalence class
    generalized: DataFrame      # (label columns..., [sa], n) the released table in counted form
    schema: PrivacySchema
    ranges: list[float]
    params: dict = field(default_factory=dict)
    stages: Stages | None = None
    trees: dict = field(default_factory=dict)      # QI index -> name of its root, where a tree was given

    def release(self) -> None:
        """Delete the run's stage tables, once the results have been read or written."""
        if self.stages is not None:
            self.stages.release()

    def ncp(self) -> DataFrame:
        """Information loss (%) of the release, one row."""
        return ncp(self.classes, self.schema, self.ranges, self.trees)

    def rows(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Per-record release: every input row gets its class labels (join on the QI tuple)."""
        return generalize_rows(df, self, keep)


@dataclass(frozen=True)
class MondrianSpec:
    schema: PrivacySchema
    k: int | None = None
    l: int | None = None
    guard: bool = True
    local_threshold: int = 16_384
    median_window_limit: int = 200_000
    buckets: int = 1024
    broadcast_rows: int = 200_000       # most decisions (one a partition and dim) that are broadcast

    def __post_init__(self):
        if (self.k is None) == (self.l is None):
            raise ValueError("give exactly one of k (k-anonymity) or l (l-diversity)")
        if self.k is not None and self.k < 1:
            raise ValueError("k must be >= 1")
        if self.l is not None:
            if self.l < 1:
                raise ValueError("l must be >= 1")
            if self.schema.sa is None:
                raise ValueError("l-diversity needs a sensitive attribute")

    @property
    def threshold(self) -> int:
        return self.k if self.k is not None else self.l


# ----------------------------------------------------------------------------------------------
# building blocks (also registered as single operators)
# ----------------------------------------------------------------------------------------------

def compress(df: DataFrame, schema: PrivacySchema) -> DataFrame:
    """Frequency compression: ``(qi..., [sa], n)`` over rows with no null among them. Categorical values
    become text here, once, so that every later step and the in-task solver see the same."""
    cols = schema.columns
    values = qi_values(df.dropna(subset=cols), schema)
    return values.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"))


def qi_values(df: DataFrame, schema: PrivacySchema) -> DataFrame:
    """``df`` with its categorical QIs as text."""
    return df.withColumns({c: col(c).cast("string") for i, c in enumerate(schema.qi) if not schema.is_numeric[i]}) if not all(schema.is_numeric) else df


def domain(members: DataFrame, schema: PrivacySchema, with_tuples: bool = False):
    """A1/A2: (min, max) of each numeric QI, None of a categorical one; one small row.

    With ``with_tuples`` also returns the number of compressed tuples. A numeric QI that is not finite is
    an error: it has no range."""
    aggs = []
    for i, c in enumerate(schema.qi):
        if schema.is_numeric[i]:
            aggs += [F.min(col(c)).cast("double").alias(f"mn{i}"), F.max(col(c)).cast("double").alias(f"mx{i}")]
    row = members.agg(*aggs, F.count(F.lit(1)).alias("tuples")).first()
    if not row["tuples"]:
        return ([], 0) if with_tuples else []
    out = [(row[f"mn{i}"], row[f"mx{i}"]) if schema.is_numeric[i] else None for i in range(len(schema.qi))]
    if any(not math.isfinite(x) for pair in out if pair for x in pair):
        raise ValueError("numeric quasi-identifiers must be finite")
    return (out, row["tuples"]) if with_tuples else out


def value_ranges(dom: list) -> list[float]:
    """Widths that normalize the dims: max - min of a numeric QI, 1 of a categorical one."""
    return [1.0 if pair is None else float(pair[1] - pair[0]) for pair in dom]


def numeric_long(members: DataFrame, schema: PrivacySchema, with_sa: bool = False) -> DataFrame:
    """Unpivot numeric QIs to ``(pid, dim, v, n[, sa])``; one projection, no shuffle."""
    items = [F.struct(F.lit(i).alias("dim"), col(c).cast("double").alias("v"))
             for i, c in enumerate(schema.qi) if schema.is_numeric[i]]
    extra = [col(schema.sa).alias("sa")] if with_sa else []
    return members.select("pid", "n", *extra, F.inline(F.array(*items)))


def categorical_long(members: DataFrame, schema: PrivacySchema, with_sa: bool = False) -> DataFrame:
    items = [F.struct(F.lit(i).alias("dim"), col(c).cast("string").alias("v"))
             for i, c in enumerate(schema.qi) if not schema.is_numeric[i]]
    extra = [col(schema.sa).alias("sa")] if with_sa else []
    return members.select("pid", "n", *extra, F.inline(F.array(*items)))


def frequency_sets(long: DataFrame) -> DataFrame:
    """A4: weighted frequency of every value of every dim of every partition."""
    return long.groupBy("pid", "dim", "v").agg(F.sum("n").alias("c"))


def _median_in_windows(freq: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Exact lower median per (pid, dim) with a window over (bounded) distinct values.

    ``before`` (pid, dim, before, m, lo, hi) restricts each group to [lo, hi] and offsets the
    cumulative count; without it whole groups are used with m = floor(total/2).
    """
    w_ord = Window.partitionBy("pid", "dim").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if before is None:
        f = freq.withColumn("__tot", F.sum("c").over(Window.partitionBy("pid", "dim")))
        f = f.withColumn("__m", F.floor(F.col("__tot") / 2)).withColumn("__before", F.lit(0).cast("long"))
    else:
        f = (freq.join(before, ["pid", "dim"]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
             .withColumnRenamed("m", "__m").withColumnRenamed("before", "__before").drop("lo", "hi"))
    f = f.withColumn("cum", F.col("__before") + F.sum("c").over(w_ord))
    return (f.where(F.col("cum") >= F.col("__m")).groupBy("pid", "dim")
            .agg(F.min(F.struct("v", "cum")).alias("__s"))
            .select("pid", "dim", F.col("__s.v").alias("split"), F.col("__s.cum").alias("left_n")))


def _median_in_one_pass(freq: DataFrame, *more: F.Column) -> DataFrame:
    """All of ``lower_median`` from one window over each group's distinct values."""
    w = Window.partitionBy("pid", "dim")
    f = freq.withColumn("cum", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    f = f.withColumn("m", F.greatest(F.floor(F.sum("c").over(w) / 2), F.lit(1)))
    at, after = F.col("cum") >= F.col("m"), F.col("cum") - F.col("c") >= F.col("m")
    return f.groupBy("pid", "dim").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("nd"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.min(F.when(at, F.col("v"))).alias("split"), F.min(F.when(at, F.col("cum"))).alias("left_n"), F.min(F.when(after, F.col("v"))).alias("nxt"), *more)


def lower_median(freq: DataFrame, window_limit: int | None = 200_000, buckets: int = 1024) -> DataFrame:
    """A5: per (pid, dim): total, distinct count, min, max, split (first value with cumulative
    weight >= floor(total/2)), left_n (cumulative weight at split), nxt (next distinct value).

    ``window_limit`` None: the caller knows that each group's distinct values fit a window."""
    if window_limit is None:
        return _median_in_one_pass(freq)
    freq = cut_lineage(freq)   # reused by stats, median and successor
    stats = freq.groupBy("pid", "dim").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("nd"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    big = stats.where(F.col("nd") > window_limit)
    if big.isEmpty():
        return _median_in_one_pass(freq)
    else:
        small = stats.where(F.col("nd") <= window_limit).select("pid", "dim")
        med_small = _median_in_windows(freq.join(small, ["pid", "dim"], "left_semi"))
        win = big.select("pid", "dim", F.col("vmin").alias("lo"), F.col("vmax").alias("hi"),
                         F.lit(0).cast("long").alias("before"), F.floor(F.col("total") / 2).alias("m"),
                         F.col("nd").alias("cnt"))
        while win.where(F.col("cnt") > window_limit).limit(1).count() > 0:
            done = win.where(F.col("cnt") <= window_limit)
            todo = win.where(F.col("cnt") > window_limit)
            fb = freq.join(todo, ["pid", "dim"]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
            span = F.col("hi") - F.col("lo")
            fb = fb.withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / span * buckets),
                                            F.lit(buckets - 1)).cast("int"))
            bk = fb.groupBy("pid", "dim", "b", "before", "m").agg(
                F.sum("c").alias("bc"), F.count(F.lit(1)).alias("bn"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
            wb = Window.partitionBy("pid", "dim").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            bk = bk.withColumn("bcum", F.col("before") + F.sum("bc").over(wb))
            nxt_win = (bk.where(F.col("bcum") >= F.col("m")).groupBy("pid", "dim")
                       .agg(F.min(F.struct("b", "blo", "bhi", "bcum", "bc", "bn", "m")).alias("x"))
                       .select("pid", "dim", F.col("x.blo").alias("lo"), F.col("x.bhi").alias("hi"),
                               (F.col("x.bcum") - F.col("x.bc")).alias("before"), F.col("x.m").alias("m"),
                               F.col("x.bn").alias("cnt")))
            win = cut_lineage(done.unionByName(nxt_win))
        med_big = _median_in_windows(freq.join(big.select("pid", "dim"), ["pid", "dim"], "left_semi"),
                                     win.select("pid", "dim", "before", "m", "lo", "hi"))
        # materialized: a union of two window outputs must not be read as co-partitioned
        med = cut_lineage(med_small.unionByName(med_big))
    # successor of the split value: smallest value above it (a plain conditional aggregate)
    nxt = (freq.join(med.select("pid", "dim", "split"), ["pid", "dim"]).where(F.col("v") > F.col("split"))
           .groupBy("pid", "dim").agg(F.min("v").alias("nxt")))
    return stats.join(med, ["pid", "dim"], "left").join(nxt, ["pid", "dim"], "left")


def l_diverse(size: F.Column, n_sa: F.Column, max_sa: F.Column, l: int) -> F.Column:
    """Frequency l-diversity of one group (size >= l, >= l SA values, max share <= 1/l)."""
    return (size >= l) & (n_sa >= l) & (max_sa * l <= size)


def _sa_groups(long_sa: DataFrame, keys: list[str], l: int) -> DataFrame:
    per_sa = long_sa.groupBy(*keys, "sa").agg(F.sum("n").alias("c"))
    return per_sa.groupBy(*keys).agg(
        l_diverse(F.sum("c"), F.count(F.lit(1)), F.max("c"), l).alias("ok"))


# ----------------------------------------------------------------------------------------------
# one round
# ----------------------------------------------------------------------------------------------

def state_columns(schema: PrivacySchema, trees=()) -> list[str]:
    """What a tuple knows of its partition: bounds of numeric QIs, label (null: the root), depth and width of others."""
    out = []
    for i in range(len(schema.qi)):
        out += [f"lo_{i}", f"hi_{i}"] if schema.is_numeric[i] else [f"lab_{i}", f"dep_{i}", f"wd_{i}"] if i in trees else [f"lab_{i}"]
    return out


def root_state(schema: PrivacySchema, dom: list, trees=()) -> list[F.Column]:
    """The state of the whole table; ``dom`` as from ``domain``."""
    out = []
    for i in range(len(schema.qi)):
        if schema.is_numeric[i]:
            out += [F.lit(float(dom[i][0])).alias(f"lo_{i}"), F.lit(float(dom[i][1])).alias(f"hi_{i}")]
        else:
            out.append(F.lit(None).cast("string").alias(f"lab_{i}"))
            if i in trees:
                out += [F.lit(0).alias(f"dep_{i}"), F.lit(1.0).alias(f"wd_{i}")]
    return out


def _width(i: int, schema: PrivacySchema, ranges: list, trees) -> F.Column:
    """Normalized width of a QI in a tuple's partition."""
    if schema.is_numeric[i]:
        return (F.col(f"hi_{i}") - F.col(f"lo_{i}")) / F.lit(ranges[i]) if ranges[i] > 0 else F.lit(0.0)
    return F.col(f"wd_{i}") if i in trees else F.when(F.col(f"lab_{i}").isNull(), 1.0).otherwise(0.0)


def _child(i: int, schema: PrivacySchema, trees) -> F.Column:
    """The child of the partition's label that covers a tuple's value; null below a leaf."""
    if i in trees:
        return F.get(F.col(f"path_{i}"), F.col(f"dep_{i}"))
    return F.when(F.col(f"lab_{i}").isNull(), col(schema.qi[i]).cast("string"))


def dimensions(members: DataFrame, spec: MondrianSpec, ranges: list, trees=(), windows_fit: bool = False) -> DataFrame:
    """pid, dim, w, feas, limit, and of numeric dims vmin, vmax, split, nxt: all dims of all active partitions.
    ``limit``: the largest k for which the (guarded) split is allowed; null for l.

    ``members`` carry their partition's state. ``windows_fit``: no numeric QI has more distinct values (by
    sensitive value, for l) than a window may hold.
    """
    schema = spec.schema
    is_l = spec.l is not None
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    items = [F.struct(F.lit(i).alias("dim"), _width(i, schema, ranges, trees).cast("double").alias("w"),
                      (col(c).cast("double") if schema.is_numeric[i] else none).alias("v"),
                      (text if schema.is_numeric[i] else _child(i, schema, trees)).alias("g")) for i, c in enumerate(schema.qi)]
    extra = [col(schema.sa).alias("sa")] if is_l else []
    keys = ["pid", "dim", "v", "g", *(["sa"] if is_l else [])]
    # ``is_num`` is an aggregate: a filter on it stays above the exchange, which both branches then share
    freq = members.select("pid", "n", *extra, F.inline(F.array(*items))).groupBy(*keys).agg(
        F.sum("n").alias("c"), F.max("w").alias("w"), F.max(F.col("v").isNotNull()).alias("is_num"))
    parts = []
    if any(schema.is_numeric):
        parts.append(_numeric(freq.where("is_num"), spec, windows_fit))
    if not all(schema.is_numeric):
        cat = freq.where("NOT is_num")
        if is_l:
            cat = cat.groupBy("pid", "dim", "g", "sa").agg(F.sum("c").alias("c"), F.max("w").alias("w")).groupBy("pid", "dim", "g").agg(
                l_diverse(F.sum("c"), F.count(F.lit(1)), F.max("c"), spec.l).alias("ok"), F.max("w").alias("w"), F.lit(None).cast("long").alias("c"))
        else:
            cat = cat.select("pid", "dim", "g", (F.col("c") >= spec.k).alias("ok"), "w", F.when(F.col("g").isNull(), 0).otherwise(F.col("c")).alias("c"))
        parts.append(cat.groupBy("pid", "dim").agg(F.max("w").alias("w"), F.min(F.col("ok") & F.col("g").isNotNull()).alias("feas"), F.min("c").alias("limit")).select(
            "pid", "dim", "w", "feas", "limit", *[none.alias(x) for x in ("vmin", "vmax", "split", "nxt")]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _numeric(freq: DataFrame, spec: MondrianSpec, windows_fit: bool) -> DataFrame:
    """Split and feasibility of every numeric dim of every partition (M3, M7)."""
    is_l = spec.l is not None
    if not is_l and windows_fit:
        med = _median_in_one_pass(freq, F.max("w").alias("w"))
        ok = F.col("total") - F.col("left_n") >= spec.k if spec.guard else F.lit(True)
    elif windows_fit:
        # rows of one value stand together in the range frame; all that follows keeps the window's partitioning
        w = Window.partitionBy("pid", "dim")
        f = freq.withColumn("cum", F.sum("c").over(w.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        f = f.withColumn("total", F.sum("c").over(w))
        f = f.withColumn("split", F.min(F.when(F.col("cum") >= F.greatest(F.floor(F.col("total") / 2), F.lit(1)), F.col("v"))).over(w))
        med = _sides(f.withColumn("low", F.col("v") <= F.col("split")), spec.l)
        ok = F.col("both")
    else:
        per = freq.groupBy("pid", "dim", "v").agg(F.sum("c").alias("c"), F.max("w").alias("w"))
        med = lower_median(per.select("pid", "dim", "v", "c"), spec.median_window_limit, spec.buckets)
        ok = F.col("total") - F.col("left_n") >= spec.k if spec.guard else F.lit(True)
        if is_l:
            f = freq.join(med.select("pid", "dim", "total", "split"), ["pid", "dim"])
            med, ok = _sides(f.withColumn("low", F.col("v") <= F.col("split")), spec.l), F.col("both")
        else:
            med = med.join(per.groupBy("pid", "dim").agg(F.max("w").alias("w")), ["pid", "dim"])
    feas = (F.floor(F.col("total") / 2) >= spec.threshold) & F.col("nxt").isNotNull() & ok
    limit = F.lit(None).cast("long") if is_l else F.when(F.col("nxt").isNull(), 0).otherwise(F.least(F.floor(F.col("total") / 2), F.col("total") - F.col("left_n"))).cast("long")
    return med.select("pid", "dim", "w", F.coalesce(feas, F.lit(False)).alias("feas"), limit.alias("limit"), "vmin", "vmax", "split", "nxt")


def _sides(f: DataFrame, l: int) -> DataFrame:
    """Both halves of each numeric split, and whether they are l-diverse."""
    per = f.groupBy("pid", "dim", "total", "split", "low", "sa").agg(F.sum("c").alias("c"), F.max("w").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))
    side = per.groupBy("pid", "dim", "total", "split", "low").agg(
        l_diverse(F.sum("c"), F.count(F.lit(1)), F.max("c"), l).alias("ok"), F.max("w").alias("w"), F.min("a").alias("a"), F.max("b").alias("b"))
    return side.groupBy("pid", "dim").agg(
        F.max("total").alias("total"), F.max("split").alias("split"), F.min("ok").alias("both"), F.max("w").alias("w"), F.min("a").alias("vmin"),
        F.max("b").alias("vmax"), F.min(F.when(~F.col("low"), F.col("a"))).alias("nxt"))


def evaluate_round(members: DataFrame, spec: MondrianSpec, ranges: list, trees=(), windows_fit: bool = False) -> DataFrame:
    """One decision row per partition: pid, chosen dim ``ch`` (null = finished) with ``ch_negw``, and
    vmin/vmax/split/nxt of each numeric dim."""
    dims = dimensions(members, spec, ranges, trees, windows_fit)
    aggs = [F.min(F.when(F.col("feas"), F.struct((-F.col("w")).alias("negw"), "dim"))).alias("ch")]
    for i in range(len(spec.schema.qi)):
        if spec.schema.is_numeric[i]:
            aggs += [F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}_{i}") for c in ("vmin", "vmax", "split", "nxt")]
    out = dims.groupBy("pid").agg(*aggs)
    return out.withColumns({"ch_negw": F.col("ch.negw"), "ch": F.col("ch.dim")})


def _range_of(pid: F.Column) -> tuple[F.Column, F.Column]:
    """The first and last k that a partition of ``k_profile`` stands for, as its id says."""
    return F.split(pid, ":")[1].cast("int"), F.split(pid, ":")[2].cast("int")


def evaluate_ranges(members: DataFrame, spec: MondrianSpec, ranges: list, trees=(), windows_fit: bool = False) -> DataFrame:
    """Like ``evaluate_round`` for every k of a partition's range at once: a row for each part [k_lo, k_hi] of it that
    takes the same dim. In order of width, a dim is taken by the k above the limits of all dims before it, up to its own."""
    dims = dimensions(members, spec, ranges, trees, windows_fit)
    numeric = [i for i in range(len(spec.schema.qi)) if spec.schema.is_numeric[i]]
    aggs = [F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("negw"), "dim", F.coalesce("limit", F.lit(0)).cast("int").alias("limit")))).alias("order")]    # one element a dim
    aggs += [F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}_{i}") for i in numeric for c in ("vmin", "vmax", "split", "nxt")]
    out = dims.groupBy("pid").agg(*aggs)
    lo, hi = _range_of(F.col("pid"))
    out = out.withColumns({"lo": lo, "hi": hi})
    none = "array<struct<k_lo:int,k_hi:int,ch:int,ch_negw:double>>"

    def take(acc, x):
        upto = F.least(x["limit"], F.col("hi"))
        part = F.struct((acc["done"] + 1).alias("k_lo"), upto.alias("k_hi"), x["dim"].alias("ch"), x["negw"].alias("ch_negw"))
        return F.struct(F.greatest(acc["done"], upto).alias("done"), F.when(upto > acc["done"], F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    start = F.struct((F.col("lo") - 1).alias("done"), F.array().cast(none).alias("parts"))
    last = F.struct((F.col("got.done") + 1).alias("k_lo"), F.col("hi").alias("k_hi"), F.lit(None).cast("int").alias("ch"), F.lit(None).cast("double").alias("ch_negw"))
    out = out.withColumn("got", F.aggregate("order", start, take))
    out = out.withColumn("part", F.explode(F.when(F.col("got.done") < F.col("hi"), F.concat("got.parts", F.array(last))).otherwise(F.col("got.parts"))))
    return out.select("pid", "part.*", *[f"{c}_{i}" for i in numeric for c in ("vmin", "vmax", "split", "nxt")])


def _child_pid(parent: F.Column, dim: F.Column, branch: F.Column) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", parent, dim.cast("string"), branch), 256), 1, 32)


def _routed(members: DataFrame, decisions: DataFrame, spec: MondrianSpec, ranges: list, trees, carried: list[str], trace: bool = False) -> DataFrame:
    """Every tuple with the partition it goes to and that partition's state; ``done``: it stays.

    A numeric dim tried before the chosen one (or in a finished partition) gets its true bounds."""
    schema = spec.schema
    m = members.join(decisions, "pid")
    branch = F.lit(None).cast("string")
    for i, c in enumerate(schema.qi):
        b = F.when(col(c).cast("double") <= F.col(f"split_{i}"), F.lit("L")).otherwise(F.lit("R")) if schema.is_numeric[i] else _child(i, schema, trees)
        branch = F.when(F.col("ch") == i, b).otherwise(branch)
    m = m.withColumn("branch", branch).withColumn("done", F.col("ch").isNull())
    pid = F.when(F.col("done"), F.col("pid")).otherwise(_child_pid(F.col("pid"), F.col("ch"), F.col("branch")))
    if "k_lo" in decisions.columns:
        pid = F.concat_ws(":", F.split(pid, ":")[0], F.col("k_lo"), F.col("k_hi"))
    cols = [pid.alias("pid"), "done", *[col(c) for c in carried]]
    for i in range(len(schema.qi)):
        here = F.coalesce(F.col("ch") == i, F.lit(False))
        if schema.is_numeric[i]:
            left, w = F.col("branch") == "L", -_width(i, schema, ranges, trees)
            tight = F.col("done") | (w < F.col("ch_negw")) | ((w == F.col("ch_negw")) & (F.lit(i) < F.col("ch")))
            cols += [F.when(here, F.when(left, F.col(f"vmin_{i}")).otherwise(F.col(f"nxt_{i}"))).when(tight, F.col(f"vmin_{i}")).otherwise(F.col(f"lo_{i}")).alias(f"lo_{i}"),
                     F.when(here, F.when(left, F.col(f"split_{i}")).otherwise(F.col(f"vmax_{i}"))).when(tight, F.col(f"vmax_{i}")).otherwise(F.col(f"hi_{i}")).alias(f"hi_{i}")]
        else:
            cols.append(F.when(here, F.col("branch")).otherwise(F.col(f"lab_{i}")).alias(f"lab_{i}"))
            if i in trees:
                cols += [F.when(here, F.col(f"dep_{i}") + 1).otherwise(F.col(f"dep_{i}")).alias(f"dep_{i}"),
                         F.when(here, F.get(F.col(f"widths_{i}"), F.col(f"dep_{i}") + 1)).otherwise(F.col(f"wd_{i}")).alias(f"wd_{i}")]
    if trace:
        cols.append(F.when(F.col("done"), F.col("above")).otherwise(F.concat("above", F.array("pid"))).alias("above"))
    return m.select(*cols)


# ----------------------------------------------------------------------------------------------
# driver loop
# ----------------------------------------------------------------------------------------------

def with_paths(members: DataFrame, schema: PrivacySchema, hierarchies: dict[str, DataFrame], stages: Stages) -> tuple[DataFrame, dict[int, str]]:
    """``members`` with path_i and widths_i of each QI that has a tree (child, parent), and the trees' root names.

    The join is a plain equi-join with one row a leaf. A value that is no leaf, or a tree with several roots, is an error."""
    trees: dict[int, str] = {}
    for name, edges in hierarchies.items():
        if name not in schema.qi or name in schema.numeric:
            raise ValueError(f"a hierarchy needs a categorical quasi-identifier: {name}")
        i = schema.qi.index(name)
        leaves = stages.write(leaf_paths(edges.select(F.lit(name).alias("attr"), col("child").cast("string").alias("child"), col("parent").cast("string").alias("parent"))))
        roots = [r[0] for r in leaves.select("root").distinct().limit(2).collect()]
        if len(roots) != 1:
            raise ValueError(f"the hierarchy of {name} must have exactly one root")
        trees[i] = roots[0]
        leaves = leaves.select(F.col("value").alias("__value"), F.col("path").alias(f"path_{i}"), F.col("widths").alias(f"widths_{i}"))
        members = members.join(leaves, col(name) == F.col("__value"), "left").drop("__value")
    return members, dict(sorted(trees.items()))


def mondrian(df: DataFrame, spec: MondrianSpec, hierarchies: dict[str, DataFrame] | None = None, k_max: int | None = None,
             trace: bool = False) -> MondrianResult:
    """M1 / M9: partition ``df`` into equivalence classes and return assignments, classes and release.

    ``hierarchies``: for categorical QIs, the edges (child, parent) of the tree to generalize along; others go
    from ``*`` to the value. Each tuple carries the bounds and labels of its partition, so a round is one query:
    decide for every partition, join the decisions (one row a partition) to the tuples, and write the tuples
    with their children's bounds. Every round splits or finishes each partition, so rounds end by themselves. The
    root is always decided in a round; a later partition of at most ``local_threshold`` tuples is
    finished by the same rules inside one task.

    ``k_max``: answers every k from ``spec.k`` to it (see ``k_profile``): a partition stands for a range of k, and a tuple goes
    on once for each part of the range that takes another dim. ``trace``: assignments and classes have ``above``, the ids of the
    partitions that were split to get to the class, the root first. Ids are digests of the way there, so they
    do not depend on where a partition was split.
    """
    schema = spec.schema
    schema.validate(df)
    spark = df.sparkSession
    d = len(schema.qi)
    evaluate = evaluate_round if k_max is None else evaluate_ranges
    stages = Stages(spark)
    base, trees = with_paths(compress(df, schema), schema, hierarchies or {}, stages)
    base = stages.write(base)
    dom, n_tuples = domain(base, schema, with_tuples=True)
    if trees and n_tuples and (bad := base.where(" OR ".join(f"path_{i} IS NULL" for i in trees)).first()) is not None:
        raise ValueError(f"a value is no leaf of its hierarchy: {[bad[schema.qi[i]] for i in trees if bad[f'path_{i}'] is None]}")
    carried = [f.name for f in base.schema.fields]
    values = [c for c in carried if c not in {f"{x}_{i}" for i in trees for x in ("path", "widths")}]
    traced = ["above"] if trace else []
    labels = [c for c in state_columns(schema, trees) if c.startswith(("lab_", "wd_"))]
    assign_schema = T.StructType([base.schema[c] for c in values] + [T.StructField("cls", T.StringType())]
                                 + [T.StructField(c, T.DoubleType() if c.startswith("wd_") else T.StringType()) for c in labels]
                                 + [T.StructField(c, T.ArrayType(T.StringType())) for c in traced])
    if not dom:
        return _finish(spark.createDataFrame([], assign_schema), spec, [0.0] * d, stages, trees)
    ranges = value_ranges(dom)
    numeric = [i for i in range(d) if schema.is_numeric[i]]
    # children have no more distinct values than the root
    windows_fit = n_tuples <= spec.median_window_limit
    if numeric and not windows_fit:
        seen = [F.struct(col(schema.qi[i]), col(schema.sa)) if spec.l is not None else col(schema.qi[i]) for i in numeric]
        counts = base.agg(*[F.approx_count_distinct(x, 0.02).alias(f"n{j}") for j, x in enumerate(seen)]).first()
        windows_fit = max(counts) * 1.1 <= spec.median_window_limit
    members = base.select(F.lit("r" if k_max is None else f"r:{spec.k}:{k_max}").alias("pid"), *[col(c) for c in carried], *root_state(schema, dom, trees),
                          *[F.array().cast("array<string>").alias(c) for c in traced])
    finished, handoff, n_parts = [], [], 1
    while n_parts:
        decisions = evaluate(members, spec, ranges, trees, windows_fit)
        if n_parts * d <= spec.broadcast_rows:
            decisions = F.broadcast(decisions)
        routed = stages.write(_routed(members, decisions, spec, ranges, trees, carried, trace))
        finished.append(routed.where("done").select(F.col("pid").alias("cls"), *[col(c) for c in values], *labels, *traced))
        open_ = routed.where("not done").drop("done")
        large = open_.groupBy("pid").agg(F.count(F.lit(1)).alias("tuples")).where(F.col("tuples") > spec.local_threshold)
        pids = [r["pid"] for r in large.select("pid").limit(FEW_PIDS + 1).collect()]
        n_parts = len(pids)
        if not n_parts:
            handoff.append(open_)
        elif n_parts <= FEW_PIDS:
            handoff.append(open_.where(~F.col("pid").isin(pids)))
            members = open_.where(F.col("pid").isin(pids))
        else:
            large = stages.write(large.select("pid"))
            n_parts = large.count()
            few = F.broadcast(large) if n_parts <= spec.broadcast_rows else large
            handoff.append(open_.join(few, "pid", "left_anti"))
            members = open_.join(few, "pid", "left_semi")

    assignments = None
    for f in finished:
        f = f.select(*[col(c.name) for c in assign_schema.fields])
        assignments = f if assignments is None else assignments.unionByName(f)
    lspec = LocalSpec(qi=tuple(schema.qi), numeric=tuple(schema.is_numeric), ranges=tuple(ranges), k=spec.k, l=spec.l, guard=spec.guard,
                      sa=schema.sa, trees=tuple(trees), ranged=k_max is not None, trace=trace)
    rest = handoff[0]
    for h in handoff[1:]:
        rest = rest.unionByName(h)
    assignments = assignments.unionByName(rest.groupBy("pid").applyInPandas(lambda pdf: solve_partition(pdf, lspec), assign_schema))
    return _finish(stages.write(assignments), spec, ranges, stages, trees)


def _num_label(lo: F.Column, hi: F.Column) -> F.Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit(","), hi.cast("string")))


def _finish(assignments: DataFrame, spec: MondrianSpec, ranges: list[float], stages: Stages, trees: dict[int, str]) -> MondrianResult:
    schema = spec.schema
    aggs = [F.sum("n").alias("size")]
    for i, c in enumerate(schema.qi):
        if schema.is_numeric[i]:
            aggs += [F.min(col(c)).alias(f"lo_{i}"), F.max(col(c)).alias(f"hi_{i}")]
        else:
            aggs.append(F.max(f"lab_{i}").alias(f"lab_{i}"))
            if i in trees:
                aggs.append(F.max(f"wd_{i}").alias(f"wd_{i}"))
    if "above" in assignments.columns:
        aggs.append(F.max("above").alias("above"))
    if spec.l is not None:
        per_sa = assignments.groupBy("cls", col(schema.sa).alias("__sa")).agg(F.sum("n").alias("__c"))
        div = per_sa.groupBy("cls").agg(F.count(F.lit(1)).alias("distinct_sa"), F.max("__c").alias("max_sa_count"))
    classes = assignments.groupBy("cls").agg(*aggs)
    labels = []
    for i, c in enumerate(schema.qi):
        if schema.is_numeric[i]:
            labels.append(_num_label(F.col(f"lo_{i}"), F.col(f"hi_{i}")).alias(c))
        else:
            labels.append(F.coalesce(F.col(f"lab_{i}"), F.lit(trees.get(i, STAR))).alias(c))
    classes = classes.select("*", *[lb.alias(f"label_{i}") for i, lb in enumerate(labels)])
    if spec.l is not None:
        classes = classes.join(div, "cls")
    label_map = classes.select("cls", *[F.col(f"label_{i}").alias(c) for i, c in enumerate(schema.qi)])
    sa = [col(schema.sa)] if schema.sa else []
    generalized = (assignments.select("cls", *sa, "n").join(label_map, "cls")
                   .groupBy(*[col(c) for c in schema.qi], *sa).agg(F.sum("n").alias("n")))
    return MondrianResult(assignments, classes, generalized, schema, ranges,
                          dict(k=spec.k, l=spec.l, guard=spec.guard), stages, trees)


def ncp(classes: DataFrame, schema: PrivacySchema, ranges: list[float], trees=(), by: list[str] = ()) -> DataFrame:
    """100 * sum_P |P| * sum_i w_i(P) / (d * N); numeric w = (max-min)/range (0 for a constant
    QI), categorical w = the share of all leaves below the label (1 for the root, 0 for a leaf)."""
    d = len(schema.qi)
    ws = []
    for i in range(d):
        if schema.is_numeric[i]:
            rng = ranges[i]
            ws.append(((F.col(f"hi_{i}") - F.col(f"lo_{i}")).cast("double") / F.lit(rng)) if rng > 0 else F.lit(0.0))
        else:
            ws.append(_width(i, schema, ranges, trees))
    total_w = ws[0]
    for w in ws[1:]:
        total_w = total_w + w
    return classes.groupBy(*by).agg(
        (F.lit(100.0) * F.sum(F.col("size") * total_w) / (F.lit(float(d)) * F.sum("size"))).alias("ncp"),
        F.count(F.lit(1)).alias("n_classes"), F.min("size").alias("min_class_size"), F.sum("size").alias("n_records"))


def generalize_rows(df: DataFrame, result: MondrianResult, keep: list[str] | None = None) -> DataFrame:
    """M6 per record: join every complete input row to its class labels on the QI tuple (+SA).

    A plain equi-join: AQE broadcasts the tuple map when it measures small, otherwise a
    sort-merge join whose hot keys AQE splits.
    """
    schema = result.schema
    keys = schema.columns
    label_map = (result.assignments.select("cls", *[col(c) for c in keys])
                 .join(result.classes.select("cls", *[F.col(f"label_{i}").alias(f"__g{i}") for i in range(len(schema.qi))]),
                       "cls"))
    base = qi_values(df.dropna(subset=keys), schema)
    out = base.join(label_map, keys)
    sel = [F.col(f"__g{i}").alias(c) for i, c in enumerate(schema.qi)]
    if schema.sa:
        sel.append(col(schema.sa))
    sel += [col(c) for c in (keep or [])]
    return out.select(*sel)


def k_anonymize(df: DataFrame, schema: PrivacySchema, k: int = 10, guard: bool = True, hierarchies=None, trace: bool = False, **kw) -> MondrianResult:
    """M1."""
    return mondrian(df, MondrianSpec(schema=schema, k=k, guard=guard, **kw), hierarchies, trace=trace)


def l_diversify(df: DataFrame, schema: PrivacySchema, l: int = 2, hierarchies=None, **kw) -> MondrianResult:
    """M9."""
    return mondrian(df, MondrianSpec(schema=schema, l=l, **kw), hierarchies)


# ----------------------------------------------------------------------------------------------
# every k at once
# ----------------------------------------------------------------------------------------------

@dataclass
class KProfile:
    """Releases for every k of a range, from one run: a class is valid for the k from ``k_lo`` to ``k_hi``."""

    result: MondrianResult
    k_min: int
    k_max: int

    def classes(self, k: int | None = None) -> DataFrame:
        lo, hi = _range_of(F.col("cls"))
        rows = self.result.classes.withColumns({"k_lo": lo, "k_hi": hi})
        if self.result.classes.columns and k is not None:
            rows = rows.where((F.col("k_lo") <= k) & (F.col("k_hi") >= k))
        return rows

    def losses(self, ks: list[int] | None = None) -> DataFrame:
        """k, ncp, n_classes, min_class_size, n_records for every k (or the given ones)."""
        wanted = F.sequence(F.col("k_lo"), F.col("k_hi")) if ks is None else F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (k >= F.col("k_lo")) & (k <= F.col("k_hi")))
        rows = self.classes().select("*", F.explode(wanted).alias("k"))      # a class for each k of a declared range
        return ncp(rows, self.result.schema, self.result.ranges, self.result.trees, by=["k"])

    def diversity(self) -> DataFrame:
        """k, min_distinct_sa: the fewest sensitive values of a class, for every k."""
        per = self.result.assignments.groupBy("cls").agg(F.count_distinct(col(self.result.schema.sa)).alias("d"))
        lo, hi = _range_of(F.col("cls"))
        return per.select("d", F.explode(F.sequence(lo, hi)).alias("k")).groupBy("k").agg(F.min("d").alias("min_distinct_sa"))

    def release(self, k: int) -> DataFrame:
        """The counted release of one k: labels, sensitive value, n."""
        if not self.k_min <= k <= self.k_max:
            raise ValueError(f"the profile answers k from {self.k_min} to {self.k_max}")
        schema = self.result.schema
        labels = self.classes(k).select("cls", *[F.col(f"label_{i}").alias(c) for i, c in enumerate(schema.qi)])
        sa = [col(schema.sa)] if schema.sa else []
        return self.result.assignments.select("cls", *sa, "n").join(labels, "cls").groupBy(*[col(c) for c in schema.qi], *sa).agg(F.sum("n").alias("n"))


def k_profile(df: DataFrame, schema: PrivacySchema, k_min: int, k_max: int, hierarchies=None, **kw) -> KProfile:
    """the guarded k-anonymous releases of all k from ``k_min`` to ``k_max`` in one run.

    Which dim a partition takes depends on k only through the limits of its splits, so a partition decides for its whole
    range at once; a tuple is held once for each range of k that treats it alike, at most once a k."""
    if not 1 <= k_min <= k_max:
        raise ValueError("a profile needs 1 <= k_min <= k_max")
    return KProfile(mondrian(df, MondrianSpec(schema=schema, k=k_min, **kw), hierarchies, k_max), k_min, k_max)
