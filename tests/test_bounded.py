"""Person-level bounds, unknown groups and private quantiles against plain versions and their guarantees."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey
from umbra.operators import bounded as B
from umbra.operators import ranks
from umbra.operators.ranks import running
from umbra.session import Stages, cut_lineage

KEY = NoiseKey("test secret", "bounded")


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [("hot", i, f"g{r.randint(0, 5)}", r.uniform(-50, 150)) for i in range(3000)]           # a third of all rows
    data += [(f"p{r.randint(0, 900)}", i, f"g{r.randint(0, 5)}", r.uniform(-50, 150)) for i in range(3000, 9000)]
    return data, spark.createDataFrame(data, "person string, id long, grp string, x double").repartition(6)


@pytest.mark.parametrize("m", [1, 4, 2000])
def test_bound_rows(spark, rows, m):
    data, df = rows
    got = B.bound_rows(df, "person", "id", m, KEY).collect()
    drawn = {r.id: r.u for r in df.select("id", KEY.uniform(B.bound_purpose(m), "person", "id").alias("u")).collect()}
    want = defaultdict(list)
    for person, i, _, _ in data:
        want[person].append((drawn[i], i))
    assert {r.id for r in got} == {i for own in want.values() for _, i in sorted(own)[:m]} and len({r.id for r in got}) == len(got)
    again = B.bound_rows(df.repartition(3, "grp"), "person", "id", m, KEY)
    assert {r.id for r in again.collect()} == {r.id for r in got}


def test_bounding_meets_no_whole_person_in_one_task(rows):
    """Each window sees at most m rows of a task, or of a slice, for a person."""
    plan = B.bound_rows(rows[1], "person", "id", 3, KEY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_one_person_changes_sums_by_the_sensitivity(spark, rows):
    _, df = rows
    m, lo, hi = 3, -10.0, 100.0
    exact = lambda d: {r.grp: r.true_sum for r in B.person_sum(d, ["grp"], "x", "person", "id", m, lo, hi, 1.0, KEY, diagnostic=True)[0].collect()}
    full = exact(df)
    for person in ("hot", "p1", "p2"):
        less = exact(df.where(F.col("person") != person))
        assert sum(abs(full[g] - less.get(g, 0)) for g in full) <= B.sum_sensitivity(m, lo, hi) + 1e-6
    assert B.sum_sensitivity(2, -5, 5) == 20 and B.sum_sensitivity(2, 3, 5) == 10
    count = lambda d: {r.grp: r.true_count for r in B.person_count(d, ["grp"], "person", "id", m, 1.0, KEY, diagnostic=True)[0].collect()}
    with_, without = count(df), count(df.where("person <> 'hot'"))
    assert sum(abs(with_[g] - without.get(g, 0)) for g in with_) == m


def test_domains(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("c", 4, "x"), ("a", 2, None), ("b", 3, "z")], "person string, id int, grp string")
    for domain in (["x", "y", None], spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "grp string")):
        got = {r.grp: r.true_count for r in B.person_count(df, ["grp"], "person", "id", 5, 1.0, KEY, domain, diagnostic=True)[0].collect()}
        assert got == {"x": 2, "y": 0, None: 1}
    got = B.person_proportion(df, ["grp"], F.col("id") > 0, "person", "id", 5, 1000.0, KEY, ["x", "y"])[0].collect()
    assert {r.grp: r.noisy_proportion and round(r.noisy_proportion) for r in got} == {"x": 1, "y": None}
    assert B.person_count(df.limit(0), ["grp"], "person", "id", 5, 1.0, KEY, ["x"])[0].count() == 1
    with pytest.raises(Exception, match="noise key is null"):
        B.bound_rows(spark.createDataFrame([(None, 1)], "person string, id int"), "person", "id", 1, KEY).collect()


def test_lone_groups_are_released_with_probability_delta(spark):
    """20,000 groups of one person each: the share released is the per-group delta, and one of many persons passes."""
    n, m, epsilon, delta = 20_000, 1, 1.0, 0.02
    lone = spark.range(n).selectExpr("concat('p', id) AS person", "concat('g', id) AS grp")
    many = spark.range(200).selectExpr("concat('q', id) AS person", "'common' AS grp")
    got, entries = B.unknown_groups(lone.union(many), ["grp"], "person", m, epsilon, delta, KEY)
    found = {r.grp for r in got.collect()}
    assert "common" in found and entries[0].delta == delta
    share = (len(found) - 1) / n
    assert share <= delta + 4 * math.sqrt(delta * (1 - delta) / n) and share > delta / 2
    # with m groups a person, any of them shows with probability delta at most
    t = B.selection_threshold(5, 1.0, 1e-4)
    p = 0.5 * math.exp(-(t - 1) / 5)
    assert 1 - (1 - p) ** 5 == pytest.approx(1e-4)


def test_running_sums(spark):
    r = random.Random(1)
    data = [(r.randint(0, 4), i, r.randint(1, 9)) for i in range(500)] + [(None, i, 2) for i in range(250)]
    df = spark.createDataFrame(data, "a int, b int, w int").repartition(7)
    got = running(df, ["a", "b"], F.col("w"), Stages(spark), carry=["b"]).collect()
    total, last = 0, None
    want = {}
    for a, b, w in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want[a, b] = (total, last)
        total, last = total + w, b
    assert len(got) == len(data) and all(want[x.a, x.b] == (x.before, x.prev_b) for x in got)
    assert running(df.limit(0), ["a", "b"], F.col("w"), Stages(spark)).count() == 0


def test_quantiles(spark, rows):
    data, df = rows
    lo, hi, qs = -60.0, 160.0, [0.0, 0.25, 0.5, 0.9, 1.0]
    got, entries = B.private_quantiles(df, "x", qs, lo, hi, 2.0, KEY, by=["grp"])
    got = {(r.grp, r.q): r.noisy_quantile for r in got.collect()}
    groups = defaultdict(list)
    for _, _, g, x in data:
        groups[g].append(min(max(x, lo), hi))
    assert len(got) == len(groups) * len(qs) and entries[0].epsilon == 10.0
    for (g, q), answer in got.items():
        values = sorted(groups[g])
        rank = sum(v <= answer for v in values)
        low = sum(v < answer for v in values)
        assert low - 60 <= q * len(values) <= rank + 60 and lo <= answer <= hi, (g, q, answer)
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "grp string, x double")
    assert [r.grp for r in B.private_quantiles(nulls, "x", [0.5], 0.0, 9.0, 1.0, KEY, by=["grp"])[0].collect()] == [None]
    assert B.private_quantiles(nulls.limit(0), "x", [0.5], 0.0, 9.0, 1.0, KEY)[0].count() == 0
    one = spark.createDataFrame([(5.0,)] * 400, "x double")
    assert abs(B.private_quantiles(one, "x", [0.5], 0.0, 10.0, 1.0, KEY)[0].first()[1] - 5) <= 5
    for bad in (dict(quantiles=[1.2]), dict(quantiles=[]), dict(quantiles=[0.5], lo=3.0, hi=3.0)):
        with pytest.raises(ValueError):
            B.private_quantiles(one, "x", **{"lo": 0.0, "hi": 1.0, "epsilon": 1.0, "noise": KEY, **bad})


def test_quantile_frequencies(spark):
    """Over many releases the intervals are drawn as the exponential mechanism says."""
    values, lo, hi, epsilon, n = [1.0, 2.0, 2.0, 7.0], 0.0, 10.0, 1.0, 3000
    copies = spark.range(n).selectExpr("id AS rel", f"explode(array({', '.join(map(str, values))})) AS x")
    got = Counter()
    for r in B.private_quantiles(copies, "x", [0.5], lo, hi, epsilon, KEY, by=["rel"])[0].collect():
        got[sum(v < r.noisy_quantile for v in values)] += 1
    w = {0: 1 * math.exp(-epsilon / 2 * 2), 1: 1 * math.exp(-epsilon / 2 * 1), 3: 5 * math.exp(-epsilon / 2 * 1), 4: 3 * math.exp(-epsilon / 2 * 2)}
    for rank, x in w.items():
        p = x / sum(w.values())
        assert abs(got[rank] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n), rank


def test_a_group_of_quantiles_is_never_one_task(spark, rows, monkeypatch):
    """Many runs of the order give the same answers as one; intervals move by run and are not sorted, however few groups there are."""
    df = rows[1].withColumn("grp", F.when(F.col("grp") != "g0", F.col("grp")))
    ask = lambda: sorted(map(str, B.private_quantiles(df, "x", [0.1, 0.5], -60.0, 160.0, 2.0, KEY, by=["grp"])[0].collect()))
    want, plans = ask(), []
    monkeypatch.setattr(ranks, "RUN_BITS", 4, raising=False)
    monkeypatch.setattr(B, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut_lineage(df))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ask() == want and len(want) == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joined = [x for x in plans[0].splitlines() if "SortMergeJoin" in x]
    assert len(joined) == 1 and "__run" in joined[0] and "SortAggregate" not in plans[0]
