import math

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from umbra.functions.noise import NoiseKey, laplace
from umbra.operators import noisy as N
from umbra.operators.ledger import BudgetExceeded, ReleaseReused, check_budget, ledger_frame, refuse_reuse
from umbra.operators.selection import exponential_select, exponential_weights, randomize_sa
from umbra.operators.threshold import above_threshold, noisy_count
from umbra.plans.policy import PRESETS, policy, preset

KEY = NoiseKey("test secret", "test")


def test_laplace_statistics(spark):
    b, n = 2.0, 200_000
    df = spark.range(n).select(laplace(KEY.uniform("stat", F.col("id")), b).alias("x"))
    r = df.agg(F.avg("x").alias("m"), F.variance("x").alias("v"), F.expr("percentile(abs(x), 0.5)").alias("med")).first()
    assert abs(r["m"]) < 4 * b * math.sqrt(2.0 / n)
    assert abs(r["v"] - 2 * b * b) / (2 * b * b) < 0.03
    assert abs(r["med"] - b * math.log(2)) < 0.03                     # median of |Lap(b)| = b ln 2


def test_noise_independent_of_partitioning(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    a = {r[0]: r[1] for r in N.add_laplace(df.repartition(3), "o_totalprice", 1.0, 1.0, "o_orderkey", KEY)
         .select("o_orderkey", "o_totalprice").collect()}
    b = {r[0]: r[1] for r in N.add_laplace(df.repartition(7), "o_totalprice", 1.0, 1.0, "o_orderkey", KEY)
         .select("o_orderkey", "o_totalprice").collect()}
    assert a == b


def test_gumbel_matches_softmax(spark):
    n = 20000
    cands = spark.range(n).select(F.col("id").cast("string").alias("selection_id")).select(
        "selection_id", F.explode(F.array(*[F.struct(F.lit(o).alias("option"), F.lit(u).alias("utility"))
                                           for o, u in [("a", 3.0), ("b", 2.0), ("c", 0.0)]])).alias("x")
    ).select("selection_id", "x.option", "x.utility")
    sel = exponential_select(cands, 1.0, 0.5, KEY).groupBy("selected").count().collect()
    freq = {r["selected"]: r["count"] / n for r in sel}
    w = {r["option"]: r["probability"] for r in exponential_weights(cands.where("selection_id = '0'"), 1.0, 0.5).collect()}
    for o in w:
        assert abs(freq.get(o, 0) - w[o]) < 0.015


def test_errors(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        N.add_laplace(df, "id", 1.0, 0.0, "id", KEY)
    with pytest.raises(ValueError):
        N.add_laplace(df, "id", -1.0, 1.0, "id", KEY)
    with pytest.raises(ValueError):
        N.add_gaussian(df, "id", 1.0, 1.0, 1.5, "id", KEY)
    with pytest.raises(ValueError):
        preset("nope")
    with pytest.raises(ValueError):
        N.noisy_columns(df.withColumn("s", F.lit("x")), ["s"], 1.0, "id", KEY)
    led = ledger_frame(spark, [N.LedgerEntry("laplace", "a", 0.6)], "r")
    with pytest.raises(BudgetExceeded):
        check_budget(led, 1.0, requested=0.5)
    assert check_budget(led, 1.0, requested=0.4) == pytest.approx(0.6)


def test_counts_and_thresholds(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    c = noisy_count(ev, ["event_type"], 1.0, KEY, total=ev.count(), domain=ev.select("event_type")).collect()
    assert all(0 <= r["noisy_count"] <= ev.count() for r in c)
    q = spark.range(50).select(F.lit("b").alias("batch_id"), F.col("id").alias("query_id"), (F.col("id") * 10.0).alias("value"))
    a = above_threshold(q, 100.0, 500.0, KEY, mode="svt", max_positives=2, diagnostic=True).where("above").collect()
    assert len(a) == 2 and all(r["value"] >= 50 for r in a)


def test_randomized_response_keeps_domain(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).cast("string").alias("sa"))
    out = randomize_sa(df, "sa", 1.0, "id", KEY).collect()
    assert {r["sa"] for r in out} <= {"0", "1", "2"}
    changed = sum(1 for r in out if r["sa"] != str(r["id"] % 3)) / 2000
    expect = 1 - math.e / (math.e + 2)
    assert abs(changed - expect) < 0.04


def test_releases_are_independent(spark):
    """Two releases of one column: the noise does not cancel, whatever epsilon, release or secret differs."""
    df = spark.range(4000).select("id", F.lit(10.0).alias("x"))
    one = dict(N.add_laplace(df, "x", 1.0, 0.1, "id", KEY).collect())
    others = [N.add_laplace(df, "x", 1.0, 0.2, "id", KEY), N.add_laplace(df, "x", 1.0, 0.1, "id", KEY.release("second")),
              N.add_laplace(df, "x", 1.0, 0.1, "id", NoiseKey("other secret", "test")), N.add_gaussian(df, "x", 1.0, 0.1, 1e-5, "id", KEY)]
    for other in others:
        pairs = [(one[i] - 10, y - 10) for i, y in other.collect()]
        n = len(pairs)
        mx, my = (sum(p[k] for p in pairs) / n for k in (0, 1))
        sx, sy = (math.sqrt(sum((p[k] - m) ** 2 for p in pairs) / n) for k, m in ((0, mx), (1, my)))
        corr = sum((x - mx) * (y - my) for x, y in pairs) / (n * sx * sy)
        assert abs(corr) < 0.08, corr


def test_noise_keys(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("1", "23"), ("12", "3")], "x string, y string")
    assert df.select(KEY.uniform("p", "x", "y").alias("u")).distinct().count() == 4
    with pytest.raises(Exception, match="noise key is null"):
        spark.createDataFrame([(None, 1.0)], "id long, x double").select(KEY.uniform("p", "id")).collect()
    with pytest.raises(ValueError):
        NoiseKey("", "r")
    led = ledger_frame(spark, [N.LedgerEntry("laplace", "a", 0.6)], "r")
    refuse_reuse(led, "s")
    with pytest.raises(ReleaseReused):
        refuse_reuse(led, "r")


def test_exact_values_are_not_released(spark):
    df = spark.createDataFrame([("b", 1, 5.0, 1.0)], "batch_id string, query_id int, value double, sensitivity double")
    assert "value" not in above_threshold(df, 1.0, 1.0, KEY).columns
    assert "value" not in N.laplace_batch(df, 1.0, KEY).columns
    assert "value" not in N.laplace_mechanism(df, "value", 1.0, 1.0, "query_id", KEY)[0].columns
    assert noisy_count(df, ["batch_id"], 1.0, KEY).columns == ["batch_id", "noisy_count"]


def test_null_groups_are_counted(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] * 2, "k string")
    dom = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    got = {r["k"]: r["true_count"] for r in noisy_count(df, ["k"], 1.0, KEY, domain=dom, diagnostic=True).collect()}
    assert got == {None: 3, "a": 2, "b": 0}


def test_adaptive_never_overspends(spark):
    q = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "query_id int")
    for expected, admitted in ((1, 1), (2, 1), (3, 1), (4, 4), (9, 5)):
        got = N.adaptive_epsilon(q, 0.6, expected=expected)
        assert got.where("admitted").count() == admitted
        assert (got.agg(F.sum("epsilon")).first()[0] or 0) <= 0.6 + 1e-12


def test_sparse_vector_reads_its_source_a_fixed_number_of_times(spark):
    q = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(F.lit("b").alias("batch_id"), F.col("o_orderkey").alias("query_id"), F.col("o_totalprice").alias("value"))
    plans = [above_threshold(q, 200_000.0, 1.0, KEY, max_positives=c)._jdf.queryExecution().optimizedPlan().toString().count("parquet") for c in (1, 3, 50)]
    assert plans[0] == plans[1] == plans[2] <= 2
    with pytest.raises(ValueError):
        above_threshold(q, 1.0, 1.0, KEY, delta=1e-5, mode="svt")


def test_presets_spend_their_total():
    for name in PRESETS:
        p = preset(name)
        assert sum(p[f"epsilon_{m}"] for m in ("laplace", "exponential", "above_threshold")) == pytest.approx(p["total_epsilon"])
    with pytest.raises(ValueError):
        policy(k=0)
    with pytest.raises(ValueError):
        policy(colour="red")


def test_wide_sensitive_domain(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("sa"))
    out = randomize_sa(df, "sa", 1.0, "id", KEY).collect()
    assert len(out) == 3000 and sum(r["sa"] != str(r["id"]) for r in out) > 2900 and {r["sa"] for r in out} <= {str(i) for i in range(3000)}


def test_every_mechanism_enters_the_ledger(spark):
    from umbra.operators.ledger import budget_status, privacy_report
    from umbra.operators.selection import selection_entry
    from umbra.operators.threshold import count_entry, threshold_entry
    entries = selection_entry(0.1, 3) + threshold_entry(0.2) + count_entry(0.3, "noisy_count")
    led = ledger_frame(spark, entries, "r")
    spent = {r["mechanism"]: r["epsilon_spent"] for r in budget_status(led, 1.0).collect()}
    assert spent == pytest.approx({"exponential": 0.3, "above_threshold": 0.2, "laplace": 0.3})
    assert privacy_report(led).first()["total_epsilon"] == pytest.approx(0.8)


def test_no_plan_holds_the_secret(spark):
    """Every mechanism: neither the analyzed, optimized nor executed plan, nor an error, names the secret."""
    from umbra.operators.threshold import noisy_proportion
    key = NoiseKey("do not print me", "r")
    df = spark.range(20).select("id", F.lit(10.0).alias("x"), F.lit("b").alias("batch_id"), F.col("id").alias("query_id"), F.col("id").cast("double").alias("value"),
                                F.lit(1.0).alias("sensitivity"), (F.col("id") % 3).cast("string").alias("sa"))
    cands = df.selectExpr("'s' AS selection_id", "id AS option", "x AS utility")
    frames = [N.add_laplace(df, "x", 1.0, 1.0, "id", key), N.add_gaussian(df, "x", 1.0, 1.0, 1e-5, "id", key), N.laplace_batch(df, 1.0, key),
              N.exact_release(df, "x", 1.0, 1.0, "id", key)[0], N.exact_release(df, "x", 1.0, 1.0, "id", key, delta=1e-5)[0],
              exponential_select(cands, 1.0, 1.0, key), randomize_sa(df, "sa", 1.0, "id", key), above_threshold(df, 5.0, 1.0, key), noisy_count(df, ["sa"], 1.0, key),
              noisy_proportion(df, F.col("x") > 1, 1.0, key)]
    for frame in frames:
        assert frame.collect()
        plan = frame._jdf.queryExecution()
        for text in (plan.toString(), plan.logical().toString(), plan.executedPlan().treeString()):
            assert key.secret not in text


def test_discrete_laplace_is_exact(spark):
    """Bit for bit the plain version, and the frequencies of exp(-|x|/scale)."""
    from collections import Counter
    from fractions import Fraction
    from umbra.functions.noise import discrete_laplace, discrete_laplace_of
    scale, n = Fraction(5, 2), 40_000
    got = {r.id: r.x for r in spark.range(n).select("id", discrete_laplace(KEY, "p", scale, "id").alias("x")).collect()}
    assert all(got[i] == discrete_laplace_of(KEY, "p", scale, i) for i in range(0, n, 97))
    q = math.exp(-1 / float(scale))
    seen = Counter(got.values())
    for x in range(-8, 9):
        p = (1 - q) / (1 + q) * q ** abs(x)
        assert abs(seen[x] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n), x
    assert max(abs(x) for x in got.values()) < 60


def test_discrete_gaussian_is_exact(spark):
    from collections import Counter
    from fractions import Fraction
    from umbra.functions.noise import discrete_gaussian, discrete_gaussian_of, gaussian_digits
    sigma, n = Fraction(17, 5), 40_000
    got = {r.id: r.x for r in spark.range(n).withColumn("u", gaussian_digits(KEY, "p", sigma, "id")).select("id", discrete_gaussian("u", sigma).alias("x")).collect()}
    assert all(got[i] == discrete_gaussian_of(KEY, "p", sigma, i) for i in range(0, n, 97))
    w = {x: math.exp(-x * x / (2 * float(sigma) ** 2)) for x in range(-60, 61)}
    seen, total = Counter(got.values()), sum(w.values())
    for x in range(-10, 11):
        p = w[x] / total
        assert abs(seen[x] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n), x


def test_exact_release_grid(spark):
    df = spark.createDataFrame([(1, 10.1, 7), (2, None, None)], "id int, x double, n bigint")
    got = {r.id: r for r in N.exact_release(N.exact_release(df, "x", 3.0, 50.0, "id", KEY, granularity=0.5)[0], "n", 1, 50.0, "id", KEY)[0].collect()}
    assert got[1].x * 2 == int(got[1].x * 2) and abs(got[1].x - 10) < 3 and got[1].n == 7 and got[2].x is None and got[2].n is None
    assert N.grid_sensitivity(3.0, 0.5, False) == 7 and N.grid_sensitivity(2.5, 1.0, True) == 3
    for bad in (0.3, 0.0, -1.0):
        with pytest.raises(ValueError):
            N.exact_release(df, "x", 1.0, 1.0, "id", KEY, granularity=bad)
    with pytest.raises(ValueError):
        N.exact_release(df, "x", 1e9, 1.0, "id", KEY, delta=1e-5)
