"""Registered queries for Laplace/Gaussian releases and the ledger (D1-D17) with DuckDB oracles.

Oracles rebuild the same keyed uniforms (SHA-256 of secret, release, purpose and key) in SQL, so noisy answers are
compared value-exactly (released values are rounded to 6 decimals on both sides).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import functions as F

from umbra.functions.noise import discrete_gaussian_sql, discrete_laplace_sql, gaussian_sql, laplace, laplace_sql
from umbra.operators import noisy as N
from umbra.operators.ledger import ORDERS, BudgetExceeded, budget_status, check_budget, commit, composed_epsilon, ledger_frame, measured_ledger, read_ledger
from umbra.plans.q_mondrian import PEOPLE_CTES, people_ids
from umbra.plans.q_cleaning import clean_people
from umbra.plans.sqltext import clean_ctes, with_
from umbra.sources.fixtures import FIXTURE, table

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def u(purpose, *keys):
    return FIXTURE.uniform_sql(purpose, *keys)


def lap(label, key, scale):
    keys = [key] if isinstance(key, str) else key
    return laplace_sql(u(N.laplace_purpose(label, scale), *keys), repr(float(scale)))


def gauss(label, key, sigma):
    one, two = N.gaussian_purposes(label, sigma)
    return gaussian_sql(u(one, key), u(two, key), repr(float(sigma)))


def orders(spark, sf):
    return table(spark, sf, "orders")


# Fixed parameters of the registered DP workloads.
PRICE_SENS, PRICE_EPS, DELTA = 1000.0, 0.5, 1e-5
SWEEP = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0]
SWEEP_SENS, BETA = 10.0, 1e-5
CLIP_HI = 50000.0


@register("d01_laplace_noise", f"SELECT o_orderkey, round({lap('d01', 'o_orderkey', 2.0)}, 6) AS noise FROM orders")
def d01(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.round(N.laplace_noise("o_orderkey", 2.0, "d01", FIXTURE), 6).alias("noise"))


@register("d02_gaussian_noise", f"SELECT o_orderkey, round({gauss('d02', 'o_orderkey', 3.0)}, 6) AS noise FROM orders")
def d02(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.round(N.gaussian_noise("o_orderkey", 3.0, "d02", FIXTURE), 6).alias("noise"))


@register("d03_add_laplace", f"SELECT o_orderkey, round(o_totalprice + {lap('o_totalprice', 'o_orderkey', PRICE_SENS / PRICE_EPS)}, 6) "
                             "AS o_totalprice FROM orders")
def d03(spark, sf):
    return N.add_laplace(orders(spark, sf), "o_totalprice", PRICE_SENS, PRICE_EPS, "o_orderkey", FIXTURE).select(
        "o_orderkey", "o_totalprice")


_SIGMA = N.gaussian_sigma(PRICE_SENS, PRICE_EPS, DELTA)


@register("d04_add_gaussian", f"SELECT o_orderkey, round(o_totalprice + {gauss('o_totalprice', 'o_orderkey', _SIGMA)}, 6) AS o_totalprice FROM orders")
def d04(spark, sf):
    return N.add_gaussian(orders(spark, sf), "o_totalprice", PRICE_SENS, PRICE_EPS, DELTA, "o_orderkey", FIXTURE).select(
        "o_orderkey", "o_totalprice")


_PRIO = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"


def _prio_counts(spark, sf):
    return orders(spark, sf).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register("d09_laplace_mechanism", with_([("g", _PRIO)],
          f"SELECT o_orderpriority, round(n + {lap('mechanism:n', 'o_orderpriority', 1.0 / 0.5)}, 6) AS noisy_value, CAST(1.0 / 0.5 AS DOUBLE) AS noise_scale, "
          f"CAST(0.5 AS DOUBLE) AS epsilon, (1.0 / 0.5) * ln((SELECT count(*) FROM g) / {BETA}) AS error_bound FROM g"))
def d09(spark, sf):
    """D9 with D5 (noise_scale) and D6 (error_bound over the released dimension)."""
    rel, _ = N.laplace_mechanism(_prio_counts(spark, sf), "n", 1.0, 0.5, "o_orderpriority", FIXTURE, beta=BETA)
    return rel


_EXACT_PRICE = f"floor(o_totalprice / 0.25 + 0.5)"


@register("d01_discrete_laplace", f"SELECT o_orderkey, ({_EXACT_PRICE} + {discrete_laplace_sql(FIXTURE, 'price/0.25', Fraction(401), 'o_orderkey')}) * 0.25 AS price FROM orders")
def d01_exact(spark, sf):
    """D1 exactly: prices on a grid of a quarter, sensitivity 100, epsilon 1, integer noise of scale 401 steps."""
    rel, _ = N.exact_release(orders(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("price")), "price", 100.0, 1.0, "o_orderkey", FIXTURE, granularity=0.25)
    return rel


_EXACT_SIGMA = Fraction(N.gaussian_sigma(1, 0.5, DELTA))


@register("d02_discrete_gaussian", f"SELECT o_orderkey, CAST(1 + {discrete_gaussian_sql(FIXTURE, 'one/1.0', _EXACT_SIGMA, 'o_orderkey')} AS BIGINT) AS one FROM orders")
def d02_exact(spark, sf):
    """D2 exactly: a whole number of sensitivity 1 with discrete Gaussian noise, epsilon 0.5, delta 1e-5."""
    rel, _ = N.exact_release(orders(spark, sf).select("o_orderkey", F.lit(1).alias("one")), "one", 1, 0.5, "o_orderkey", FIXTURE, delta=DELTA)
    return rel


@register("d09_exact_counts", with_([("g", _PRIO)], f"SELECT o_orderpriority, n + {discrete_laplace_sql(FIXTURE, 'n/1.0', Fraction(4), 'o_orderpriority')} AS n FROM g"))
def d09_exact(spark, sf):
    """D9 exactly: whole noisy counts, epsilon 0.25."""
    return N.exact_release(_prio_counts(spark, sf), "n", 1, 0.25, "o_orderpriority", FIXTURE)[0]


def _sweep_sql():
    eps_rows = ", ".join(f"({i}, CAST({e!r} AS DOUBLE))" for i, e in enumerate(SWEEP))
    draw = laplace_sql(u("sweep", "o_orderpriority", "i"), f"({SWEEP_SENS} / epsilon)")
    return with_([("g", _PRIO), ("e", f"SELECT * FROM (VALUES {eps_rows}) t(i, epsilon)")],
                 f"SELECT o_orderpriority, epsilon, ({SWEEP_SENS} / epsilon) * ln(1 / {BETA}) AS error_bound, round(n + {draw}, 6) AS noisy_count FROM g, e")


@register("d06_epsilon_sweep", _sweep_sql())
def d06(spark, sf):
    """Accuracy bound and noisy count of each priority for every epsilon of the sweep."""
    g = _prio_counts(spark, sf).select("o_orderpriority", "n", F.posexplode(F.array(*[F.lit(e) for e in SWEEP])).alias("i", "epsilon"))
    draw = laplace(FIXTURE.uniform("sweep", "o_orderpriority", "i"), F.lit(SWEEP_SENS) / F.col("epsilon"))
    return g.select("o_orderpriority", "epsilon", N.accuracy_bound(SWEEP_SENS, F.col("epsilon"), 1, BETA).alias("error_bound"),
                    F.round(F.col("n") + draw, 6).alias("noisy_count"))


@register("d07_clip", with_([("c", f"SELECT l_returnflag, round(sum(greatest(0.0, least({CLIP_HI}, l_extendedprice))), 2) AS clipped_sum "
                                    "FROM lineitem GROUP BY 1")],
                            f"SELECT l_returnflag, clipped_sum, round(clipped_sum + {lap('clip', 'l_returnflag', CLIP_HI / 1.0)}, 6) "
                            "AS noisy_sum FROM c"))
def d07(spark, sf):
    """Clip to [0, 50000] so a sum has sensitivity 50000, then release the sums."""
    li = table(spark, sf, "lineitem")
    c = li.groupBy("l_returnflag").agg(F.round(F.sum(N.clip(F.col("l_extendedprice"), 0.0, CLIP_HI)), 2).alias("clipped_sum"))
    return N.add_laplace(c, "clipped_sum", CLIP_HI, 1.0, "l_returnflag", FIXTURE, out="noisy_sum", label="clip")


@register("d08_normalize_sensitivity", with_(PEOPLE_CTES + [("lg", "SELECT 'age' AS attr, CAST(age AS DOUBLE) AS v FROM pid_people UNION ALL "
                                                                 "SELECT 'education_num', CAST(education_num AS DOUBLE) FROM pid_people UNION ALL "
                                                                 "SELECT 'capital_gain', CAST(capital_gain AS DOUBLE) FROM pid_people")],
                                             "SELECT attr, max(v) - min(v) AS data_range, CASE WHEN max(v) - min(v) > 0 THEN 1.0 / (max(v) - min(v)) END "
                                             "AS normalized_sensitivity FROM lg GROUP BY attr"))
def d08(spark, sf):
    return N.normalized_sensitivity(people_ids(spark, sf), ["age", "education_num", "capital_gain"])


_BATCH_Q = ("SELECT 'priority:' || o_orderpriority AS query_id, CAST(count(*) AS DOUBLE) AS value, CAST(1.0 AS DOUBLE) AS sensitivity FROM orders GROUP BY 1 "
            "UNION ALL SELECT 'status:' || o_orderstatus, CAST(count(*) AS DOUBLE), 1.0 FROM orders GROUP BY 1")


def _batch_queries(spark, sf):
    o = orders(spark, sf)
    a = o.groupBy(F.concat(F.lit("priority:"), "o_orderpriority").alias("query_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    b = o.groupBy(F.concat(F.lit("status:"), "o_orderstatus").alias("query_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return a.unionByName(b).withColumn("sensitivity", F.lit(1.0))


@register("d10_laplace_batch", with_([("q", _BATCH_Q)],
          "SELECT query_id, CAST(sensitivity AS DOUBLE) AS sensitivity, sensitivity / 0.5 AS noise_scale, sensitivity > 0 AS valid, "
          f"round(value + {laplace_sql(u('batch/0.5', 'query_id', "format('{:.1f}', sensitivity)"), 'sensitivity / 0.5')}, 6) AS noisy_value FROM q"))
def d10(spark, sf):
    return N.laplace_batch(_batch_queries(spark, sf), 0.5, FIXTURE)


@register("d13_adaptive_laplace", with_([("g", _PRIO), ("r", "SELECT *, row_number() OVER (ORDER BY o_orderpriority) AS rk FROM g")],
          f"SELECT o_orderpriority, CASE WHEN rk <= 3 THEN CAST({0.5 / 3!r} AS DOUBLE) END AS epsilon, rk <= 3 AS admitted, "
          f"CASE WHEN rk <= 3 THEN round(n + {lap('adaptive', 'o_orderpriority', 1.0 / (0.5 / 3))}, 6) END AS noisy_value FROM r"))
def d13(spark, sf):
    """Total eps 0.5 split over 3 expected queries; the 4th and 5th are rejected."""
    q = N.adaptive_epsilon(_prio_counts(spark, sf), 0.5, expected=3, order="o_orderpriority")
    noisy = F.col("n") + N.laplace_noise("o_orderpriority", 1.0 / (0.5 / 3), "adaptive", FIXTURE)
    return q.withColumn("noisy_value", F.when(F.col("admitted"), F.round(noisy, 6))).drop("n")


@register("d13_adaptive_ties", with_([("g", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"),
                                       ("f", "SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS rk FROM g"),
                                       ("c", "SELECT (SELECT o_orderstatus FROM f WHERE rk = 7) AS last, (SELECT o_orderstatus FROM f WHERE rk = 8) AS nxt")],
          f"SELECT o_orderstatus, o_orderpriority, CASE WHEN last = nxt THEN o_orderstatus < nxt ELSE o_orderstatus <= last END AS admitted, "
          f"CASE WHEN CASE WHEN last = nxt THEN o_orderstatus < nxt ELSE o_orderstatus <= last END THEN CAST({0.6 / 7!r} AS DOUBLE) END AS epsilon FROM g, c"))
def d13t(spark, sf):
    """D13 with equal order keys: the keys that straddle the limit of 7 are rejected, so the total holds."""
    g = orders(spark, sf).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return N.adaptive_epsilon(g, 0.6, expected=7, order="o_orderstatus").drop("n")


@register("d14_post_process", f"SELECT l_orderkey, l_linenumber, "
                              f"round(l_quantity + {lap('post:l_quantity', ['l_orderkey', 'l_linenumber'], 1.0)}, 6) "
                              "AS l_quantity FROM lineitem")
def d14(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return N.post_process(li, ["l_quantity"], 1.0, ["l_orderkey", "l_linenumber"], FIXTURE)


_D15_SENS = {"age": 100.0, "education_num": 16.0, "capital_gain": 100000.0}


@register("d15_noisy_columns", with_(PEOPLE_CTES, "SELECT person_id, " + ", ".join(
    f"round({c} + {lap('cell:' + c, 'person_id', N.laplace_scale(s, 0.3 / 3))}, 6) AS {c}" for c, s in _D15_SENS.items()) + " FROM pid_people"))
def d15(spark, sf):
    """Per-cell noise on three numeric columns, eps 0.3 split equally."""
    rel, _ = N.noisy_columns(people_ids(spark, sf), list(_D15_SENS), 0.3, "person_id", FIXTURE, _D15_SENS)
    return rel.select("person_id", *_D15_SENS)


_SPENT = " UNION ALL ".join(f"SELECT CAST(0.3 AS DOUBLE) / {len(_D15_SENS)} AS epsilon, (SELECT count({c}) FROM pid_people) AS released" for c in _D15_SENS)


@register("d11_budget_status", with_(PEOPLE_CTES + [("led", _SPENT)],
          "SELECT 'laplace' AS mechanism, CAST(1.0 AS DOUBLE) AS epsilon_allocated, sum(epsilon) AS epsilon_spent, "
          "greatest(0.0, 1.0 - sum(epsilon)) AS epsilon_remaining, count(*) AS num_queries, CAST(sum(released) AS BIGINT) AS released_values FROM led"))
def d11(spark, sf):
    """Budget status of the D15 release, with the number of values it actually published."""
    rel, entries = N.noisy_columns(people_ids(spark, sf), list(_D15_SENS), 0.3, "person_id", FIXTURE, _D15_SENS)
    led = measured_ledger(rel, entries, "d15")
    released = led.groupBy("mechanism").agg(F.sum("released_values").alias("released_values"))
    return budget_status(led, 1.0).join(released, "mechanism")


@register("d12_budget_check", with_(PEOPLE_CTES + [("led", _SPENT)],
          "SELECT (SELECT count(*) FROM pid_people) AS rows_released, (SELECT sum(epsilon) FROM led) AS epsilon_spent, requested, "
          "(SELECT sum(epsilon) FROM led) + requested <= 1.0 AS within_budget FROM (VALUES (CAST(0.5 AS DOUBLE)), (0.9)) t(requested)"))
def d12(spark, sf):
    """The ledger is checked *before* further releases of eps 0.5 and 0.9 under a budget of 1.0."""
    rel, entries = N.noisy_columns(people_ids(spark, sf), list(_D15_SENS), 0.3, "person_id", FIXTURE, _D15_SENS)
    led = measured_ledger(rel, entries, "d15")
    spent = check_budget(led, 1.0, enforce=False)
    asked = []
    for requested in (0.5, 0.9):
        try:
            check_budget(led, 1.0, requested=requested)
            asked.append((requested, True))
        except BudgetExceeded:
            asked.append((requested, False))
    verdicts = spark.createDataFrame(asked, "requested double, within_budget boolean")
    return rel.agg(F.count(F.lit(1)).alias("rows_released")).withColumn("epsilon_spent", F.lit(spent)).crossJoin(F.broadcast(verdicts))


_MONTHLY = ("SELECT o_orderpriority AS p, CAST(month(o_orderdate) AS INT) AS m, CASE WHEN o_orderpriority < '2' THEN 'laplace' WHEN o_orderpriority < '4' THEN 'gaussian' "
            "WHEN o_orderpriority < '5' THEN 'exponential' ELSE 'above_threshold' END AS mechanism FROM orders GROUP BY 1, 2")
_ORDER_ROWS = ", ".join(f"({float(x)!r}::DOUBLE)" for x in ORDERS)
COMPOSED_DELTA = 1e-6


@register("d11_composed_budget", with_([
    ("g", _MONTHLY), ("led", "SELECT mechanism, CAST(0.02 + 0.01 * m AS DOUBLE) AS e, CASE WHEN mechanism = 'gaussian' THEN 1e-7::DOUBLE ELSE 0.0::DOUBLE END AS d FROM g"),
    ("o", f"SELECT * FROM (VALUES {_ORDER_ROWS}) t(a)"),
    ("loss", "SELECT mechanism, a, sum(CASE mechanism WHEN 'laplace' THEN least(ln(a / (2 * a - 1) * exp((a - 1) * e) + (a - 1) / (2 * a - 1) * exp(-a * e)) / (a - 1), least(e, a * e * e / 2)) "
             "WHEN 'gaussian' THEN a * e * e / (4 * ln(1.25 / d)) WHEN 'exponential' THEN least(e, a * e * e / 8) ELSE least(e, a * e * e / 2) END) AS loss FROM led, o GROUP BY ALL"),
    ("best", f"SELECT mechanism, min(greatest(0.0, loss + ln((a - 1) / a) - (ln({COMPOSED_DELTA!r}) + ln(a)) / (a - 1))) AS r FROM loss GROUP BY 1")],
    f"SELECT mechanism, count(*) AS releases, round(sum(e), 9) AS epsilon_sequential, round(least(CASE WHEN sum(d) <= {COMPOSED_DELTA!r} THEN sum(e) END, any_value(r)), 9) AS epsilon_composed "
    "FROM led JOIN best USING (mechanism) GROUP BY 1"))
def d11_composed(spark, sf):
    """A ledger of monthly releases for each order priority, composed as Renyi losses at delta 1e-6."""
    g = orders(spark, sf).groupBy(F.col("o_orderpriority").alias("p"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    mechanism = F.when(F.col("p") < "2", "laplace").when(F.col("p") < "4", "gaussian").when(F.col("p") < "5", "exponential").otherwise("above_threshold")
    led = g.select(mechanism.alias("mechanism"), (F.lit(0.02) + F.lit(0.01) * F.col("m")).alias("epsilon")).withColumn("delta", F.when(F.col("mechanism") == "gaussian", 1e-7).otherwise(0.0))
    out = composed_epsilon(led, COMPOSED_DELTA, ["mechanism"])
    return out.select("mechanism", "releases", *[F.round(c, 9).alias(c) for c in ("epsilon_sequential", "epsilon_composed")])


@register("d12_concurrent_budget", "SELECT CAST(least(count(DISTINCT o_orderpriority), 3) AS BIGINT) AS accepted, CAST(count(DISTINCT o_orderpriority) - least(count(DISTINCT o_orderpriority), 3) AS BIGINT) "
                                   "AS refused, round(0.3 * least(count(DISTINCT o_orderpriority), 3), 6) AS epsilon_spent FROM orders")
def d12_concurrent(spark, sf):
    """A release of each order priority's count (epsilon 0.3), all at once, under a stored budget of 1."""
    from concurrent.futures import ThreadPoolExecutor
    from umbra.plans.q_workflows import scratch
    path = scratch(spark, "ledger")

    def release(priority):
        led = ledger_frame(spark, [N.LedgerEntry("laplace", "n", 0.3, 0.0, 1.0)], f"count/{priority}")
        try:
            return commit(led, path, budget=1.0) > 0
        except BudgetExceeded:
            return False

    asked = [r[0] for r in orders(spark, sf).select("o_orderpriority").distinct().collect()]
    with ThreadPoolExecutor(len(asked) or 1) as pool:
        done = list(pool.map(release, asked))
    spent = read_ledger(spark, path).agg(F.round(F.coalesce(F.sum("epsilon"), F.lit(0.0)), 6).alias("epsilon_spent"))
    return spent.select(F.lit(sum(done)).cast("long").alias("accepted"), F.lit(len(done) - sum(done)).cast("long").alias("refused"), "epsilon_spent")


def _d17_sql():
    cols = []
    for c in ["person_id", "age", "workclass", "education-num", "marital-status", "occupation", "race", "sex",
              "native-country", "capital-gain", "income", "age_group", "continent_code"]:
        qc = f'"{c}"'
        if c in ("age", "education-num", "capital-gain"):
            s = N.CENSUS_SENSITIVITIES[c]
            cols.append(f"round({qc} + {lap('cell:' + c, 'person_id', N.laplace_scale(s, 0.3 / 3))}, 6) AS {qc}")
        else:
            cols.append(qc)
    return with_(clean_ctes(), "SELECT " + ", ".join(cols) + " FROM clean")


@register("d17_protect_dataset", _d17_sql())
def d17(spark, sf):
    """D16 + D17: every numeric column except the SA and the row key gets cell noise (eps 0.3 split)."""
    rel, _ = N.protect_dataset(clean_people(spark, sf), 0.3, key="person_id", noise=FIXTURE)
    return rel


@register("d16_numeric_columns", with_(clean_ctes(), f"SELECT attr, sensitivity, CAST({0.3 / 3!r} AS DOUBLE) AS epsilon, count(v) AS n FROM ("
                                                     "SELECT 'age' AS attr, CAST(100.0 AS DOUBLE) AS sensitivity, age AS v FROM clean UNION ALL "
                                                     "SELECT 'education-num', CAST(16.0 AS DOUBLE), \"education-num\" FROM clean UNION ALL "
                                                     "SELECT 'capital-gain', CAST(100000.0 AS DOUBLE), \"capital-gain\" FROM clean) GROUP BY ALL"))
def d16(spark, sf):
    """The chosen columns (any numeric width, minus SA and key), their sensitivity and eps share."""
    df = clean_people(spark, sf)
    cols = N.numeric_release_columns(df, ["income"], "person_id")
    eps = 0.3 / len(cols)
    items = [F.struct(F.lit(c).alias("attr"), F.lit(N.CENSUS_SENSITIVITIES.get(c, 1.0)).alias("sensitivity"),
                      F.lit(eps).alias("epsilon"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]
    return df.select(F.inline(F.array(*items))).groupBy("attr", "sensitivity", "epsilon").agg(F.count("v").alias("n"))
