"""Registered queries for selection, thresholds and counts (E1-E12) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.noise import gaussian_sql, gumbel_sql, laplace_sql
from umbra.operators import bounded as B
from umbra.operators import selection as E
from umbra.operators import threshold as TH
from umbra.plans.q_mondrian import PEOPLE_CTES, people_ids
from umbra.plans.sqltext import with_
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


def u(label, *keys):
    return FIXTURE.uniform_sql(label, *keys)


# Fixed parameters of the registered workloads.
SEL_EPS, SEL_SENS, TOP_K = 0.2, 1.0, 3
THRESHOLD, TH_EPS, TH_DELTA, TH_C = 2_500_000.0, 0.15, 1e-6, 3
COUNT_EPS, PROP_EPS = 0.3, 0.5
RR_EPS, RR_COMPAT_EPS = 1.0, 30.0


def _prio_cands(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("option"))
            .agg(F.count(F.lit(1)).cast("double").alias("utility")).withColumn("selection_id", F.lit("s0")))


def _status_cands(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("selection_id"), F.col("o_orderpriority").alias("option"))
            .agg(F.count(F.lit(1)).cast("double").alias("utility")))


_PRIO_C = "SELECT 's0' AS selection_id, o_orderpriority AS option, CAST(count(*) AS DOUBLE) AS utility FROM orders GROUP BY 2"
_STATUS_C = ("SELECT o_orderstatus AS selection_id, o_orderpriority AS option, CAST(count(*) AS DOUBLE) AS utility "
             "FROM orders GROUP BY 1, 2")
_X = f"({SEL_EPS / (2.0 * SEL_SENS)!r} * utility)"


def _weights_sql(src):
    return with_([("x1", f"SELECT *, {_X} AS x FROM {src}"),
                  ("x2", "SELECT *, exp(x - max(x) OVER (PARTITION BY selection_id)) AS e FROM x1")],
                 "SELECT selection_id, option, utility, e / sum(e) OVER (PARTITION BY selection_id) AS probability FROM x2")


@register("e01_exponential_weights", with_([("c", _PRIO_C)], "SELECT * FROM (" + _weights_sql("c") + ")"))
def e01(spark, sf):
    return E.exponential_weights(_prio_cands(spark, sf), SEL_EPS, SEL_SENS)


def _select_sql(src):
    score = f"({_X} + {gumbel_sql(u(E.selection_purpose(SEL_EPS, SEL_SENS), 'selection_id', 'option'))})"
    return with_([("c", src), ("w", _weights_sql("c"))],
                 f"SELECT s.selection_id, s.selected, s.n_options, w.probability FROM (SELECT selection_id, arg_max(option, {score}) AS selected, "
                 "count(*) AS n_options FROM c GROUP BY 1) s LEFT JOIN w ON w.selection_id = s.selection_id AND w.option = s.selected")


@register("e02_exponential_select", _select_sql(_PRIO_C))
def e02(spark, sf):
    return E.exponential_select(_prio_cands(spark, sf), SEL_EPS, SEL_SENS, FIXTURE, with_probability=True)


@register("e03_batch_select", _select_sql(_STATUS_C))
def e03(spark, sf):
    """One selection per order status, options = priorities, utility = count."""
    return E.exponential_select(_status_cands(spark, sf), SEL_EPS, SEL_SENS, FIXTURE, with_probability=True)


@register("e04_top_k_probabilities", with_([("c", _STATUS_C), ("w", _weights_sql("c"))],
          f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY probability DESC, option) AS rank FROM w) "
          f"WHERE rank <= {TOP_K}"))
def e04(spark, sf):
    return E.top_k_probabilities(_status_cands(spark, sf), SEL_EPS, SEL_SENS, TOP_K)


@register("e05_selection_statistics", with_([("c", _STATUS_C)],
          f"SELECT CAST({SEL_EPS} AS DOUBLE) AS epsilon, CAST({SEL_SENS} AS DOUBLE) AS sensitivity, count(DISTINCT selection_id) "
          "AS total_selections FROM c"))
def e05(spark, sf):
    sel = E.exponential_select(_status_cands(spark, sf), SEL_EPS, SEL_SENS, FIXTURE)
    return E.selection_statistics(sel, SEL_EPS, SEL_SENS)


_EV_C = "SELECT 's0' AS selection_id, event_type AS option, CAST(count(*) AS DOUBLE) AS utility FROM events WHERE event_type IS NOT NULL GROUP BY 2"


@register("e06_utility_select", _select_sql(_EV_C))
def e06(spark, sf):
    """Utility computed from the data (events per type, sensitivity 1)."""
    return E.exponential_select(E.utility_counts(table(spark, sf, "events"), "event_type"), SEL_EPS, SEL_SENS, FIXTURE,
                                with_probability=True)


def _rr_sql(mode, col="workclass", eps=RR_EPS, src="pid_people", ctes=None, select=None, text=True):
    """Oracle of ``randomize_sa`` over ``src``; ``select`` lists extra output columns of ``src``."""
    dom = (f"SELECT v, CAST(row_number() OVER (ORDER BY substr(sha256(v), 1, 2), v) - 1 AS BIGINT) AS i FROM "
           f"(SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM {src} WHERE {col} IS NOT NULL)")
    u1, u2 = (u(f"response/{mode}/{col}/{float(eps)!r}/{x}", "person_id") for x in ("keep", "pick"))
    if mode == "krr":
        keep = f"(exp({eps!r}) / (exp({eps!r}) + (SELECT count(*) FROM dom) - 1))"
        flip = f"({u1} >= {keep} AND (SELECT count(*) FROM dom) > 1)"
        j = f"CAST(floor({u2} * ((SELECT count(*) FROM dom) - 1)) AS BIGINT)"
        target = f"CASE WHEN {j} >= own.i THEN {j} + 1 ELSE {j} END"
    else:
        flip = f"({u1} < {RR_COMPAT_EPS / 100.0!r})"
        target = f"CAST(floor({u2} * (SELECT count(*) FROM dom)) AS BIGINT)"
    back = "d.v" if text else "CAST(d.v AS INTEGER)"
    extra = "".join(f", p.{c}" for c in (select or []))
    extra_out = "".join(f", t.{c}" for c in (select or []))
    return with_((ctes if ctes is not None else PEOPLE_CTES) + [
        ("dom", dom),
        ("t", f"SELECT p.person_id, p.{col}{extra}, CASE WHEN {flip} AND own.i IS NOT NULL THEN {target} END AS ti "
              f"FROM {src} p LEFT JOIN dom own ON own.v = CAST(p.{col} AS VARCHAR)")],
        f"SELECT t.person_id{extra_out}, coalesce({back}, t.{col}) AS {col} FROM t LEFT JOIN dom d ON d.i = t.ti")


@register("e07_randomize_sa_krr", _rr_sql("krr"))
def e07(spark, sf):
    """K-ary randomized response on workclass (eps 1)."""
    return E.randomize_sa(people_ids(spark, sf), "workclass", RR_EPS, "person_id", FIXTURE, mode="krr").select("person_id", "workclass")


@register("e07_randomize_sa_compat", _rr_sql("compat", eps=RR_COMPAT_EPS))
def e07c(spark, sf):
    """E7 compat: replace with probability eps/100 by a uniform domain value (eps 30 -> p 0.3)."""
    return E.randomize_sa(people_ids(spark, sf), "workclass", RR_COMPAT_EPS, "person_id", FIXTURE, mode="compat").select(
        "person_id", "workclass")


_TOTALS = "SELECT 'b0' AS batch_id, o_custkey AS query_id, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2"


def _totals(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("query_id"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value")).withColumn("batch_id", F.lit("b0")))


def _at_sql(mode, delta=0.0, c=1):
    ts, qs, ans_s = TH.threshold_scales(TH_EPS, delta, mode, c)
    tag = f"{mode}/{THRESHOLD!r}/{TH_EPS!r}/{float(delta)!r}/{c}"

    def draw(what, scale, *keys):
        if delta > 0 and what != "answer":
            return gaussian_sql(u(f"at/{what}/1/{tag}", *keys), u(f"at/{what}/2/{tag}", *keys), repr(scale))
        return laplace_sql(u(f"at/{what}/{tag}", *keys), repr(scale))

    rho, nu, ans = draw("threshold", ts, "batch_id"), draw("query", qs, "batch_id", "query_id"), draw("answer", ans_s, "batch_id", "query_id")
    ctes = [("q", _TOTALS), ("a", f"SELECT *, (value + {nu} >= {THRESHOLD!r} + {rho}) AS above0 FROM q")]
    if mode == "svt":
        ctes.append(("r", "SELECT *, sum(CAST(above0 AS INT)) OVER (PARTITION BY batch_id ORDER BY query_id) AS run FROM a"))
        above = f"(above0 AND run <= {c})"
        src = "r"
    else:
        above, src = "above0", "a"
    return with_(ctes, f"SELECT batch_id, query_id, {above} AS above, CASE WHEN {above} THEN round(value + {ans}, 6) END AS answer FROM {src}")


@register("e08_above_threshold_compat", _at_sql("compat"))
def e08(spark, sf):
    return TH.above_threshold(_totals(spark, sf), THRESHOLD, TH_EPS, FIXTURE, mode="compat")


@register("e08_above_threshold_gaussian", _at_sql("compat", TH_DELTA))
def e08g(spark, sf):
    return TH.above_threshold(_totals(spark, sf), THRESHOLD, TH_EPS, FIXTURE, delta=TH_DELTA, mode="compat")


@register("e09_sparse_vector", _at_sql("svt", c=TH_C))
def e09(spark, sf):
    """E8/E9 svt mode: only the first 3 positives (by customer key) are answered."""
    return TH.above_threshold(_totals(spark, sf), THRESHOLD, TH_EPS, FIXTURE, mode="svt", max_positives=TH_C)


@register("e09_sparse_vector_50", _at_sql("svt", c=50))
def e09w(spark, sf):
    """E9 with 50 allowed positives: the plan has as many steps as with one."""
    return TH.above_threshold(_totals(spark, sf), THRESHOLD, TH_EPS, FIXTURE, mode="svt", max_positives=50)


@register("e10_threshold_statistics", f"SELECT batch_id, count(*) AS total_queries, sum(CAST(above AS INT)) AS positives, CAST({TH_EPS} AS DOUBLE) AS epsilon, "
          f"CAST(0.0 AS DOUBLE) AS delta, CAST({THRESHOLD} AS DOUBLE) AS threshold FROM ({_at_sql('compat')}) GROUP BY 1")
def e10(spark, sf):
    ans = TH.above_threshold(_totals(spark, sf), THRESHOLD, TH_EPS, FIXTURE, mode="compat")
    return TH.threshold_statistics(ans, TH_EPS, THRESHOLD)


def _count_sql(value, scale, *keys):
    draw = laplace_sql(u(f"count/{COUNT_EPS!r}", *[f"coalesce('=' || CAST({k} AS VARCHAR), 'null')" for k in keys]), scale)
    return f"greatest(0, CAST(round({value} + {draw}) AS BIGINT))"


# A public list of kinds, with one that may have no rows and with null.
EVENT_KINDS = ("click", "error", "purchase", "refund", "signup", "view", None)
_KINDS_SQL = ", ".join("(NULL)" if k is None else f"('{k}')" for k in EVENT_KINDS)


@register("e11_noisy_count", with_([("dom", f"SELECT * FROM (VALUES {_KINDS_SQL}) t(kind)"),
                                     ("k", "SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS kind FROM events"),
                                     ("g", "SELECT dom.kind, count(k.one) AS true_count FROM dom LEFT JOIN (SELECT *, 1 AS one FROM k) k "
                                           "ON k.kind IS NOT DISTINCT FROM dom.kind GROUP BY 1")],
          f"SELECT kind, {_count_sql('true_count', repr(1.0 / COUNT_EPS), 'kind')} AS noisy_count FROM g"))
def e11(spark, sf):
    """E11 over a public list of kinds; rows without a kind are a group like others."""
    ev = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("kind"))
    return TH.noisy_count(ev, ["kind"], COUNT_EPS, FIXTURE, domain=list(EVENT_KINDS))


@register("e11_noisy_count_public_domain", with_([
    ("dom", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    ("c", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
          "WHERE c_acctbal > 9000 GROUP BY 1, 2"),
    ("g", "SELECT d.n_name, d.r_name, coalesce(c.n, 0) AS true_count FROM dom d LEFT JOIN c USING (n_name, r_name)")],
    f"SELECT n_name, r_name, {_count_sql('true_count', repr(1.0 / COUNT_EPS), 'n_name', 'r_name')} AS noisy_count FROM g"))
def e11d(spark, sf):
    """E11 with a public domain: every (nation, region) is released even when no customer matches."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rich = table(spark, sf, "customer").where(F.col("c_acctbal") > 9000).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return TH.noisy_count(rich, ["n_name", "r_name"], COUNT_EPS, FIXTURE, domain=places.select("n_name", "r_name"))


@register("e12_noisy_proportion", with_([("g", "SELECT o_orderpriority, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) "
                                               "AS true_proportion FROM orders GROUP BY 1")],
          f"SELECT o_orderpriority, n, round(greatest(0.0, least(1.0, true_proportion + "
          f"{laplace_sql(u(f'proportion/{PROP_EPS!r}', "coalesce('=' || o_orderpriority, 'null')"), f'(1.0 / (n * {PROP_EPS!r}))')})), 6) AS noisy_proportion FROM g"))
def e12(spark, sf):
    o = table(spark, sf, "orders")
    return TH.noisy_proportion(o, F.col("o_orderstatus") == "F", PROP_EPS, FIXTURE, by=["o_orderpriority"])


# ---- persons, unknown groups, quantiles --------------------------------------------------------------

PERSON_EPS, PERSON_ROWS = 0.5, 3


def _bounded_sql(src: str, person: str, key: str, m: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {person} ORDER BY {u(B.bound_purpose(m), person, key)}, {key}) AS rn FROM {src}) WHERE rn <= {m}"


def _group_sql(*keys):
    return [f"coalesce('=' || CAST({k} AS VARCHAR), 'null')" for k in keys]


@register("d07_bound_rows", with_([("b", _bounded_sql("orders", "o_custkey", "o_orderkey", PERSON_ROWS))], "SELECT o_custkey, o_orderkey FROM b"))
def d07_rows(spark, sf):
    """At most three orders of each customer, by a keyed draw."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return B.bound_rows(o, "o_custkey", "o_orderkey", PERSON_ROWS, FIXTURE)


@register("e11_person_count", with_([("b", _bounded_sql("orders", "o_custkey", "o_orderkey", PERSON_ROWS)), ("g", "SELECT o_orderpriority, count(*) AS n FROM b GROUP BY 1")],
          f"SELECT o_orderpriority, greatest(0, CAST(round(n + {laplace_sql(u(f'person count/{PERSON_ROWS}/{PERSON_EPS!r}', *_group_sql('o_orderpriority')), repr(PERSON_ROWS / PERSON_EPS))}) AS BIGINT)) AS noisy_count FROM g"))
def e11_person(spark, sf):
    """Orders per priority, protecting customers with at most three orders each."""
    return B.person_count(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "o_orderkey", PERSON_ROWS, PERSON_EPS, FIXTURE)[0]


_SUM_HI = 200000.0


@register("d07_person_sum", with_([("b", _bounded_sql("orders", "o_custkey", "o_orderkey", PERSON_ROWS)),
                                   ("g", f"SELECT o_orderstatus, sum(greatest(0.0, least({_SUM_HI!r}, o_totalprice))) AS s FROM b GROUP BY 1")],
          f"SELECT o_orderstatus, round(s + {laplace_sql(u(f'person sum/{PERSON_ROWS}/{B.sum_sensitivity(PERSON_ROWS, 0.0, _SUM_HI)!r}/{PERSON_EPS!r}', *_group_sql('o_orderstatus')), repr(PERSON_ROWS * _SUM_HI / PERSON_EPS))}, 2) AS noisy_sum FROM g"))
def d07_person(spark, sf):
    """Clipped prices per status, protecting customers."""
    return B.person_sum(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", "o_custkey", "o_orderkey", PERSON_ROWS, 0.0, _SUM_HI, PERSON_EPS, FIXTURE, decimals=2)[0]


def _prop_draw(what):
    return laplace_sql(u(f"person proportion/{what}/{PERSON_ROWS}/{PERSON_EPS!r}", *_group_sql("o_orderpriority")), repr(2 * PERSON_ROWS / PERSON_EPS))


@register("e12_person_proportion", with_([("b", _bounded_sql("orders", "o_custkey", "o_orderkey", PERSON_ROWS)),
                                          ("g", f"SELECT o_orderpriority, count(*) + {_prop_draw('rows')} AS n, count(*) FILTER (WHERE o_orderstatus = 'F') + {_prop_draw('hits')} AS h FROM b GROUP BY 1")],
          "SELECT o_orderpriority, CASE WHEN n >= 1 THEN round(greatest(0.0, least(1.0, h / n)), 6) END AS noisy_proportion FROM g"))
def e12_person(spark, sf):
    """Share of finished orders per priority with a private group size, protecting customers."""
    return B.person_proportion(table(spark, sf, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_custkey", "o_orderkey", PERSON_ROWS, PERSON_EPS, FIXTURE)[0]


_PART_M, _PART_EPS, _PART_DELTA = 2, 1.0, 1e-3
_PAIRS = ("SELECT o_custkey, bucket, '=' || CAST(bucket AS VARCHAR) AS grp FROM (SELECT DISTINCT o_custkey, CAST(floor(o_totalprice / 10000) AS BIGINT) AS bucket FROM orders)")


@register("e11_unknown_groups", with_([("p", _PAIRS), ("b", _bounded_sql("p", "o_custkey", "grp", _PART_M)),
                                       ("g", f"SELECT bucket, count(*) + {laplace_sql(u(f'unknown groups/{_PART_M}/{_PART_EPS!r}/{_PART_DELTA!r}', *_group_sql('bucket')), repr(_PART_M / _PART_EPS))} AS n FROM b GROUP BY bucket")],
          f"SELECT bucket, CAST(round(n) AS BIGINT) AS noisy_count FROM g WHERE n >= {B.selection_threshold(_PART_M, _PART_EPS, _PART_DELTA)!r}"))
def e11_unknown(spark, sf):
    """E11 without a public domain: price buckets with the customers in them; rare buckets are not released."""
    o = table(spark, sf, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 10000).alias("bucket"))
    return B.unknown_groups(o, ["bucket"], "o_custkey", _PART_M, _PART_EPS, _PART_DELTA, FIXTURE)[0]


_QUANTILES, _Q_EPS, _Q_LO, _Q_HI = [0.1, 0.5, 0.95], 0.1, 0.0, 120000.0


def _quantile_sql(by: str | None):
    over, group = (f"PARTITION BY {by} ", [by]) if by else ("", [])
    g = _group_sql(*group)
    case = lambda f: "CASE q " + " ".join(f"WHEN {q!r} THEN {f(q)}" for q in _QUANTILES) + " END"
    draw = case(lambda q: gumbel_sql(u(B.quantile_purpose(q, _Q_EPS), "rank", *g)))
    point = case(lambda q: u(B.quantile_purpose(q, _Q_EPS) + "/point", *g))
    k = f"{by}, " if by else ""
    return with_([
        ("f", f"SELECT {k}greatest({_Q_LO!r}, least({_Q_HI!r}, l_extendedprice)) AS v, count(*) AS c FROM lineitem GROUP BY ALL"),
        ("r", f"SELECT {k}v, c, coalesce(sum(c) OVER ({over}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, "
              f"(sum(c) OVER ({over.strip()}))::BIGINT AS n, lag(v) OVER ({over}ORDER BY v) AS p, lead(v) OVER ({over}ORDER BY v) AS nx FROM f"),
        ("s", f"SELECT {k}n, before AS rank, coalesce(p, {_Q_LO!r}) AS a, v AS b FROM r UNION ALL SELECT {k}n, n, v, {_Q_HI!r} FROM r WHERE nx IS NULL"),
        ("t", f"SELECT *, unnest([{', '.join(f'{q!r}::DOUBLE' for q in _QUANTILES)}]) AS q FROM s WHERE b > a"),
        ("w", f"SELECT {k}q, arg_max({{'a': a, 'b': b}}, -{_Q_EPS / 2!r} * abs(rank - q * n) + ln(b - a) + {draw}) AS s FROM t GROUP BY ALL")],
        f"SELECT {k}q, round(s.a + {point} * (s.b - s.a), 4) AS noisy_quantile FROM w")


@register("e06_private_quantiles", _quantile_sql(None))
def e06_quantiles(spark, sf):
    """Quantiles of all line prices by the exponential mechanism."""
    return B.private_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _QUANTILES, _Q_LO, _Q_HI, _Q_EPS, FIXTURE, decimals=4)[0]


@register("e06_private_quantiles_by", _quantile_sql("l_returnflag"))
def e06_quantiles_by(spark, sf):
    """The same for each return flag."""
    return B.private_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _QUANTILES, _Q_LO, _Q_HI, _Q_EPS, FIXTURE, by=["l_returnflag"], decimals=4)[0]


_UTIL = "SELECT o_orderstatus AS selection_id, o_orderpriority AS option, sum(least(o_totalprice, 100000.0)) / 100000.0 AS utility FROM orders GROUP BY 1, 2"


@register("e06_utility_column", f"SELECT selection_id, arg_max(option, {0.5 / 2!r} * utility + {gumbel_sql(u(E.selection_purpose(0.5, 1.0), 'selection_id', 'option'))}) AS selected, "
                                f"count(*) AS n_options FROM ({_UTIL}) GROUP BY 1")
def e06_column(spark, sf):
    """The priority with the largest clipped turnover for each status: a Column as utility."""
    cands = B.utilities(table(spark, sf, "orders"), "o_orderpriority", F.sum(F.least(F.col("o_totalprice"), F.lit(100000.0))) / 100000.0, "o_orderstatus")
    return E.exponential_select(cands, 0.5, 1.0, FIXTURE)
