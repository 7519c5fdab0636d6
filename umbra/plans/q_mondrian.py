"""Registered queries for profiles (A1-A8) and Mondrian (M1-M9).

Single rounds and whole runs have DuckDB oracles (a recursive CTE that splits every open partition once a
step); tests also hold whole runs against a brute-force recursive model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.operators import mondrian as MM
from umbra.operators.profile import (categorical_profile, distinct_values, flat_edges, hierarchy, leaf_paths, numeric_profile,
                                     value_support)
from umbra.operators.report import equivalence_classes
from umbra.plans.q_cleaning import clean_people
from umbra.plans.sqltext import clean_ctes, mondrian_ncp_sql, mondrian_release_sql, mondrian_rows_sql, with_, with_recursive
from umbra.schema import PrivacySchema, to_identifiers
from umbra.sources.fixtures import ORDERS_QI_SQL, PLACE_EDGES_SQL, PRIORITY_EDGES_SQL, lineitem_qi, lineitem_qi_sql, sql_view, table

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Fixed workloads of the test plan.
K_SCHEMA = PrivacySchema(qi=["age", "education_num", "marital_status", "race", "sex", "occupation"],
                         numeric=["age", "education_num"], sa="income")
L_SCHEMA = PrivacySchema(qi=["age", "education_num", "race", "sex"], numeric=["age", "education_num"], sa="workclass")
L_BINARY_SCHEMA = PrivacySchema(qi=L_SCHEMA.qi, numeric=L_SCHEMA.numeric, sa="income")
LINEITEM_SCHEMA = PrivacySchema(qi=["l_quantity", "l_linenumber", "ship_month", "l_linestatus"],
                                numeric=["l_quantity", "l_linenumber", "ship_month"], sa="l_returnflag")
TREE_SCHEMA = PrivacySchema(qi=["order_month", "place", "balance", "priority"], numeric=["order_month", "balance"], sa="status")
K, L = 10, 2


def people_ids(spark, sf):
    return to_identifiers(clean_people(spark, sf))


_ID_SQL = ('SELECT person_id, age, workclass, "education-num" AS education_num, "marital-status" AS marital_status, '
           'occupation, race, sex, "native-country" AS native_country, "capital-gain" AS capital_gain, income, age_group, '
           'continent_code FROM clean')
PEOPLE_CTES = clean_ctes() + [("pid_people", _ID_SQL)]


def _members_sql(schema: PrivacySchema, src: str = "pid_people") -> str:
    cols = ", ".join(schema.columns)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in schema.columns)
    return f"SELECT {cols}, count(*) AS n FROM {src} WHERE {cond} GROUP BY ALL"


def _numeric_long_sql(schema: PrivacySchema, src: str = "members") -> str:
    parts = [f"SELECT {i} AS dim, CAST({c} AS DOUBLE) AS v, n FROM {src}"
             for i, c in enumerate(schema.qi) if schema.is_numeric[i]]
    return " UNION ALL ".join(parts)


def _categorical_long_sql(schema: PrivacySchema, src: str = "members", sa: bool = False) -> str:
    extra = f", {schema.sa} AS sa" if sa else ""
    parts = [f"SELECT {i} AS dim, CAST({c} AS VARCHAR) AS v, n{extra} FROM {src}"
             for i, c in enumerate(schema.qi) if not schema.is_numeric[i]]
    return " UNION ALL ".join(parts)


def _root(spark, sf, schema=K_SCHEMA):
    return MM.compress(people_ids(spark, sf), schema).withColumn("pid", F.lit("r"))


# ---- profiles -------------------------------------------------------------------------------

@register("a01_numeric_profile", with_(PEOPLE_CTES + [("lg", "SELECT 'age' AS attr, CAST(age AS DOUBLE) AS value FROM pid_people "
                                                            "UNION ALL SELECT 'education_num', CAST(education_num AS DOUBLE) FROM pid_people "
                                                            "UNION ALL SELECT 'capital_gain', CAST(capital_gain AS DOUBLE) FROM pid_people"),
                                                    ("sup", "SELECT attr, value, count(*) AS support FROM lg WHERE value IS NOT NULL GROUP BY ALL")],
                                       "SELECT attr, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, "
                                       "count(*) AS n_distinct, sum(support) AS n FROM sup GROUP BY attr"))
def a01(spark, sf):
    df = people_ids(spark, sf)
    return numeric_profile(df, ["age", "education_num", "capital_gain"])


@register("a01_value_support", with_(PEOPLE_CTES, "SELECT 'age' AS attr, CAST(age AS DOUBLE) AS value, count(*) AS support "
                                                  "FROM pid_people GROUP BY ALL"))
def a01s(spark, sf):
    return value_support(people_ids(spark, sf), ["age"])


_CATS = ["workclass", "marital_status", "occupation", "race", "sex", "native_country"]


def _cat_long_people_sql():
    return " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS value FROM pid_people" for c in _CATS)


@register("a02_categorical_profile", with_(PEOPLE_CTES + [("lg", _cat_long_people_sql())],
                                           "SELECT attr, count(DISTINCT value) AS leaf_num, count(value) AS n FROM lg GROUP BY attr"))
def a02(spark, sf):
    return categorical_profile(people_ids(spark, sf), _CATS)


@register("a03_hierarchy", with_(PEOPLE_CTES + [("lg", _cat_long_people_sql()),
                                                ("leaves", "SELECT DISTINCT attr, value FROM lg WHERE value IS NOT NULL AND value <> '*'")],
                                 "SELECT attr, value AS node, 1 AS level, CAST(0 AS BIGINT) AS leaf_num, true AS is_leaf FROM leaves "
                                 "UNION ALL SELECT attr, '*' AS node, 0 AS level, count(*) AS leaf_num, false AS is_leaf FROM leaves GROUP BY attr"))
def a03(spark, sf):
    return hierarchy(flat_edges(people_ids(spark, sf), _CATS))


_TREE = "SELECT CAST(p_partkey AS VARCHAR) AS child, CAST(p_partkey // 2 AS VARCHAR) AS parent FROM part WHERE p_partkey >= 2"


@register("a03_hierarchy_deep", with_recursive([("e", _TREE), ("up", "SELECT child AS node, parent AS anc, 1 AS dist FROM e UNION ALL "
                                                                       "SELECT up.node, e.parent, up.dist + 1 FROM up JOIN e ON e.child = up.anc"),
                                                 ("nodes", "SELECT child AS node FROM e UNION SELECT parent FROM e"),
                                                 ("leaves", "SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM e)")],
          "SELECT 'part' AS attr, n.node, coalesce((SELECT max(dist) FROM up WHERE up.node = n.node), 0) AS level, "
          "(SELECT count(*) FROM up JOIN leaves l ON l.node = up.node WHERE up.anc = n.node) AS leaf_num, n.node IN (SELECT node FROM leaves) AS is_leaf FROM nodes n"))
def a03deep(spark, sf):
    """A3 on a binary tree of all parts: as many levels as it has."""
    part = table(spark, sf, "part").where("p_partkey >= 2")
    return hierarchy(part.select(F.lit("part").alias("attr"), F.col("p_partkey").cast("string").alias("child"),
                                 F.floor(F.col("p_partkey") / 2).cast("string").alias("parent")))


@register("a08_distinct_sa", with_(PEOPLE_CTES, "SELECT DISTINCT workclass FROM pid_people WHERE workclass IS NOT NULL"))
def a08(spark, sf):
    return distinct_values(people_ids(spark, sf), "workclass")


# ---- one Mondrian round at the root ----------------------------------------------------------

_ROOT_CTES = PEOPLE_CTES + [("members", _members_sql(K_SCHEMA)), ("nl", _numeric_long_sql(K_SCHEMA)),
                            ("freq", "SELECT dim, v, sum(n) AS c FROM nl GROUP BY ALL")]


@register("a04_frequency_set", with_(_ROOT_CTES + [("cl", _categorical_long_sql(K_SCHEMA))],
                                     "SELECT 'r' AS pid, dim, CAST(v AS VARCHAR) AS v, c FROM freq UNION ALL "
                                     "SELECT 'r', dim, v, sum(n) FROM cl GROUP BY ALL"))
def a04(spark, sf):
    m = _root(spark, sf)
    num = MM.frequency_sets(MM.numeric_long(m, K_SCHEMA)).withColumn("v", F.col("v").cast("string"))
    cat = MM.frequency_sets(MM.categorical_long(m, K_SCHEMA))
    return num.unionByName(cat)


_MEDIAN_SQL = ("SELECT s.dim, s.total, s.nd, s.vmin, s.vmax, m.split, m.left_n, "
               "(SELECT min(f2.v) FROM freq f2 WHERE f2.dim = s.dim AND f2.v > m.split) AS nxt FROM "
               "(SELECT dim, sum(c) AS total, count(*) AS nd, min(v) AS vmin, max(v) AS vmax FROM freq GROUP BY dim) s JOIN "
               "(SELECT dim, min(v) AS split, min(cum) AS left_n FROM (SELECT dim, v, sum(c) OVER (PARTITION BY dim ORDER BY v) AS cum, "
               "sum(c) OVER (PARTITION BY dim) AS tot FROM freq) WHERE cum >= floor(tot / 2) GROUP BY dim) m ON m.dim = s.dim")


@register("a05_lower_median", with_(_ROOT_CTES, _MEDIAN_SQL))
def a05(spark, sf):
    m = _root(spark, sf)
    med = MM.lower_median(MM.frequency_sets(MM.numeric_long(m, K_SCHEMA)))
    return med.select("dim", "total", "nd", "vmin", "vmax", "split", "left_n", "nxt")


@register("a05_lower_median_bucketed", with_(_ROOT_CTES, _MEDIAN_SQL))
def a05b(spark, sf):
    """Same answer through the bounded-window path (every group narrowed by buckets first)."""
    m = _root(spark, sf)
    med = MM.lower_median(MM.frequency_sets(MM.numeric_long(m, K_SCHEMA)), window_limit=4, buckets=8)
    return med.select("dim", "total", "nd", "vmin", "vmax", "split", "left_n", "nxt")


@register("a06_l_diversity_check", with_(clean_ctes() + [
    ("g", "SELECT age_group, sex, workclass, count(*) AS c FROM clean WHERE workclass IS NOT NULL GROUP BY ALL")],
    f"SELECT age_group, sex, sum(c) AS class_size, count(*) AS distinct_sa, max(c) AS max_sa_count, "
    f"(sum(c) >= {L} AND count(*) >= {L} AND max(c) * {L} <= sum(c)) AS l_diverse FROM g GROUP BY age_group, sex"))
def a06(spark, sf):
    df = clean_people(spark, sf).where(F.col("workclass").isNotNull())
    cls = equivalence_classes(df, ["age_group", "sex"], "workclass")
    return cls.select("age_group", "sex", "class_size", "distinct_sa", "max_sa_count",
                      MM.l_diverse(F.col("class_size"), F.col("distinct_sa"), F.col("max_sa_count"), L).alias("l_diverse"))


def _root_decision_sql(schema: PrivacySchema, k: int) -> str:
    """Feasibility and width of every dim at the root, and the chosen dim."""
    rows = []
    for i, c in enumerate(schema.qi):
        if schema.is_numeric[i]:
            rows.append(f"SELECT {i} AS dim, CAST(1.0 AS DOUBLE) AS width, (floor(total / 2) >= {k} AND nd > 1 AND nxt IS NOT NULL "
                        f"AND total - left_n >= {k}) AS feasible FROM med WHERE dim = {i}")
        else:
            rows.append(f"SELECT {i} AS dim, CAST(1.0 AS DOUBLE) AS width, min(c) >= {k} AS feasible FROM "
                        f"(SELECT {c}, sum(n) AS c FROM members GROUP BY ALL)")
    return " UNION ALL ".join(rows)


@register("m02_choose_dimension", with_(_ROOT_CTES + [("med", _MEDIAN_SQL), ("dims", _root_decision_sql(K_SCHEMA, K))],
                                        "SELECT dim, width, feasible, dim = (SELECT min(dim) FROM dims WHERE feasible) AS chosen FROM dims"))
def m02(spark, sf):
    """M2-M4 at the root: width, feasibility of each dim, and the chosen one."""
    m = _root(spark, sf)
    dom = MM.domain(m, K_SCHEMA)
    members = m.select("*", *MM.root_state(K_SCHEMA, dom))
    spec, ranges = MM.MondrianSpec(schema=K_SCHEMA, k=K), MM.value_ranges(dom)
    dims = MM.dimensions(members, spec, ranges).alias("d")
    chosen = MM.evaluate_round(members, spec, ranges).select("ch")
    return dims.join(F.broadcast(chosen)).select("dim", F.col("w").alias("width"), F.col("feas").alias("feasible"), (F.col("dim") == F.col("ch")).alias("chosen"))


@register("m03_numeric_split", with_(_ROOT_CTES + [("med", _MEDIAN_SQL)],
                                     "SELECT n.dim, CASE WHEN n.v <= med.split THEN 'L' ELSE 'R' END AS side, sum(n.n) AS n "
                                     "FROM nl n JOIN med ON med.dim = n.dim GROUP BY ALL"))
def m03(spark, sf):
    """M3: sizes of the two halves of each numeric split at the root."""
    m = _root(spark, sf)
    nl = MM.numeric_long(m, K_SCHEMA)
    med = MM.lower_median(MM.frequency_sets(nl))
    return (nl.join(med.select("pid", "dim", "split"), ["pid", "dim"])
            .groupBy("dim", F.when(F.col("v") <= F.col("split"), "L").otherwise("R").alias("side"))
            .agg(F.sum("n").alias("n")))


@register("m04_categorical_split", with_(_ROOT_CTES + [("cl", _categorical_long_sql(K_SCHEMA))],
                                         f"SELECT dim, min(c) AS smallest_child, count(*) AS children, min(c) >= {K} AS feasible "
                                         "FROM (SELECT dim, v, sum(n) AS c FROM cl GROUP BY ALL) GROUP BY dim"))
def m04(spark, sf):
    m = _root(spark, sf)
    f = MM.frequency_sets(MM.categorical_long(m, K_SCHEMA))
    return f.groupBy("dim").agg(F.min("c").alias("smallest_child"), F.count(F.lit(1)).alias("children"),
                                (F.min("c") >= K).alias("feasible"))


@register("m07_l_diverse_numeric_split", with_(
    PEOPLE_CTES + [("members", _members_sql(L_SCHEMA)), ("nl", " UNION ALL ".join(
        f"SELECT {i} AS dim, CAST({c} AS DOUBLE) AS v, {L_SCHEMA.sa} AS sa, n FROM members" for i, c in enumerate(L_SCHEMA.qi) if L_SCHEMA.is_numeric[i])),
        ("freq", "SELECT dim, v, sum(n) AS c FROM nl GROUP BY ALL"), ("med", _MEDIAN_SQL),
        ("g", "SELECT nl.dim, v <= split AS low, sa, sum(n) AS c FROM nl JOIN med ON med.dim = nl.dim GROUP BY ALL"),
        ("h", f"SELECT dim, low, sum(c) AS size, count(*) AS distinct_sa, max(c) AS max_sa_count, "
              f"(sum(c) >= {L} AND count(*) >= {L} AND max(c) * {L} <= sum(c)) AS ok FROM g GROUP BY ALL")],
    "SELECT h.dim, split, low, size, distinct_sa, max_sa_count, ok FROM h JOIN med ON med.dim = h.dim"))
def m07(spark, sf):
    """M7: both halves of each numeric split at the root, and whether they are l-diverse."""
    m = MM.compress(people_ids(spark, sf), L_SCHEMA).withColumn("pid", F.lit("r"))
    med = MM.lower_median(MM.frequency_sets(MM.numeric_long(m, L_SCHEMA)))
    long = MM.numeric_long(m, L_SCHEMA, with_sa=True).join(med.select("pid", "dim", "split"), ["pid", "dim"])
    per = long.groupBy("dim", "split", (F.col("v") <= F.col("split")).alias("low"), "sa").agg(F.sum("n").alias("c"))
    side = per.groupBy("dim", "split", "low").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("distinct_sa"), F.max("c").alias("max_sa_count"))
    return side.withColumn("ok", MM.l_diverse(F.col("size"), F.col("distinct_sa"), F.col("max_sa_count"), L))


@register("m08_l_diverse_categorical_split", with_(
    PEOPLE_CTES + [("members", _members_sql(L_SCHEMA)), ("cl", _categorical_long_sql(L_SCHEMA, sa=True)),
                   ("g", "SELECT dim, v, sa, sum(n) AS c FROM cl GROUP BY ALL"),
                   ("h", f"SELECT dim, v, (sum(c) >= {L} AND count(*) >= {L} AND max(c) * {L} <= sum(c)) AS ok FROM g GROUP BY ALL")],
    "SELECT dim, bool_and(ok) AS feasible, count(*) AS children FROM h GROUP BY dim"))
def m08(spark, sf):
    m = MM.compress(people_ids(spark, sf), L_SCHEMA).withColumn("pid", F.lit("r"))
    g = MM._sa_groups(MM.categorical_long(m, L_SCHEMA, with_sa=True), ["pid", "dim", "v"], L)
    return g.groupBy("dim").agg((F.min(F.col("ok").cast("int")) == 1).alias("feasible"), F.count(F.lit(1)).alias("children"))


# ---- full Mondrian ---------------------------------------------------------------------------------

def _release(result: MM.MondrianResult):
    return result.generalized


@register("m01_mondrian_k", mondrian_release_sql(PEOPLE_CTES, K_SCHEMA, "pid_people", k=K))
def m01_mondrian_k(spark, sf):
    """M1: k-anonymous release (k=10, both halves guarded) in counted form (labels..., income, n)."""
    return _release(MM.k_anonymize(people_ids(spark, sf), K_SCHEMA, k=K))


@register("m03_mondrian_k_unguarded", mondrian_release_sql(PEOPLE_CTES, K_SCHEMA, "pid_people", k=K, guard=False))
def m03u(spark, sf):
    """M3 compat: the right half of a numeric split is not checked (classes may fall below k)."""
    return _release(MM.k_anonymize(people_ids(spark, sf), K_SCHEMA, k=K, guard=False))


@register("m05_mondrian_k_distributed", mondrian_release_sql(PEOPLE_CTES, K_SCHEMA, "pid_people", k=K))
def m05(spark, sf):
    """M5: the level-by-level loop with no in-task hand-off (same classes as m01)."""
    return _release(MM.k_anonymize(people_ids(spark, sf), K_SCHEMA, k=K, local_threshold=0))


@register("m06_generalize_rows", mondrian_rows_sql(PEOPLE_CTES, K_SCHEMA, "pid_people", k=K))
def m06(spark, sf):
    """M6: per-record release (8 columns of labels + SA), one row per complete input row."""
    df = people_ids(spark, sf)
    return MM.k_anonymize(df, K_SCHEMA, k=K).rows(df)


@register("m09_mondrian_l", mondrian_release_sql(PEOPLE_CTES, L_SCHEMA, "pid_people", l=L))
def m09(spark, sf):
    """M9: l-diverse release (l=2, SA workclass)."""
    return _release(MM.l_diversify(people_ids(spark, sf), L_SCHEMA, l=L))


@register("m09_mondrian_l_skewed_binary", mondrian_release_sql(PEOPLE_CTES, L_BINARY_SCHEMA, "pid_people", l=L))
def m09b(spark, sf):
    """M8 edge: l=2 over the skewed binary income never splits (one class)."""
    return _release(MM.l_diversify(people_ids(spark, sf), L_BINARY_SCHEMA, l=L))


@register("m01_lineitem_k", mondrian_release_sql([("li", lineitem_qi_sql())], LINEITEM_SCHEMA, "li", k=K))
def m01_lineitem(spark, sf):
    """M1 at scale: lineitem (quantity, linenumber, ship month; linestatus), SA returnflag, k=10."""
    return _release(MM.k_anonymize(lineitem_qi(spark, sf), LINEITEM_SCHEMA, k=K))


@register("m09_lineitem_l", mondrian_release_sql([("li", lineitem_qi_sql())], LINEITEM_SCHEMA, "li", l=L))
def m09_lineitem(spark, sf):
    return _release(MM.l_diversify(lineitem_qi(spark, sf), LINEITEM_SCHEMA, l=L))


@register("a07_ncp", mondrian_ncp_sql(PEOPLE_CTES, K_SCHEMA, "pid_people", k=K))
def a07(spark, sf):
    """Information loss (%) of the k=10 release with class count and minimum class size."""
    return MM.k_anonymize(people_ids(spark, sf), K_SCHEMA, k=K).ncp()


# ---- generalization along trees ------------------------------------------------------------------------

def _paths_sql(edges: str) -> list[tuple[str, str]]:
    """CTEs ending in ``<edges>_paths(value, path, widths)``, by walking up from each leaf."""
    up = (f"SELECT child AS value, child AS node, parent, [child] AS path FROM {edges} WHERE child NOT IN (SELECT parent FROM {edges}) "
          f"UNION ALL SELECT u.value, e.child, e.parent, list_prepend(e.child, u.path) FROM {edges}_up u JOIN {edges} e ON e.child = u.parent")
    return [(f"{edges}_up", up), (f"{edges}_steps", f"SELECT value, node FROM {edges}_up"),
            (f"{edges}_cover", f"SELECT node, CASE WHEN node IN (SELECT parent FROM {edges}) THEN count(DISTINCT value) ELSE 0 END AS n FROM {edges}_steps GROUP BY node"),
            (f"{edges}_paths", f"SELECT p.value, any_value(p.path) AS path, list_prepend(1.0::DOUBLE, list(c.n / (SELECT count(DISTINCT value) FROM {edges}_steps) ORDER BY pos)) AS widths "
                               f"FROM (SELECT value, path, unnest(path) AS node, unnest(range(len(path))) AS pos FROM {edges}_up WHERE parent = '*') p "
                               f"JOIN {edges}_cover c USING (node) GROUP BY p.value")]


_TREE_CTES = [("ord", ORDERS_QI_SQL), ("place_edges", PLACE_EDGES_SQL), ("priority_edges", PRIORITY_EDGES_SQL),
              *_paths_sql("place_edges"), *_paths_sql("priority_edges")]
_TREES = {"place": "place_edges_paths", "priority": "priority_edges_paths"}


def _tree_inputs(spark, sf):
    trees = {"place": sql_view(spark, sf, PLACE_EDGES_SQL), "priority": sql_view(spark, sf, PRIORITY_EDGES_SQL)}
    return sql_view(spark, sf, ORDERS_QI_SQL), trees


@register("a03_leaf_paths", with_recursive(_TREE_CTES, "SELECT value, path, widths FROM place_edges_paths"))
def a03_paths(spark, sf):
    """A3: path and covered shares of every leaf of a tree of four levels."""
    return leaf_paths(sql_view(spark, sf, PLACE_EDGES_SQL).withColumn("attr", F.lit("place"))).select("value", "path", "widths")


@register("m04_mondrian_k_trees", mondrian_release_sql(_TREE_CTES, TREE_SCHEMA, "ord", k=K, trees=_TREES))
def m04_trees(spark, sf):
    """M1/M4/M6 over orders: places generalize along nation, region and ``*``, priorities along their class and ``*``."""
    orders, trees = _tree_inputs(spark, sf)
    return _release(MM.k_anonymize(orders, TREE_SCHEMA, k=K, hierarchies=trees))


@register("m05_mondrian_k_trees_distributed", mondrian_release_sql(_TREE_CTES, TREE_SCHEMA, "ord", k=K, trees=_TREES))
def m05_trees(spark, sf):
    """The same with no in-task hand-off: every split in rounds."""
    orders, trees = _tree_inputs(spark, sf)
    return _release(MM.k_anonymize(orders, TREE_SCHEMA, k=K, hierarchies=trees, local_threshold=0))


@register("m08_mondrian_l_trees", mondrian_release_sql(_TREE_CTES, TREE_SCHEMA, "ord", l=L, trees=_TREES))
def m08_trees(spark, sf):
    """M9/M8 over orders and the same trees, sensitive order status."""
    orders, trees = _tree_inputs(spark, sf)
    return _release(MM.l_diversify(orders, TREE_SCHEMA, l=L, hierarchies=trees))


@register("a07_ncp_trees", mondrian_ncp_sql(_TREE_CTES, TREE_SCHEMA, "ord", k=K, trees=_TREES))
def a07_trees(spark, sf):
    """A7 over trees: a label loses the share of all leaves that it covers."""
    orders, trees = _tree_inputs(spark, sf)
    return MM.k_anonymize(orders, TREE_SCHEMA, k=K, hierarchies=trees).ncp()
