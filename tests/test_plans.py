"""Plan-shape guards: pruned scans, no nested-loop / cartesian joins in a Mondrian round."""

from pyspark.sql import functions as F

from paths import SF_SMALL
from umbra.operators import mondrian as MM
from umbra.operators.cleaning import clean
from umbra.plans.q_mondrian import LINEITEM_SCHEMA as S
from umbra.sources.fixtures import lineitem_qi, people


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_scan_is_pruned(spark):
    plan = clean(people(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan                     # column never needed, never read


def test_round_has_only_equi_joins(spark):
    members = MM.cut_lineage(MM.compress(lineitem_qi(spark, SF_SMALL), S).withColumn("pid", F.lit("r")))
    dom = MM.domain(members, S)
    members = members.select("*", *MM.root_state(S, dom))
    plan = _plan(MM.evaluate_round(members, MM.MondrianSpec(schema=S, k=10), MM.value_ranges(dom), windows_fit=True))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan   # a round stays JVM-side


def test_round_reads_members_twice(spark):
    """Once for the frequencies of all dims, shared by both kinds, and once to route the tuples."""
    members = MM.compress(lineitem_qi(spark, SF_SMALL), S).withColumn("pid", F.lit("r"))
    dom = MM.domain(members, S)
    members = MM.cut_lineage(members.select("*", *MM.root_state(S, dom)))
    for spec in (MM.MondrianSpec(schema=S, k=10), MM.MondrianSpec(schema=S, l=2)):
        ranges = MM.value_ranges(dom)
        decisions = F.broadcast(MM.evaluate_round(members, spec, ranges, windows_fit=True))
        routed = MM._routed(members, decisions, spec, ranges, {}, [*S.columns, "n"])
        rows = routed.collect()
        final = routed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(rows) and final.count("FileScan parquet") - final.count("ReusedExchange") <= 2, final
