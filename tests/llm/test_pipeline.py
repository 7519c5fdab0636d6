import random
import re
from collections import Counter

import corpus_pipeline
from umbra.llm import bpe, near_dedup, pfair, registry
from umbra.session import cut_lineage

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tas", "vu") for b in ("bel", "dor", "fin", "gam", "hus", "jip", "nol")]


def test_stages_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = cut_lineage(stage(spark, docs, sf))
        assert docs_out.schema.names == docs.schema.names and [f.dataType for f in docs_out.schema] == [f.dataType for f in docs.schema]
        if name == "near_duplicates":
            smallest = {r.class_id for r in near_dedup.classes(docs).collect()}
            assert {r.doc_id for r in docs_out.collect()} == smallest
        else:
            assert name == "language" or docs_out.count() == docs.count()
        docs = docs_out
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] == ids[1] > ids[2] == ids[3] == ids[4]
    enc = bpe.load(bpe.RANKS)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in registry.Q["pipeline"](spark, sf).collect()) == want


def test_edges(spark, edge_docs, no_docs):
    for start in (edge_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, None))
            assert docs.columns == start.columns
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and not set(left) & {100, 101, 102, 104}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == len(left)


def test_the_mix_reaches_the_result(spark, tmp_path):
    r = random.Random(4)
    sizes = {"big": 700, "mid": 150, "small": 60}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, f"The {' '.join(r.choices(WORDS, k=25))} {r.randint(0, 10**9)}.", r.choice(("en", "de")), s, 0) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: x.mix_position)
    assert len(got) > 800 and len({x.mix_position for x in got}) == len(got)
    left = Counter(names[x.doc_id] for x in got)
    target = pfair.tempered({s: left[s] for s in sizes}, 0.5)
    inside = [x for x in got if x.in_mix]
    assert inside == got[:len(inside)] and 0 < len(inside) < len(got)
    done = Counter()
    for n, x in enumerate(inside, 1):
        done[names[x.doc_id]] += 1
        assert all(abs(done[s] - n * target[s] / sum(target.values())) < pfair.BLOCK_DOCS + 1 for s in sizes)


def test_tokens_follow_the_mixing_stage(spark, tmp_path):
    """The last stage reads the places that mixing stored: another order of the table gives other places."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "0 AS n_chars")
    mixed = cut_lineage(corpus_pipeline.mixing(spark, docs, None))
    order = pfair.scheduled(docs).orderBy("mix_position").select("_row.doc_id").collect()
    places = {r.doc_id: r.mix_position for r in corpus_pipeline.tokens(spark, mixed, None).collect()}
    assert [places[r.doc_id] for r in order] == list(range(300))
    other = cut_lineage(docs.orderBy("doc_id"))
    assert all(r.mix_position == r.doc_id for r in corpus_pipeline.tokens(spark, other, None).collect())


def test_mixing_deals_out_whole_rows_no_more_than_it_must(spark, edge_docs):
    """Without broadcasts: to their sources, into groups of these, and in order. The schedule meets the groups, not the rows."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pfair.mixed(edge_docs.select("doc_id", "text", "source"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [x for x in plan.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", x) and "_row#" in x.split("Arguments")[0]]
    assert len(moved) == 3
