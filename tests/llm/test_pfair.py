from fractions import Fraction
from itertools import islice

import pytest

from umbra.llm import pfair


def worst_lag(plan, weights, slots):
    """The most blocks that any source is ahead or behind of its target weight at any slot."""
    exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    at = {t: s for s, _, _, _, t in plan}
    done, worst = [0] * len(weights), Fraction(0)
    for t in range(slots):
        if t in at:
            done[at[t]] += 1
        worst = max(worst, *(abs(done[s] - (t + 1) * w) for s, w in enumerate(exact)))
    return worst


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.7137, 0.2863], [1, 1e-6], [97, 1, 1, 1], [0.5, 0.3, 0.2], [i + 1 for i in range(30)], [3 ** 0.5, 2 ** 0.5, 1.0, 1e-4]])
def test_lag_stays_below_a_block_of_the_target_weights(weights):
    slots = 100_000 if len(weights) < 5 else 20_000
    share = pfair.shares(weights)
    assert all(Fraction(s, sum(share)) == Fraction(w) / sum(map(Fraction, weights)) for s, w in zip(share, weights))
    blocks = [slots * s // sum(share) + 2 for s in share]
    plan, horizon = pfair.schedule(share, blocks)
    assert horizon >= slots and len({t for *_, t in plan}) == len(plan) == sum(blocks)
    assert all(r <= t < d for _, _, r, d, t in plan)
    assert {t for *_, t in plan} >= set(range(slots)) and worst_lag(plan, weights, slots) < 1


def test_many_sources():
    """20,000 sources: each block runs in its window, which is the same as a lag below a block."""
    share = pfair.shares([1 + i % 17 for i in range(20_000)])
    total = sum(share)
    plan, horizon = pfair.schedule(share, [100_000 * s // total + 1 for s in share])
    assert all(r <= t < d and (r, d) == pfair.window(i + 1, share[s], total) for s, i, r, d, t in plan) and horizon >= 1000


def test_a_source_that_runs_out_leaves_the_others_in_their_windows():
    plan, horizon = pfair.schedule([1, 1, 2], [2, 40, 80])
    assert all(r <= t < d for _, _, r, d, t in plan) and horizon == 11 and len(plan) == 122
    assert pfair.schedule([], []) == ([], 0)
    with pytest.raises(ValueError):
        pfair.shares([1, 0])


def test_all_rows_are_placed(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    out = pfair.scheduled(spark.createDataFrame(rows, "doc_id long, source string").repartition(7), block_docs=4).collect()
    assert sorted((r._row.doc_id, r._row.source) for r in out) == sorted(rows)
    assert len({r.mix_position for r in out}) == len(rows)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    sizes = {}
    for r in out:
        sizes.setdefault((r._row.source, r.mix_block), []).append(r)
    assert all(len(v) == 4 or k[1] == max(b for s, b in sizes if s == k[0]) for k, v in sizes.items())
    assert all(len({x.mix_slot for x in v}) == 1 for v in sizes.values())
    counts = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    names = sorted(counts)
    plan = [(names.index(s), b, 0, 0, v[0].mix_slot) for (s, b), v in sizes.items()]
    held = 1 + max(r.mix_slot for r in out if r.in_mix)
    assert worst_lag(plan, [counts[s] ** 0.5 for s in names], held) < 1


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_a_third_without_or_with_one_id(spark, ids, monkeypatch):
    """Rows that share an id, or have none, are spread over groups whether their texts differ or not."""
    n = 9000
    texts = spark.range(n).selectExpr(f"if(id % 3 = 0, {'null' if ids == 'null' else '5L'}, id + 10) AS doc_id", "'one' AS source",
                                      "if(id % 2 = 0, 'same text', concat('text ', id)) AS text").repartition(5)
    out = pfair.scheduled(texts)
    rows = out.collect()
    assert len({r.mix_position for r in rows}) == len(rows) == n
    assert sorted(str(r._row) for r in rows) == sorted(map(str, texts.collect()))
    salted = pfair._spread(pfair.packed(texts, _id=texts.doc_id, _s=pfair.source_key(texts.source), _h=pfair.F.xxhash64("doc_id", "source", "text")))
    groups = salted.groupBy(pfair.F.pmod(pfair.F.xxhash64("_id", "_h", "_salt", pfair.F.lit(9)), pfair.F.lit(47))).count().collect()
    assert max(g["count"] for g in groups) < n / 6


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(pfair, "MAX_SOURCES", 8)
    rows = [(i, f"s{i % 100}") for i in range(1000)]
    out = pfair.scheduled(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert sorted((r._row.doc_id, r._row.source) for r in out) == rows and len({r.mix_position for r in out}) == 1000


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(pfair, "SLOTS", 10)
    out = pfair.scheduled(spark.range(1000).selectExpr("id AS doc_id", "'s' AS source")).collect()
    assert max(r.mix_block for r in out) == 9 and sorted(r.mix_position for r in out) == list(range(1000))


def test_edges(edge_docs, edge_rows, no_docs):
    out = pfair.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, edge_docs.collect()))
    assert pfair.mixed(no_docs).count() == 0
    assert pfair.mixed(edge_docs, weights={"s0": 2.0, None: 1.0}, block_docs=2).count() == len(edge_rows)


def test_one_rule_at_every_size():
    """No size changes the blocks, and sources of one size are one entry of the schedule, however many they are."""
    assert {pfair.block_size(n) for n in (0, 1000, 1 << 25, 1 << 40)} == {pfair.BLOCK_DOCS}
    first = [s for *_, s in islice(pfair.planned([1, 5], [1, 9], [1 << 40, 1 << 30]), 1000)]
    assert first == list(range(1000))
    share, blocks, members = [1, 2, 7], [3, 6, 21], [5, 1, 3]
    plan = list(pfair.planned(share, blocks, members))
    total = sum(s * m for s, m in zip(share, members))
    assert len({(c, m, i) for c, m, i, *_ in plan}) == len(plan) == sum(b * m for b, m in zip(blocks, members))
    assert all((r, d) == pfair.window(i + 1, share[c], total) and r <= t < d for c, m, i, r, d, t in plan)
    assert [t for *_, t in plan] == list(range(3 * total))


def test_places_do_not_depend_on_partitions(spark):
    """Also not where more equal rows than a group holds are parted by number."""
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "if(id % 5 = 1, 'b', 'a') AS source")
    places = [sorted((str(r._row), r.mix_position, r.in_mix) for r in pfair.scheduled(d).collect())
              for d in (rows.repartition(3), rows.repartition(11, "source"), rows.orderBy(pfair.F.desc("id")).coalesce(1))]
    assert places[0] == places[1] == places[2] and len({p for _, p, _ in places[0]}) == 4000


@pytest.mark.parametrize("weights", [None, {"s1": 3.0, "s2": 1.0, None: 0.25}])
def test_a_mixed_table_holds_its_places(spark, weights):
    """The order of the files and rows is that of the schedule, with the same end of the mix; another order is read as it is."""
    docs = spark.range(2500).selectExpr("id AS doc_id", "if(id % 97 = 0, null, concat('s', cast(sqrt(id) / 7 as int))) AS source")
    want = pfair.scheduled(docs, weights).orderBy("mix_position").select("_row.doc_id", "in_mix").collect()
    table = pfair.cut_lineage(pfair.mixed(docs, weights=weights))
    got = sorted(pfair.placed(table, weights).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(2500))
    assert [(r._row.doc_id, r.in_mix) for r in got] == [tuple(r) for r in want]
    assert 0 < sum(r.in_mix for r in got) < 2500
    back = pfair.placed(pfair.cut_lineage(docs.orderBy(pfair.F.desc("doc_id"))))
    assert all(r.mix_position == 2499 - r._row.doc_id for r in back.collect())
    assert sorted(r.mix_position for r in pfair.placed(docs).collect()) == list(range(2500))
