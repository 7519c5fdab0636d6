import hashlib
import math
import random

import numpy as np
import pytest

from umbra.llm import heap_kmeans as hk

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, block int"


def plain(rows, k, rounds, dim):
    """Every round over every vector, in whole numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= hk.LARGEST / 256 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cents = [[sum(x) // len(m) for x in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(cents)]
    last = [near(v) for _, v in kept]
    total = [sum(d for d, j in last if j == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, total[j], sum(total), sha[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def points(n, dim, seed, spread):
    r = random.Random(seed)
    mids = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [float(np.float32(x + r.gauss(0, spread))) for x in r.choice(mids)]) for i in range(n)]


@pytest.mark.parametrize("seed,k,rounds,spread", [(1, 7, 5, 0.3), (2, 12, 8, 0.05), (3, 1, 3, 0.3), (4, 5, 0, 0.3)])
def test_brute_force(spark, monkeypatch, seed, k, rounds, spread):
    monkeypatch.setattr(hk, "BLOCK", 16)
    rows = points(150, 4, seed, spread)
    rows += [(1000 + i, rows[0][1]) for i in range(60)]                                # a third are one vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[7][1])]    # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [0.1] * 3), (2003, [0.1] * 5), (2004, [0.1, None, 0.2, 0.3]),
             (2005, [0.1, math.nan, 0.2, 0.3]), (2006, [math.inf, 0.0, 0.0, 0.0]), (2007, [-math.inf, 0.0, 0.0, 0.0]), (2008, [3e38, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, hk.digest(frame, k, rounds, 4).collect()), key=str) == plain(rows, k, rounds, 4)


def test_ties(spark):
    """Vectors midway between centroids, on a small grid: the smaller number wins in every round."""
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate((a, b) for a in range(7) for b in range(7))]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, hk.digest(frame, 9, 6, 2).collect()), key=str) == plain(rows, 9, 6, 2)


def test_large_components(spark):
    r = random.Random(8)
    rows = [(i, [float(np.float32(r.uniform(-2e5, 2e5))) for _ in range(4)]) for i in range(40)]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, hk.digest(frame, 6, 4, 4).collect()), key=str) == plain(rows, 6, 4, 4)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(3, [0.5, 0.25], "x", 1, 2)], SCHEMA)
    assert hk.digest(frame, 40, 5, 2).collect()[0][:5] == (3, 0, 0, 0, 0)
    assert hk.digest(frame.limit(0), 40, 5, 2).count() == 0


def test_heaps_spare_work():
    """Once centroids hardly move, few vectors expire, and the clusters stay those of a full scan."""
    r = np.random.default_rng(1)
    mids = r.integers(-3000, 3000, (8, 16))
    x = mids[r.integers(0, 8, 2000)] + r.integers(-60, 60, (2000, 16))
    cents, drift, state, totals, seen = mids + r.integers(-40, 40, mids.shape), [0.0] * 8, None, [[0] * 17 for _ in range(8)], []
    for _ in range(5):
        heaps, delta, n = hk.rescan(x, state, cents, drift)
        seen.append(n)
        assert (heaps.clusters(len(x)) == hk.distances(x, cents).argmin(1)).all()
        if delta is not None:
            totals = [[a + b for a, b in zip(t, d)] for t, d in zip(totals, delta.tolist())]
        cents, drift = hk.moved(cents, totals, drift)
        state = heaps.written()
    assert seen[0] == 2000 and sum(seen[1:]) < 200


def test_rounds_shuffle_heaps_only(spark):
    """Blocks are joined by their buckets: the side with the vectors has no exchange."""
    from umbra.session import Stages
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in points(100, 4, 1, 0.1)], SCHEMA)
    stages = Stages(spark)
    table = hk.Blocks(spark, stages, hk.kept(frame, 4), 4)
    state = stages.write(hk._round(table.table(), hk.seeds(hk.kept(frame, 4), 3), [0.0] * 3, True))
    plan = table.table().join(state.drop("delta").hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    table.drop()
    stages.release()


def test_oracle(same_as_oracle):
    same_as_oracle("op13_heap_kmeans")
