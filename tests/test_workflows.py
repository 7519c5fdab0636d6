"""The file pipeline and the streaming ingest: names per file, replay, ledger, budget, events."""

import json

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from umbra.functions.noise import NoiseKey
from umbra.operators.ledger import BudgetExceeded, ReleaseReused, read_ledger
from umbra.plans.workflows import run_pipeline
from umbra.sources.artefacts import artefact_name, read_events
from umbra.sources.census import census_lines
from umbra.sources.fixtures import people
from umbra.streaming.ingest import ingest

KEY = NoiseKey("test secret", "test")


def _lines(spark, path, where):
    rows = [r.value for r in census_lines(people(spark, SF_SMALL).where(where)).collect()]
    path.write_text("\n".join(rows) + "\n")
    return len(rows)


def test_names():
    assert artefact_name("/x/adult.data", "anon_k", k=5) == "adult_anon_k5"
    assert artefact_name("a.b.csv", "dp", epsilon=0.3) == "a_b_dp_e0_30"
    with pytest.raises(ValueError):
        artefact_name("x.csv", "other")


def test_ingest_two_files_and_replay(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    _lines(spark, landing / "first.csv", "person_id % 2 = 0")
    _lines(spark, landing / "second.csv", "person_id % 2 = 1")
    (landing / "notes.txt").write_text("not a data file\n")
    ingest(spark, str(landing), str(out), str(tmp_path / "ck1"), KEY, k=3)
    names = {p.name for p in out.iterdir() if not p.name.startswith("_")}
    assert names == {f"{f}_{kind}" for f in ("first", "second") for kind in ("clean", "anon_k3", "anon_l2", "dp_e0_30")}
    read = lambda: {n: sorted(map(str, spark.read.parquet(str(out / n)).collect())) for n in names}
    before, events = read(), read_events(spark, str(out)).collect()
    assert len(events) == 2 and all(len(json.loads(e.value)["clean_file_paths"]) == 4 for e in events)
    # a lost checkpoint runs the batch again: the same files, noise, events and ledger
    ingest(spark, str(landing), str(out), str(tmp_path / "ck2"), KEY, k=3)
    assert read() == before
    assert sorted(e.value for e in read_events(spark, str(out)).collect()) == sorted(e.value for e in events)
    assert read_ledger(spark, str(out / "_ledger")).groupBy("release_id").agg(F.sum("epsilon").alias("e")).where("abs(e - 0.3) > 1e-9").count() == 0


def test_budget_and_reuse(spark, tmp_path):
    _lines(spark, tmp_path / "adult.data", "person_id % 3 = 0")
    run = lambda version, **kw: run_pipeline(spark, str(tmp_path / "adult.data"), str(tmp_path / "out"), version, KEY, k=3, budget=0.7, **kw)
    assert {r.artefact: r.rows for r in run("v1").manifest.collect()}["clean"] > 0
    with pytest.raises(ReleaseReused):
        run("v1")
    run("v2")
    with pytest.raises(BudgetExceeded):
        run("v3")
    one, two = (spark.read.parquet(str(tmp_path / "out" / "adult_dp_e0_30")).where(F.col("version_id") == v) for v in ("v1", "v2"))
    assert sorted(r.age for r in one.collect()) != sorted(r.age for r in two.collect())


def _entry(spark, release, epsilon=0.4, mechanism="laplace", delta=0.0):
    from umbra.operators.ledger import ledger_frame
    from umbra.operators.noisy import LedgerEntry
    return ledger_frame(spark, [LedgerEntry(mechanism, "x", epsilon, delta, 1.0)], release)


def test_concurrent_releases_cannot_overspend(spark, tmp_path, monkeypatch):
    """Both read the ledger before either writes; the loser of the race checks again and is refused."""
    import threading
    from umbra.operators import ledger as L
    path, gate, got = str(tmp_path / "ledger"), threading.Barrier(2, timeout=60), {}
    read, first = L._entries, threading.local()

    def wait(*a):
        out = read(*a)
        if not getattr(first, "done", False):
            first.done = True
            gate.wait()
        return out

    monkeypatch.setattr(L, "_entries", wait)

    def release(name):
        try:
            got[name] = L.commit(_entry(spark, name, 0.6), path, budget=1.0)
        except L.BudgetExceeded as exc:
            got[name] = exc

    threads = [threading.Thread(target=release, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(isinstance(x, Exception) for x in got.values()) == [False, True]
    monkeypatch.undo()
    assert L.read_ledger(spark, path).count() == 1 and len(list((tmp_path / "ledger").glob("*"))) == 1
    assert L.commit(_entry(spark, "c", 0.4), path, budget=1.0) == 2


@pytest.mark.parametrize("damage", ["garbage", "altered", "missing", "foreign", "empty"])
def test_a_damaged_ledger_stops_releases(spark, tmp_path, damage):
    from umbra.operators.ledger import LedgerDamaged, commit
    path = tmp_path / "ledger"
    assert read_ledger(spark, str(path)).count() == 0
    for name in "abc":
        commit(_entry(spark, name, 0.1), str(path), budget=1.0)
    files = sorted(path.glob("entry-*.json"))
    if damage == "garbage":
        files[1].write_text("no json")
    elif damage == "altered":
        files[0].write_text(files[0].read_text().replace("0.1", "0.0"))
    elif damage == "missing":
        files[1].unlink()
    elif damage == "empty":
        files[2].write_text("")
    else:
        (path / "part-0000.parquet").write_text("x")
    with pytest.raises(LedgerDamaged):
        read_ledger(spark, str(path)).collect()
    with pytest.raises(LedgerDamaged):
        commit(_entry(spark, "d", 0.1), str(path), budget=100.0)


def test_reuse_of_a_stored_release(spark, tmp_path):
    from umbra.operators.ledger import commit
    path = str(tmp_path / "ledger")
    assert commit(_entry(spark, "a"), path) == 1 and commit(_entry(spark, "b"), path) == 2
    with pytest.raises(ReleaseReused):
        commit(_entry(spark, "a"), path)
    assert commit(_entry(spark, "a"), path, budget=0.1, reuse=True) == 2 and read_ledger(spark, path).count() == 2


def test_composition_matches_closed_forms(spark):
    """n Gaussian releases are one of n times the divergence; n Laplace ones add their closed form; both beat addition."""
    import math
    from umbra.operators.ledger import ORDERS, LEDGER_SCHEMA, check_budget, composed_epsilon, renyi_curve
    n, delta = 200, 1e-6
    frame = lambda m, e, d: spark.createDataFrame([(str(i), m, "x", e, d, 1.0) for i in range(n)], LEDGER_SCHEMA)

    def closed(curve):
        return min(max(0.0, curve(a) + math.log((a - 1) / a) - (math.log(delta) + math.log(a)) / (a - 1)) for a in ORDERS)

    sigma = math.sqrt(2 * math.log(1.25 / 1e-9)) / 0.05
    got = composed_epsilon(frame("gaussian", 0.05, 1e-9), delta).first()
    assert got["epsilon_composed"] == pytest.approx(closed(lambda a: n * a / (2 * sigma ** 2)), rel=1e-9) and got["epsilon_composed"] < 0.5 * got["epsilon_sequential"]
    e = 0.05
    lap = lambda a: math.log(a / (2 * a - 1) * math.exp((a - 1) * e) + (a - 1) / (2 * a - 1) * math.exp(-a * e)) / (a - 1)
    curve = {r["order"]: r["loss"] for r in renyi_curve(frame("laplace", e, 0.0)).collect()}
    assert all(curve[float(a)] == pytest.approx(n * min(lap(a), e, a * e * e / 2), rel=1e-6) for a in ORDERS if a < 1000)
    got = composed_epsilon(frame("laplace", e, 0.0), delta).first()
    assert got["epsilon_composed"] < 0.6 * n * e and got["releases"] == n
    # one release loses what it says; a delta of an unknown kind has no bound
    assert composed_epsilon(frame("laplace", 0.3, 0.0).limit(1), delta).first()["epsilon_composed"] <= 0.3
    assert composed_epsilon(frame("other", 0.3, 1e-5), 1e-6).first()["epsilon_composed"] is None
    with pytest.raises(BudgetExceeded):
        check_budget(frame("laplace", e, 0.0), 2.0, delta=delta)
    assert check_budget(frame("laplace", e, 0.0), 7.0, delta=delta) < 7.0 < n * e
    assert check_budget(frame("laplace", e, 0.0).limit(0), 1.0, delta=delta) == 0
