import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from umbra.llm import sketches


def plain(text, k=sketches.K):
    """Bottom-k sketch, hashed as Spark hashes arrays: each word's hash seeds the next."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [words[i:i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    out = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h & (1 << 63) - 1)
    return sorted(out)[:k], out


def near(a, b, k=sketches.K):
    u = sorted(set(a) | set(b))[:k]
    return 1.0 if not u else sum(x in a and x in b for x in u) / len(u)


def expected(rows):
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, e, b = plain(t)[0], plain(edited)[0], plain(nxt)[0]
        hexes = lambda s: "".join(f"{x:016x}" for x in s)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(e), round(near(a, e), 9), round(near(a, b), 9)))
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in sketches.edited_and_next(df).collect()), key=str)


def test_edge_rows(edge_docs, edge_rows):
    assert got_of(edge_docs) == expected([(r[0], r[1]) for r in edge_rows])


def test_many_buckets(spark):
    rows = [(i * i * 7 % 100_003, f"text number {i} with a few words " * (i % 5)) for i in range(600)]
    assert got_of(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


@pytest.mark.parametrize("case", ["far", "null", "hot", "null equal", "hot equal"])
def test_uneven_ids(spark, monkeypatch, case):
    """One far id, a third of null ids, or a third with one id, with different or equal texts: right, and no bucket has them all."""
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 16)
    n = 900
    text = lambda i: "the same few words again and again here" if "equal" in case and i % 3 == 0 else f"text number {i} with a few words " * (i % 4)
    ids = {"far": lambda i: 10 ** 15 if i == 0 else i, "null": lambda i: None if i % 3 == 0 else i, "hot": lambda i: 77 if i % 3 == 0 else i}[case.split()[0]]
    rows = [(ids(i), text(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_of(df) == expected(rows)
    keyed = df.select("doc_id", F.xxhash64(F.col("text")).alias("_h"))
    assert sketches._buckets(keyed, "doc_id").groupBy("_b", "_c", "_z").count().agg(F.max("count")).first()[0] < n / 6


def test_small_tables(spark, no_docs):
    assert sketches.edited_and_next(no_docs).count() == 0
    one = sketches.edited_and_next(spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 18


def test_merge_and_estimates(spark):
    rows = [(p, " ".join(f"w{i}" for i in range(p * 300, p * 300 + 500))) for p in range(6)]
    df = sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    merged = sketches.merge_groups(df.withColumn("g", F.lit(1)), "g", "sketch").first().sketch
    union = set().union(*(plain(t)[1] for _, t in rows))
    assert merged == sorted(union)[:sketches.K]
    estimate = spark.createDataFrame([(merged,)], "s array<bigint>").select(sketches.distinct_count(F.col("s"))).first()[0]
    assert abs(estimate / len(union) - 1) < 0.4
    pair = df.where("doc_id = 0").select(F.col("sketch").alias("a")).crossJoin(df.where("doc_id = 1").select(F.col("sketch").alias("b")))
    j, c = pair.select(sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("a"), F.col("b"))).first()
    assert abs(j - 196 / 796) < 0.2 and abs(c - 196 / 496) < 0.25
