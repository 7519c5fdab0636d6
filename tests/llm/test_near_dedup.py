import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from umbra.llm import darts, near_dedup
from umbra.llm.components import components


def weighted(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {k: 1 + math.log(v) for k, v in Counter(runs).items()}


def jaccard(a, b):
    low = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 1.0


def plain_classes(rows, threshold=0.8):
    """Smallest id of the connected component, from every pair that shares a shingle."""
    sets, parent = [weighted(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by, links = defaultdict(list), set()
    for n, s in enumerate(sets):
        for k in s or [None]:
            by[k].append(n)
    for own in by.values():
        links |= {(a, b) for i, a in enumerate(own) for b in own[i + 1:]}
    for a, b in links:
        if find(a) != find(b) and jaccard(sets[a], sets[b]) >= threshold:
            parent[find(a)] = find(b)
    out = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        out[find(n)].append(near_dedup.NO_ID if i is None else i)
    real = {r: min((x for x in own if x != near_dedup.NO_ID), default=near_dedup.NO_ID) for r, own in out.items()}
    return Counter((rows[n][0], real[find(n)]) for n in range(len(rows)))


def got_classes(df):
    rows = near_dedup.classes(df).collect()
    return Counter((r.doc_id, near_dedup.NO_ID if r.class_id is None else r.class_id) for r in rows), len(rows)


def family(seed, n, length=120, edits=2):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(length)]
    for _ in range(n):
        own = base[:]
        for _ in range(r.randint(0, edits)):
            own[r.randrange(length)] = f"x{r.randint(0, 10**6)}"
        yield " ".join(own)


def test_signature_estimates_weighted_similarity():
    texts = list(family(1, 12, 200, 12)) + ["a b c d e f " * 30, "a b c d e f " * 10 + "g h i j k"]
    own, h, n = darts.multisets(*darts.Shingler().shingles(texts))
    sig = darts.signatures(len(texts), own, h, n, 512)
    sets = [weighted(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            assert abs((sig[a] == sig[b]).mean() - jaccard(sets[a], sets[b])) < 0.12


def test_shingles_do_not_depend_on_the_batch():
    texts = ["one two", "", "a b c d e f", None or "", "é ü ß ç ñ", "x " * 3000]
    own, h = darts.Shingler().shingles(texts)
    for t, text in enumerate(texts):
        assert sorted(darts.Shingler().shingles([text])[1]) == sorted(h[own == t])
    sets = [len(set(h[own == t].tolist())) for t in range(len(texts))]
    assert sets == [len(weighted(t)) for t in texts]


def test_similarity():
    a, b = weighted("a b c d e f g a b c d e"), weighted("a b c d e f h")
    own, h, n = darts.multisets(*darts.Shingler().shingles(["a b c d e f g a b c d e", "a b c d e f h"]))
    assert abs(darts.similarity(h[own == 0], n[own == 0], h[own == 1], n[own == 1]) - jaccard(a, b)) < 1e-12


@pytest.mark.parametrize("block", [1024, 6])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0 if block == 6 else 500_000)
    rows = list(enumerate([*family(2, 40, 100, 3), *family(3, 15, 60, 1), *family(4, 10, 30, 0), *("short text", "short text", "other text")], 10))
    random.Random(0).shuffle(rows)
    got, n = got_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert n == len(rows) and got == plain_classes(rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got, n = got_classes(edge_docs)
    assert n == len(edge_rows) and got == plain_classes([(r[0], r[1]) for r in edge_rows])
    assert near_dedup.classes(no_docs).count() == 0
    rows = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "k l m n o p q r"), (None, "k l m n o p q s t u v")]
    assert got_classes(spark.createDataFrame(rows, "doc_id long, text string"))[0] == plain_classes(rows) == Counter([(1, 1), (1, 1), (2, 1), (None, near_dedup.NO_ID)])


def test_ids_do_not_link_texts(spark):
    def text(seed, edits=0):
        words = [f"w{seed}_{i}" for i in range(60)]
        return " ".join(words[:60 - edits] + ["x"] * edits)

    rows = [(5, text(1)), (9, text(2)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(4)), (None, text(4, 1)),
            (7, text(5)), (7, text(6)), (8, text(6, 1)), (7, text(6))]
    want = [{0, 2}, {1, 3}, {4}, {5, 6}, {7}, {8, 9, 10}]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert got == Counter((rows[i][0], min((rows[j][0] for j in own if rows[j][0] is not None), default=None)) for own in want for i in own)
    assert len({r.class_key for r in near_dedup.classes(docs).collect()}) == len(want)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()]
    assert Counter(kept) - Counter([(None, text(4)), (None, text(4, 1))]) == Counter([rows[0], rows[1], rows[4], rows[7], rows[8]]) and len(kept) == len(want)


def test_recall_on_documents(spark):
    """Of all pairs of documents (by every shared shingle), those of similarity 0.8 and more are in one class."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got, n = got_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    want = plain_classes(rows)
    assert n == len(rows) and sum((got & want).values()) >= 0.99 * n


def test_hot_bucket(spark, monkeypatch):
    """Templated pages share a bucket: near copies are found in linear rounds, and pages that differ are told apart; no block
    is written once for each other one."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    r = random.Random(8)
    template = [f"t{i}" for i in range(150)]

    def page(n, own):
        return " ".join(template + [f"p{n}_{i}" for i in range(own)])

    rows = [(i, page(0, 30) + " " + " ".join(r.choice("abc") for _ in range(3))) for i in range(400)]          # one class
    rows += [(1000 + i, page(i, 60)) for i in range(150)] + [(2000 + i, page(i, 60) + " end") for i in range(150)]      # pairs; others below 0.8
    rows += [(None, page(7, 60)) for _ in range(100)]
    r.shuffle(rows)
    written = []
    monkeypatch.setattr(near_dedup, "in_blocks", lambda live, turn, f=near_dedup.in_blocks: (lambda out: (written.append((live.count(), out.count())), out)[1])(f(live, turn)))
    got, n = got_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert n == len(rows) and got == plain_classes(rows)
    assert written and all(b == a for a, b in written)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 20)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(20)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert np.uint64(1) == darts.U(1)
