import hashlib
import random
import re

import pytest

from umbra.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(10, len(b))
        grams = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in grams:
                hit |= set(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta alpha alpha beta"), (2, "Two, WORDS!"), (10, "two words"), (None, "gamma\tdelta"),
         (3, None), (4, ""), (5, " ?! "), (6, "Ünïcode ÀB çd"), (6, "lorem ipsum dolor"), (7, "x" * 50_000), (None, None)]


@pytest.fixture(scope="module")
def rows(edge_rows):
    r = random.Random(5)
    vocab = "alpha beta gamma delta epsilon zeta eta theta two words ünïcode Àb çd".split()
    mixed = [(200 + i, " ".join(r.choice(vocab) + r.choice(["", "!", ",", "_"]) for _ in range(r.choice([3, 12, 200])))) for i in range(60)]
    planted = [(300, "before Alpha BETA gamma delta. epsilon-zeta eta theta alpha; alpha beta after"), (301, "alpha beta gamma delta epsilon zeta eta theta alpha"),
               (302, "ünïcode Àb çd"), (303, "ünïcode Àb ÇD"), (304, "\0two\0words"), (305, "twowords two wordsx")]
    return [(r[0], r[1]) for r in edge_rows] + mixed + planted


@pytest.mark.parametrize("max_windows", [dc.MAX_WINDOWS, 0])
def test_brute_force(spark, rows, max_windows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, size string")
    got = sorted(map(tuple, dc.digest(docs, items, max_windows=max_windows).collect()), key=str)
    assert got == sorted(((i, *plain(t, ITEMS)) for i, t in rows), key=str)


def test_windows_of_several_texts_do_not_join(spark):
    docs = spark.createDataFrame([(1, "two"), (2, "words"), (3, "two words")], "doc_id long, text string").coalesce(1)
    got = dc.digest(docs, spark.createDataFrame([(1, "two words")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 0), (2, 0), (3, 2)]


def test_pieces(monkeypatch):
    """Words and windows of a long text do not depend on the size of the pieces."""
    r = random.Random(3)
    text = " ".join("w" * r.randint(1, 60) + str(r.randint(0, 99)) for _ in range(500)).encode()
    whole = dc.Hasher().words(text)
    monkeypatch.setattr(dc, "PIECE", 37)
    cut = dc.Hasher().words(text)
    # a word's hash does not depend on where it stands
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
    assert whole[0][0] == dc.Hasher().words(b"?? " + text)[0][0]


@pytest.mark.parametrize("max_windows", [dc.MAX_WINDOWS, 0])
def test_removed(spark, max_windows):
    rows = [(1, "Keep this part, é: two WORDS! and this one too, all of it.", 5), (2, "Two words", 6), (3, None, 7), (4, "clean", 8), (None, "clean", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = {r._row: r.text for r in dc.removed(docs, items, max_windows=max_windows).collect()}
    assert got == {5: "Keep this part, é: ! and this one too, all of it.", 7: None, 8: "clean", 9: "clean"}
    assert {r._row for r in dc.removed(docs, items, max_hit=0, max_windows=max_windows).collect()} == {7, 8, 9}


def test_empty(spark, no_docs, edge_docs, edge_rows):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert dc.digest(no_docs, no_items).count() == 0
    got = dc.digest(edge_docs, no_items).collect()
    assert len(got) == len(edge_rows) and not any(r.contaminated for r in got)


def test_oracle(same_as_oracle):
    same_as_oracle("op12_decontamination")
