"""Weighted likeness and the indexed join, against plain Python and all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from umbra.functions.countries import continent_of
from umbra.functions.similarity import grams, weighted
from umbra.operators.fuzzy import fuzzy_best, fuzzy_lookup, fuzzy_pairs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    n = max(len(a), len(b))
    return 100 * (1 - lev(a, b) / n) if n else 0.0


def partial(a, b):
    s, t = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    return max(100 * (1 - lev(s, t[i:i + len(s)]) / len(s)) for i in range(len(t) - len(s) + 1)) if s else 0.0


def plain(a, b):
    if not a or not b:
        return 0.0
    ta, tb = sorted(x for x in a.split(" ") if x), sorted(x for x in b.split(" ") if x)
    both = " ".join(sorted(set(ta) & set(tb)))
    xa, xb = ((both + " " + " ".join(sorted(set(p) - set(q)))).strip() for p, q in ((ta, tb), (tb, ta)))
    ja, jb = " ".join(ta), " ".join(tb)
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < 1.5:
        sets = [ratio(xa, xb)] + ([ratio(both, xa), ratio(both, xb)] if both else [])
        return max(ratio(a, b), 0.95 * max(ratio(ja, jb), *sets))
    scale = 0.9 if far < 8 else 0.6
    return max(ratio(a, b), partial(a, b) * scale, max(partial(ja, jb), 100.0 if both else partial(xa, xb)) * scale * 0.95)


@pytest.fixture(scope="module")
def strings():
    r = random.Random(2)
    words = ["north", "south", "land", "new", "korea", "a", "b", "ab", "isle", "of", "republic", "é", "x"]
    out = {" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)}
    for s in list(out)[:40]:
        i = r.randrange(len(s))
        out.add(s[:i] + r.choice("abx ") + s[i + r.randint(0, 1):])
    return sorted(out | {"a", "é", "  spaced  out ", " ", "xax", "UPPER land"})


def test_scores(spark, strings):
    r = random.Random(3)
    pairs = [(r.choice(strings), r.choice(strings)) for _ in range(600)] + [("", "a"), ("a", "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", weighted(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        assert x.s == pytest.approx(plain(x.a, x.b)), x


def test_join_equals_all_pairs(spark, strings):
    left = spark.createDataFrame([(s, 1) for s in strings[::2]] + [(None, 1), ("", 1)], "v string, entry int")
    right = spark.createDataFrame([(s, 1) for s in strings] + [(None, 1)], "d string, value int")
    got = {(x.value, x.entry): x.score for x in fuzzy_pairs(left, "v", right, "d").collect()}
    want = {}
    for a in {s.lower() for s in strings[::2]}:
        for b in {s.lower() for s in strings}:
            if plain(a, b) >= 80:
                want[a, b] = plain(a, b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {x.value: x.entry for x in fuzzy_best(left, "v", right, "d").collect()}
    assert best == {a: min((-s, b) for (x, b), s in want.items() if x == a)[1] for a in {a for a, _ in want}}
    assert fuzzy_pairs(left.limit(0), "v", right, "d").count() == 0
    with pytest.raises(ValueError):
        fuzzy_pairs(left, "v", right, "d", 50.0)


def test_lookup_keeps_rows(spark):
    df = spark.createDataFrame([(1, "Columbia"), (2, "Holand Netherlands"), (3, None), (4, "Qwxyz"), (5, "Columbia")], "id int, c string")
    names = spark.createDataFrame([("Colombia",), ("Netherlands",), ("Hong Kong",)], "name string")
    got = {r.id: r.match for r in fuzzy_lookup(df, "c", names, "name").collect()}
    assert got == {1: "colombia", 2: "netherlands", 3: None, 4: None, 5: "colombia"}


def test_countries(spark):
    df = spark.createDataFrame([("Hong",), ("Holand-Netherlands",), ("Columbia",), ("South",), ("Trinadad&Tobago",), ("zzz",)], "c string")
    got = {r.c: r.k for r in df.select("c", continent_of(F.col("c")).alias("k")).collect()}
    assert got == {"Hong": "AS", "Holand-Netherlands": "EU", "Columbia": "SA", "South": "Other", "Trinadad&Tobago": "NA", "zzz": "Other"}


def test_grams(spark):
    got = spark.createDataFrame([("ab a",)], "s string").select(grams(F.col("s"))).first()[0]
    assert set(got) == {"^a", "ab", "b$", "a$"}
