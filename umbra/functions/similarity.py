"""Weighted string likeness (C13): whole, partial and token ratios of edit distance, as columns and as DuckDB SQL.

All scores lie in 0..100. ``ratio`` compares whole strings, ``partial`` the shorter one with every window of its length
in the longer, the token forms compare words in sorted order, and words apart from the common ones. Strings of
about one length (below ``LONGER``) are scored by the whole and token ratios, others by the partial ones, scaled down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the usual weighted ratio.
TOKEN_WEIGHT, PARTIAL_WEIGHT, FAR_WEIGHT = 0.95, 0.9, 0.6
LONGER, FAR = 1.5, 8.0


def ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest)).otherwise(0.0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partial(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a window of the longer."""
    swap = F.length(a) > F.length(b)

    def best(x):
        n = F.length(x["s"])
        gaps = F.transform(F.sequence(F.lit(1), F.length(x["t"]) - n + 1), lambda i: F.levenshtein(x["s"], F.substring(x["t"], i, n)))
        return F.when(n > 0, F.lit(100.0) * (F.lit(1.0) - F.array_min(gaps) / n)).otherwise(0.0)

    return _let(F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("t")), best)


def _words(c: Column) -> Column:
    return F.array_sort(F.filter(F.split(c, " "), lambda x: x != ""))


def weighted(a: Column, b: Column) -> Column:
    """The likeness of two strings that are compared as they are (lower-case them first)."""
    def sets(x):
        """The common words, and the common words followed by what either has besides."""
        wa, wb = F.array_distinct(x["wa"]), F.array_distinct(x["wb"])
        both = F.array_join(F.array_intersect(wa, wb), " ")
        rest = lambda p, q: F.trim(F.concat_ws(" ", both, F.array_join(F.array_except(p, q), " ")))
        far = F.greatest(F.length(x["a"]), F.length(x["b"])) / F.greatest(F.least(F.length(x["a"]), F.length(x["b"])), F.lit(1))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_join(x["wa"], " ").alias("ja"), F.array_join(x["wb"], " ").alias("jb"),
                             both.alias("both"), rest(wa, wb).alias("xa"), rest(wb, wa).alias("xb"), far.alias("far")), score)

    def score(x):
        common = x["both"] != ""
        token_set = F.greatest(ratio(x["xa"], x["xb"]), F.when(common, F.greatest(ratio(x["both"], x["xa"]), ratio(x["both"], x["xb"]))).otherwise(0.0))
        near = F.greatest(ratio(x["a"], x["b"]), F.greatest(ratio(x["ja"], x["jb"]), token_set) * TOKEN_WEIGHT)
        scale = F.when(x["far"] < FAR, PARTIAL_WEIGHT).otherwise(FAR_WEIGHT)
        part_set = F.when(common, 100.0).otherwise(partial(x["xa"], x["xb"]))
        wide = F.greatest(ratio(x["a"], x["b"]), partial(x["a"], x["b"]) * scale, F.greatest(partial(x["ja"], x["jb"]), part_set) * scale * TOKEN_WEIGHT)
        return F.when((x["a"] == "") | (x["b"] == ""), 0.0).when(x["far"] < LONGER, near).otherwise(wide)

    return _let(F.struct(a.alias("a"), b.alias("b"), _words(a).alias("wa"), _words(b).alias("wb")), sets)


def grams(c: Column) -> Column:
    """Distinct two-letter pieces of a string's words, with their ends marked. Two strings with a ``weighted`` score of 80 share a
    piece, unless one of them is a single letter that the other holds."""
    pieces = F.flatten(F.transform(_words(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, 2))))
    return F.array_distinct(pieces)


# ---- DuckDB twins --------------------------------------------------------------------------------------

def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) > 0 THEN 100.0 * (1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) ELSE 0.0 END)"


def partial_sql(a: str, b: str) -> str:
    one = lambda s, t: f"(CASE WHEN length({s}) > 0 THEN 100.0 * (1.0 - list_min([levenshtein({s}, substr({t}, i, length({s}))) for i in range(1, length({t}) - length({s}) + 2)]) / length({s})) ELSE 0.0 END)"
    return f"(CASE WHEN length({a}) > length({b}) THEN {one(b, a)} ELSE {one(a, b)} END)"


def scored_sql(pairs: str, a: str = "a", b: str = "b") -> str:
    """All columns of ``pairs`` and ``score``, the ``weighted`` likeness of its columns a and b."""
    split = lambda c: f"[x for x in string_split({c}, ' ') if x <> '']"
    inner = f"SELECT *, list_sort({split(a)}) AS ta, list_sort({split(b)}) AS tb FROM ({pairs})"
    inner = f"SELECT *, list_sort(list_distinct(ta)) AS wa, list_sort(list_distinct(tb)) AS wb FROM ({inner})"
    inner = (f"SELECT *, array_to_string(ta, ' ') AS ja, array_to_string(tb, ' ') AS jb, array_to_string([x for x in wa if list_contains(wb, x)], ' ') AS w0, "
             f"array_to_string([x for x in wa if NOT list_contains(wb, x)], ' ') AS w1, array_to_string([x for x in wb if NOT list_contains(wa, x)], ' ') AS w2 FROM ({inner})")
    inner = f"SELECT * EXCLUDE (w1, w2), trim(concat_ws(' ', w0, w1)) AS xa, trim(concat_ws(' ', w0, w2)) AS xb, greatest(length({a}), length({b})) / greatest(least(length({a}), length({b})), 1) AS far FROM ({inner})"
    near = (f"greatest({ratio_sql(a, b)}, {TOKEN_WEIGHT} * greatest({ratio_sql('ja', 'jb')}, {ratio_sql('xa', 'xb')}, "
            f"CASE WHEN w0 <> '' THEN greatest({ratio_sql('w0', 'xa')}, {ratio_sql('w0', 'xb')}) ELSE 0.0 END))")
    scale = f"(CASE WHEN far < {FAR} THEN {PARTIAL_WEIGHT} ELSE {FAR_WEIGHT} END)"
    wide = (f"greatest({ratio_sql(a, b)}, {partial_sql(a, b)} * {scale}, greatest({partial_sql('ja', 'jb')}, "
            f"CASE WHEN w0 <> '' THEN 100.0 ELSE {partial_sql('xa', 'xb')} END) * {scale} * {TOKEN_WEIGHT})")
    return (f"SELECT * EXCLUDE (ta, tb, wa, wb, ja, jb, w0, xa, xb, far), CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 WHEN far < {LONGER} THEN {near} ELSE {wide} END AS score FROM ({inner})")
