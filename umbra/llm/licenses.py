"""License scan by diagonal voting, as native Spark joins and aggregates.

Every run of ``K`` words of every text is hashed and joined to the positions of the same run in the
license templates. A hit votes for the diagonal text position - template position; votes are summed by
diagonal, neighbouring diagonals (a word more or less) are merged, and a merged span is verified: its
hits must cover enough of the template, in a stretch of text not much longer than the template.

Base labels are places where the words of a fixed phrase stand consecutively.

Defined cases: a null text counts as empty; a text without a place has null first_word and last_word,
and labels that are empty strings where nothing was found. Rows that repeat an id keep their own
results: rows are told apart by id and text, and equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.llm.words import window_hashes

K = 3                   # words of a hashed run
DRIFT = 3               # most words between merged diagonals
COVERAGE = 0.6          # least share of a template's runs that a span must hit
STRETCH = 1.5           # most words of a span against its template's

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that give a base label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license notices, by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "Copyright. All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    import re
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_runs(templates=TEMPLATES) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, number of runs, position, words of the run)."""
    out = []
    for t, (label, text) in enumerate(templates):
        w = template_words(text)
        out += [(t, label, len(w) - K + 1, i, w[i:i + K]) for i in range(len(w) - K + 1)]
    return out


def word_rows(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the words of every row, and whether a base phrase can be there."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_x"), low.alias("_l")).select(
        "doc_id", "_x", F.contains("_l", F.lit("license")).alias("_may"), F.array_remove(F.split("_l", GAP), "").alias("_w"))


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, text hash, label, template, first and last word and coverage of each verified span."""
    spark: SparkSession = docs.sparkSession
    t = spark.createDataFrame(template_runs(templates), "tmpl int, label string, runs int, tpos int, words array<string>")
    t = t.select("tmpl", "label", "runs", "tpos", F.xxhash64("words").alias("_h"))    # a few hundred rows, whatever the input
    rows = word_rows(docs).select("doc_id", "_x", window_hashes(F.col("_w"), K).alias("_hs"))
    # the outer form: Spark would push a test for empty arrays, and the hashing with it, below the word split
    hits = rows.select("doc_id", "_x", F.posexplode_outer("_hs").alias("pos", "_h")).join(F.broadcast(t), "_h")
    votes = hits.groupBy("doc_id", "_x", "tmpl", "label", "runs", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("hit"))
    # a set holds at most the positions of one template
    line = Window.partitionBy("doc_id", "_x", "tmpl").orderBy("diag")
    fresh = (F.col("diag") - F.lag("diag").over(line) > DRIFT) | F.lag("diag").over(line).isNull()
    votes = votes.withColumn("_new", fresh.cast("int")).withColumn("_grp", F.sum("_new").over(line))
    merged = votes.groupBy("doc_id", "_x", "tmpl", "label", "runs", "_grp").agg(
        F.min("lo").alias("lo"), (F.max("hi") + (K - 1)).alias("hi"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("covered"))
    share = F.col("covered") / F.col("runs")
    fits = F.col("hi") - F.col("lo") + 1 <= (F.col("runs") + (K - 1)) * STRETCH
    return merged.where((share >= COVERAGE) & fits).select(
        "doc_id", "_x", "label", "tmpl", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("last_word"),
        share.alias("coverage"))


def _at(words, i, phrase: str):
    ok = F.lit(True)
    for j, w in enumerate(phrase.split()):
        ok = ok & F.coalesce(F.get(words, i + j) == w, F.lit(False))
    return ok


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Labels of every row (doc_id, text): base places, verified template spans, and a score."""
    docs = docs.select("doc_id", "text")
    found = spans(docs, templates).groupBy("doc_id", "_x").agg(
        F.collect_set("label").alias("_m"), F.max("coverage").alias("_c"))     # one element a label at most
    n = F.size("_w")

    def kind(i):
        got = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            got = F.when(_at(F.col("_w"), i, phrase), label).otherwise(got)
        return got

    places = F.when(F.col("_may") & (n > 1), F.filter(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), kind(i).alias("k"))),
        lambda x: x["k"].isNotNull())).otherwise(F.array().cast("array<struct<i:int,k:string>>"))
    base = word_rows(docs).select("doc_id", "_x", n.cast("long").alias("n_words"), places.alias("_p"))
    base = base.select(
        "doc_id", "_x", "n_words", F.size("_p").cast("long").alias("n_base"),
        F.get("_p", F.lit(0))["i"].cast("long").alias("first_word"), F.get("_p", F.size("_p") - 1)["i"].cast("long").alias("last_word"),
        F.array_distinct(F.transform("_p", lambda x: x["k"])).alias("_b"))
    out = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b._x") == F.col("f._x")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_b"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_b", F.coalesce("_m", none)))), ",").alias("labels"),
        F.greatest(F.coalesce("_c", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))


def oracle(templates=TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over documents: runs are compared as words, not as hashes."""
    runs = ", ".join(f"({t}, '{label}', {n}, {i}, '{' '.join(w)}')" for t, label, n, i, w in template_runs(templates))
    kinds = " ".join("WHEN " + " AND ".join(f"w{j} = '{x}'" for j, x in enumerate(p.split())) + f" THEN '{label}'" for p, label in PHRASES)
    next_words = ", ".join(["w AS w0"] + [f"lead(w, {j}) OVER q AS w{j}" for j in range(1, K)])
    return f"""
WITH r(tmpl, label, runs, tpos, g) AS (VALUES {runs}),
d AS (SELECT row_number() OVER () AS k, doc_id,
        [x for x in string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}') if x <> ''] AS w FROM documents),
raw AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
pos AS (SELECT k, i, {next_words} FROM raw WINDOW q AS (PARTITION BY k ORDER BY i)),
hits AS (SELECT k, tmpl, label, runs, tpos, i FROM pos JOIN r ON w0 || ' ' || w1 || ' ' || w2 = g),
votes AS (SELECT k, tmpl, label, runs, i - tpos AS diag, min(i) AS lo, max(i) AS hi, list(DISTINCT tpos) AS hit FROM hits GROUP BY ALL),
stepped AS (SELECT *, CASE WHEN diag - lag(diag) OVER q <= {DRIFT} THEN 0 ELSE 1 END AS new FROM votes WINDOW q AS (PARTITION BY k, tmpl ORDER BY diag)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY k, tmpl ORDER BY diag) AS grp FROM stepped),
merged AS (SELECT k, tmpl, label, runs, grp, min(lo) AS lo, max(hi) + {K - 1} AS hi, len(list_distinct(flatten(list(hit)))) AS covered
           FROM grouped GROUP BY ALL),
ok AS (SELECT k, label, covered / runs AS coverage FROM merged
       WHERE covered / runs >= {COVERAGE} AND hi - lo + 1 <= (runs + {K - 1}) * {STRETCH}),
m AS (SELECT k, list(DISTINCT label) AS labels, max(coverage) AS c FROM ok GROUP BY k),
p AS (SELECT k, i, CASE {kinds} END AS kind FROM pos),
b AS (SELECT k, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT kind) AS labels FROM p WHERE kind IS NOT NULL GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word,
  CAST(b.hi AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  greatest(coalesce(m.c, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (k) LEFT JOIN m USING (k)"""
