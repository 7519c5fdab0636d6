"""Line-first quality rules, as native column expressions.

Each line is judged on its own: a line goes if it is navigation (three separators close together),
boilerplate (a fixed phrase), noise (more than one mark for every three words) or lacks a closing
punctuation mark. The lines that stay make the cleaned text. A document is rejected if the base
counts fail, or if more than ``max_loss`` of its characters other than spaces went with the lines.

Defined cases: a null text counts as empty; a text without words has ``base_failed`` true and
``kept`` false, and its cleaned text is empty. Lines without a word are dropped and count for nothing.
Repeated rows are judged alike, one output row for each input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import let
from umbra.llm.words import SPACE, window_hashes, words

WINDOW = 8              # words of a window that counts as repeated
MIN_WORDS = 20
MAX_REPEAT = 30         # percent of the words in repeated windows
MAX_LOSS = 0.5          # share of a document's characters that its failed lines may hold
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!?»›•"
NAVIGATION = "([|»›•>][^|»›•>]{0,40}){3}"
#: Marks that close a line, blanks after them aside.
CLOSED = ".!?…:;\"”»)。！？؟।"
#: Phrases of boilerplate lines, by language.
BOILERPLATE = ("all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
               "read more", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use",
               "alle rechte vorbehalten", "hier klicken", "cookie-richtlinie", "datenschutzerklärung", "mehr lesen", "weiterlesen",
               "todos los derechos reservados", "haga clic aquí", "política de cookies", "política de privacidad", "leer más",
               "tous droits réservés", "cliquez ici", "politique de cookies", "politique de confidentialité", "lire la suite")


def _chars(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def line_fails(line: Column, has_phrase: Column) -> Column:
    """True for a line that must go. ``has_phrase``: whether the document holds any fixed phrase."""
    marks = F.length(line) - F.length(F.translate(line, MARKS, ""))
    gaps = F.length(line) - _chars(line)
    return (~F.contains(F.lit(CLOSED), F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1))
            | (marks * 3 > gaps + 1)
            | ((marks > 2) & line.rlike(NAVIGATION))
            | (has_phrase & F.lower(line).rlike("|".join(BOILERPLATE))))


def repeated_words(hashes: Column, width: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more; ``hashes`` in text order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        twin = lambda j, k: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: twin(j, j - 1) | twin(j, j + 1))
        return F.sort_array(F.transform(again, lambda j: F.get(s, j)["i"]))

    def covered(p):
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0),
                           lambda acc, j: acc + F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(width))))

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, starts), covered)).otherwise(0)


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_lines_cut and clean_text of each row (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "_t", words(F.col("_t")).alias("_w"),
                       F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("_lines"),
                       _any_phrase(F.lower("_t")).alias("_phrase"))
    rows = rows.select(
        "doc_id", "_t", "_lines", F.size("_w").alias("_n"), window_hashes(F.col("_w"), WINDOW).alias("_h"),
        F.filter("_lines", lambda x: ~line_fails(x, F.col("_phrase"))).alias("_good"))
    rows = rows.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_h"), WINDOW).cast("long").alias("n_repeat_words"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_cut"),
        _chars(F.array_join("_lines", "")).alias("_all"),
        F.array_join("_good", "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    left = _chars(F.replace("clean_text", F.lit("\n"), F.lit("")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= F.col("_all") * (1 - max_loss))).alias("kept"), "n_lines_cut", "clean_text")


def _any_phrase(lowered: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_cut")


def oracle() -> str:
    """DuckDB SQL for the digest columns of ``clean`` over documents."""
    space, split = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '", r"[\x20\x09-\x0D]+"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    gone = lambda x, chars: f"length({x}) - length(regexp_replace({x}, '[{chars}]', '', 'g'))"
    marks = "#*$%&|<>!?»›•"
    nonspace = "regexp_replace({}, ' ', '', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, [x for x in string_split_regex(t, {quote(split)}) if x <> ''] AS w FROM d),
pos AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
win AS (SELECT k, i, {" || ' ' || ".join(["w"] + [f"lead(w, {j}) OVER q" for j in range(1, WINDOW)])} AS g FROM pos
        WINDOW q AS (PARTITION BY k ORDER BY i)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY k),
l AS (SELECT k, x, contains({quote(CLOSED)}, right(rtrim(x, {space}), 1)) AS closed, {gone('x', marks)} AS marks,
        length(x) - length({nonspace.format('x')}) AS gaps, regexp_matches(x, {quote(NAVIGATION)}) AS nav,
        regexp_matches(lower(x), {quote('|'.join(BOILERPLATE))}) AS boiler, length({nonspace.format('x')}) AS chars
      FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE length(translate(x, {space}, '')) > 0),
ll AS (SELECT k, count(*) AS n, count(DISTINCT x) AS u, sum(chars) AS chars, count(*) FILTER (WHERE NOT bad) AS good,
        coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS left_chars
      FROM (SELECT *, NOT closed OR marks * 3 > gaps + 1 OR (marks > 2 AND nav) OR boiler AS bad FROM l) GROUP BY k),
b AS (SELECT d.k, doc_id, len(w.w) AS n_words, length(translate(t, {space}, '')) AS word_chars, {gone('t', '#*$%&|<>')} AS n_symbols,
        coalesce(ll.n - ll.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ll.n - ll.good, 0) AS n_lines_cut,
        coalesce(ll.chars, 0) AS chars, coalesce(ll.left_chars, 0) AS left_chars
      FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN ll USING (k))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND left_chars >= chars * {1 - MAX_LOSS}) AS kept,
  CAST(n_lines_cut AS BIGINT) AS n_lines_cut
FROM b"""
