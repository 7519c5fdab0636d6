"""Document fingerprints: bottom-k sketches of shingle hashes, as native column expressions.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's shingles (runs of five
words; a shorter text with any word has one shingle, all its words). Sketches of parts merge into the
sketch of the whole, and estimate resemblance, containment and the number of distinct shingles; with
fewer than ``k`` shingles these are exact.

Defined cases: a null text counts as empty; an empty text has an empty sketch. Two empty sketches have
resemblance 1, an empty and another one 0. Ids may repeat: equal ids are ordered by a hash of the text, and
null ids come after all others. In a table of one row, that row is its own next document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.base import cut_lineage
from umbra.llm.words import window_hashes, words

SHINGLE = 5
K = 64
#: Rows of a bucket of neighbouring ids, and the most cuts of the ids: above that, buckets hold more rows.
BUCKET_ROWS = 64
MAX_BUCKETS = 4_096
_POSITIVE = (1 << 63) - 1


def sketch_of_words(words_col: Column, k: int = K, width: int = SHINGLE) -> Column:
    """Sketch of a column of words (a plain column)."""
    n = F.size(words_col)
    hashes = F.when(n >= width, window_hashes(words_col, width)).when(n > 0, F.array(F.xxhash64(words_col))).otherwise(
        F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(_POSITIVE))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity of two sets from their sketches."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    union = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / F.greatest(union, F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below ``k``."""
    last = F.element_at(a, -1).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1) * F.lit(2.0 ** 63) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of the first set that is in the second; 1 for an empty first set."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / F.greatest(na, F.lit(1.0))))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_groups(rows: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One merged sketch for each key, in two steps: parts of a hot key are merged in parallel first.

    Each step keeps the k smallest hashes of its group with a ranked window, never a whole group."""
    spread = F.pmod(F.xxhash64(sketch), F.lit(64))
    h = rows.select(F.col(key), spread.alias("_part"), F.explode(sketch).alias("_h")).distinct()
    first = Window.partitionBy(key, "_part").orderBy("_h")
    last = Window.partitionBy(key).orderBy("_h")
    h = h.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(key, "_h").distinct()
    h = h.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k)
    return h.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def _buckets(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (with ``_h``, a hash of the text) with ``_b``, ``_c``, ``_z``: places of buckets in descending order of (id, hash).

    ``_b``: ids are cut at quantiles, and each quantile has a bucket of its own, so one far id moves no
    bound, and an id that many rows share stands alone. ``_c``: such a bucket, or that of the null ids, is cut by hash.
    ``_z``: equal rows of which there are many are parted by number, as their order among themselves is free."""
    n = rows.count()
    count = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted(set(rows.approxQuantile(id_col, [i / count for i in range(1, count)], 0.1 / count))) if count > 1 else []
    value = F.col(id_col).cast("double")
    if cuts:
        table = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")        # folded to one constant
        steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
        below = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) < value, step).otherwise(0))
        place = below * 2 + F.when(F.get(table, below) == value, 1).otherwise(0)
        b = F.when(F.col(id_col).isNull(), -1).otherwise(place)
    else:
        b = F.when(F.col(id_col).isNull(), -1).otherwise(0)
    # never null by its form: a filter for nulls would part the exchange that the uses of the rows share
    rows = rows.withColumn("_b", F.coalesce(b, F.lit(-1)))
    full = max(BUCKET_ROWS, 4 * n // count)
    # at most a few buckets are so full: a quantile's own, or that of the null ids
    heavy = {r["_b"]: -(-r["n"] // full) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).where(F.col("n") > full).collect() if r["_b"] % 2}
    if not heavy:
        return rows.withColumns({"_c": F.lit(0).cast("long"), "_z": F.lit(0).cast("long")})
    parts = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    share = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 34)             # the hash as 0 .. 2^30 - 1, in its order
    rows = rows.withColumn("_c", F.coalesce(F.shiftright(share * F.element_at(parts, F.col("_b")), 30), F.lit(0)).cast("long"))
    equal = rows.where(F.col("_b").isin(list(heavy))).groupBy("_b", "_h").agg(F.count("*").alias("n")).where(F.col("n") > full).collect()    # MAX_BUCKETS at most
    if not equal:
        return rows.withColumn("_z", F.lit(0).cast("long"))
    # such a hash is a bucket of its own between those before and after it
    known = F.from_json(F.lit(json.dumps([{"b": r["_b"], "h": r["_h"], "p": -(-r["n"] // full)} for r in equal])), "array<struct<b:int,h:bigint,p:bigint>>")
    below = F.size(F.filter(known, lambda x: (x["b"] == F.col("_b")) & (x["h"] < F.col("_h"))))
    own = F.get(F.filter(known, lambda x: (x["b"] == F.col("_b")) & (x["h"] == F.col("_h"))), 0)["p"]
    rows = rows.withColumns({"_own": own, "_nr": F.monotonically_increasing_id()})
    rows = rows.withColumns({"_c": F.col("_c") * (2 * len(equal) + 2) + 2 * below + F.when(F.col("_own").isNotNull(), 1).otherwise(0),
                             "_z": F.coalesce(F.col("_nr") % F.col("_own"), F.lit(0)).cast("long")})
    return cut_lineage(rows.drop("_own", "_nr"))       # written, so that the numbers stay


def with_next(rows: DataFrame, id_col: str, tie: list[str], carry: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the row that follows in descending order of
    the id (ties by ``_h``, a hash that ``rows`` has, then ``tie``; null ids last); the first row follows the last.

    Rows are cut into buckets of neighbours (``_buckets``), each ordered on its own; the last row of a bucket
    gets the first row of the next bucket, by a join of one row a bucket.
    """
    rows_in, rows = rows.columns, _buckets(rows, id_col)
    place = ["_b", "_c", "_z"]
    inside = Window.partitionBy(*place).orderBy(F.col(id_col).desc_nulls_last(), "_h", *[F.col(c) for c in tie])
    w = rows.select(
        "*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carry],
        F.lag(F.lit(1)).over(inside).isNull().alias("_first"), F.lead(F.lit(1)).over(inside).isNull().alias("_last"))
    down = Window.orderBy(F.col("_b").desc(), "_c", "_z")          # one row a bucket: a few times MAX_BUCKETS at most
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(*place)
    follow = rows.select(*place).distinct().select(*place, F.coalesce(F.lead(here).over(down), F.first(here).over(whole)).alias("_n"))
    firsts = w.where("_first").select(here.alias("_n"), *[F.col(c).alias(f"next_{c}") for c in carry])
    out = [*rows_in, *[f"next_{c}" for c in carry]]
    ends = w.where("_last").drop(*[f"next_{c}" for c in carry]).join(F.broadcast(follow), place).join(firsts, "_n")
    return w.where(~F.col("_last")).select(*out).unionByName(ends.select(*out))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, sketch, distinct_shingles and fingerprint of each row (doc_id, text)."""
    rows = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("_w"))
    rows = rows.select("doc_id", sketch_of_words(F.col("_w"), k).alias("sketch"))
    return rows.select("doc_id", "sketch", distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
                       fingerprint(F.col("sketch")).alias("fingerprint"))


def edited_and_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document,
    with the likeness of the text to both."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "_t", words(F.col("_t")).alias("_w"))
    rows = rows.select("doc_id", "_t", sketch_of_words(F.col("_w"), k).alias("_s"), F.xxhash64("_t").alias("_h"))
    rows = with_next(rows, "doc_id", ["_t"], ["_t", "_s"])
    n = F.length("_t")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.col("_s"), F.col("next__s").alias("_ns"),
                       F.concat(F.left(F.col("_t"), n - half), F.left(F.col("next__t"), half)).alias("_e"))
    rows = rows.select("*", words(F.col("_e")).alias("_ew"))
    rows = rows.select("doc_id", "n_chars", "_s", "_ns", F.sha2("_e", 256).alias("edited_sha256"), sketch_of_words(F.col("_ew"), k).alias("_es"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_s")).alias("fingerprint"), fingerprint(F.col("_es")).alias("edited_fingerprint"),
        resemblance(F.col("_s"), F.col("_es"), k).alias("near_edited"), resemblance(F.col("_s"), F.col("_ns"), k).alias("near_next"),
        distinct_count(F.col("_s"), k).alias("distinct_shingles"), containment(F.col("_s"), F.col("_es"), k).alias("contained_in_edited"))
