"""Corpus pipeline: language ID, near-duplicates, personal data, mixing and tokenizing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Each works on all rows that its predecessor kept. ``run`` writes every stage as Parquet in
the shared folder and reads it again.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as empty (the language stage
rejects it, as it does a text without a letter); rows that share an id, or have none, are rows of their own; columns of other
names pass through, whatever they are called. Ties are broken by a hash of the row, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bpe, byte_cnn, near_dedup, pfair, pii
from umbra.llm.base import cut_lineage, packed

#: A text goes if it has no letter, or if no language reaches this score (even odds of four would be 0.25).
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language cannot be told. Repeated rows are kept or rejected together; without any row to learn from,
    a text with a letter stays."""
    model = byte_cnn.train(docs.select("doc_id", "text", "lang"))
    return byte_cnn.filtered(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, once. Documents that
    share an id, or have none, count as copies only if their texts do. Where id and text repeat with other columns, the row
    with the least hash stays. Texts without a word are one group."""
    keep = near_dedup.first_rows(docs.select("doc_id", "text"))
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _key=near_dedup.text_key(F.col("text")))
    kept = rows.join(keep, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi")
    one = kept.groupBy("_id", "_key").agg(F.min_by("_row", F.struct(F.xxhash64("_row"), F.hash("_row"))).alias("_row"))
    return one.select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text. Null texts stay null; equal texts stay equal."""
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the interleaved order of their sources' target weights (tempered sizes). A null source is a source;
    equal rows share their places in any order. The table written from it holds the order: its files by number, and their rows."""
    return pfair.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that came through, with its place in the mix: mix_position, the
    rows before it in the order that the mixing stage stored, and in_mix (the weights hold up to there). The place
    is read from the table, not made again."""
    place = ("mix_position", "in_mix")
    return bpe.tokenize(pfair.placed(docs).select("_row.doc_id", "_row.text", *place), keep=place)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Learned models and hashed signatures have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
