"""Registered queries of the training-data operators: name -> callable(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from umbra.llm import bpe, byte_cnn, decontaminate, heap_kmeans, licenses, line_rules, near_dedup, pfair, pii, quotes, repair, sketches, toxicity
from umbra.llm.base import table


def op1_pii(spark, sf_dir):
    """Personal data in every whole text: base patterns and the semi-Markov field."""
    return pii.find(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark, sf_dir):
    """Every whole text encoded with the 50k byte-level ranks, and decoded again."""
    return bpe.tokenize(table(spark, sf_dir, "documents"))


def op3_line_rules(spark, sf_dir):
    """Base counts and the line-first verdict of every whole text."""
    return line_rules.clean(table(spark, sf_dir, "documents")).select(*line_rules.COLUMNS)


def op4_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op5_quotes(spark, sf_dir):
    """Thread, place, parent and quote-free text of every message, where the messages are given quotes by a fixed rule."""
    return quotes.digest(quotes.link(quotes.quoting(table(spark, sf_dir, "conversations"))))


def op6_toxicity(spark, sf_dir):
    """Toxicity of every whole text, learned from the labelled three quarters."""
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark, sf_dir):
    """License labels of every whole text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    """Language of every whole text, learned from the labelled three quarters."""
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    """Place of every document in the Pfair schedule of its source."""
    got = pfair.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return got.select("_row.*", *[c for c in got.columns if c != "_row"])


def op10_fingerprints(spark, sf_dir):
    """Fingerprints of every whole text, its edited text, and their likeness."""
    return sketches.edited_and_next(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_decontamination(spark, sf_dir):
    """Words of every whole text that stand in windows of the benchmark, and the items they come from."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_heap_kmeans(spark, sf_dir):
    """Cluster, squared distance and inertia of every whole vector after five exact rounds."""
    return heap_kmeans.digest(table(spark, sf_dir, "embeddings"))


Q = {
    "op1_pii": op1_pii,
    "op4_near_dedup": op4_near_dedup,
    "op5_quotes": op5_quotes,
    "op6_toxicity": op6_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_rules": op3_line_rules,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontamination": op12_decontamination,
    "op13_heap_kmeans": op13_heap_kmeans,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op3_line_rules": line_rules.oracle(),
    "op5_quotes": quotes.oracle(quotes.quoting_sql()),
    "op7_license_scan": licenses.oracle(),
    "op11_conversation_repair": repair.oracle(),
    "op12_decontamination": decontaminate.oracle(),
    "op13_heap_kmeans": heap_kmeans.oracle(),
}
