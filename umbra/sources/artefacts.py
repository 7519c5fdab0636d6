"""Versioned parquet artefacts, naming, manifest and completion event."""

from __future__ import annotations

import datetime as _dt
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version_id(now: _dt.datetime | None = None) -> str:
    """Run timestamp ``YYYY-MM-DD_HH-MM-SS`` (no ``:`` so it is safe in object keys)."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y-%m-%d_%H-%M-%S")


def artefact_name(source_file: str, kind: str, k: int | None = None, l: int | None = None,
                  epsilon: float | None = None) -> str:
    """``<stem>``, ``<stem>_clean``, ``<stem>_anon_k{k}``, ``<stem>_anon_l{l}``, ``<stem>_dp_e{eps:.2f, '.'->'_'}``."""
    stem = PurePosixPath(source_file).stem.replace(".", "_")
    if kind == "stem":
        return stem
    if kind == "clean":
        return f"{stem}_clean"
    if kind == "anon_k":
        return f"{stem}_anon_k{k}"
    if kind == "anon_l":
        return f"{stem}_anon_l{l}"
    if kind == "dp":
        return f"{stem}_dp_e{f'{epsilon:.2f}'.replace('.', '_')}"
    raise ValueError(f"unknown artefact kind {kind!r}")


def read_artefact(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Read an artefact (one version via partition pruning)."""
    df = spark.read.parquet(path)
    return df.where(F.col("version_id") == version) if version is not None else df


def write_artefact(df: DataFrame, path: str, version: str) -> str:
    """``partitionBy(version_id)`` with dynamic partition overwrite; no ``coalesce(1)``."""
    (df.withColumn("version_id", F.lit(version)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path))
    return f"{path}/version_id={version}"


def manifest(spark: SparkSession, version: str, entries: list[tuple[str, str]]) -> DataFrame:
    """Artefact manifest ``(version_id, artefact, path, rows)``; the rows are counted in the artefacts."""
    out = None
    for artefact, path in entries:          # a handful of artefacts, one count each
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(version).alias("version_id"), F.lit(artefact).alias("artefact"), F.lit(path).alias("path"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def completion_event(man: DataFrame, event_type: str = "DATA_CLEANING_COMPLETED", status: str = "success") -> DataFrame:
    """One JSON event per version with the list of artefact paths and their rows (nothing if no artefact)."""
    g = man.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("path", "artefact", "rows"))).alias("artefacts"))
    return g.select(F.to_json(F.struct(
        F.lit(event_type).alias("event_type"), F.lit(status).alias("status"), "version_id",
        F.transform("artefacts", lambda a: a["path"]).alias("clean_file_paths"), "artefacts")).alias("value"))


def write_event(event: DataFrame, out_root: str, stem: str, version: str) -> str:
    """Writes an event to the place of its source and version: a replay writes it over."""
    path = f"{out_root}/_events/source={stem}/version_id={version}"
    event.write.mode("overwrite").text(path)
    return path


def read_events(spark: SparkSession, out_root: str) -> DataFrame:
    """source, version_id and value (JSON) of every event."""
    return spark.read.text(f"{out_root}/_events").select("source", "version_id", "value")
