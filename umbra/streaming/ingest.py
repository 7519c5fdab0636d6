"""Incremental ingest. Each arriving raw census file is cleaned and protected under its own name.

``readStream`` on the landing folder -> ``foreachBatch`` running the pipeline for every file of the batch
with ``version_id = batch-<id>``. Cleaning is stateless; Mondrian needs a whole file, hence
``foreachBatch``. ``trigger(availableNow=True)`` processes what has landed and stops; the checkpoint
location makes the ingest restartable, and a batch that is run again writes the same files, event and
noise over again.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey
from umbra.plans.workflows import run_pipeline
from umbra.session import Stages
from umbra.sources.census import CENSUS_SCHEMA, DATA_FILE_GLOB, read_census_csv


def _no_glob(path: str) -> str:
    """``path`` with the characters that would make it a pattern escaped."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def ingest(spark: SparkSession, landing: str, out_root: str, checkpoint: str, noise: NoiseKey, k: int = 10, l: int = 2,
           epsilon: float = 0.3, budget: float | None = None, max_files_per_trigger: int = 16, available_now: bool = True,
           select_files: bool = True):
    reader = (spark.readStream.schema(CENSUS_SCHEMA).option("header", "false").option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if select_files:
        reader = reader.option("pathGlobFilter", DATA_FILE_GLOB)
    stream = reader.csv(landing).withColumn("source_file", F.col("_metadata.file_path"))

    def process(batch: DataFrame, batch_id: int) -> None:
        # the batch names its files, as many as a trigger takes at most; each is read once, by its path
        for (path,) in sorted(batch.select("source_file").distinct().collect()):
            stages = Stages(spark)
            own = stages.write(read_census_csv(spark, _no_glob(unquote(path))))
            run_pipeline(spark, own, out_root, f"batch-{batch_id:06d}", noise, source_name=PurePosixPath(unquote(path)).name, k=k, l=l,
                         epsilon=epsilon, budget=budget, replay=True)
            stages.release()

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
