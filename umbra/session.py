"""Session helpers: a tuned local session for tests/bench and checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "umbra") -> SparkSession:
    """Build (or reuse) a session with AQE on. On a cluster the caller passes its own session."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("UMBRA_MASTER", "local[8]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` is used as is. Only when it is unset in a local session
    (tests, bench) do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: stage tables must survive executor loss")
        configured = tempfile.mkdtemp(prefix="umbra-ckpt-")   # local sessions only: one process, one machine
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


class Stages:
    """The stage tables of one run, in a folder of its own below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/umbra-run-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Materialize ``df`` as a parquet table and read it back, as ``cut_lineage`` does."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.mode("error").parquet(path)
        return self.spark.read.parquet(path)

    def release(self) -> None:
        """Delete the run's tables; nothing that reads them can run after that."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Survives executor loss (the files live in the cluster's reliable checkpoint folder, never a
    machine-local one), truncates the lineage, and gives AQE real size statistics for the next
    join. Never a local checkpoint.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/umbra-stage-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
