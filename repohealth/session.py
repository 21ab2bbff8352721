"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "repohealth", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    ``master`` is only given for local runs; on a cluster spark-submit decides.
    Other settings (executor sizes, shuffle partitions, spark.checkpoint.dir)
    belong to the cluster and are taken from it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # timers and map state of the streams need it
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the cluster's, or a local one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Used once per round of an iterative job. The files survive the loss of
    executors, so a lost task re-reads its input instead of replaying the loop.
    They are plain Parquet: a DataFrame checkpoint also keeps the estimated size,
    order and constraints of its plan, and these multiply from round to round
    until planning never ends, while a table has true sizes and no history.
    The file system drops the files when the application ends; a loop that has
    superseded a table gives it to ``release`` at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lineage-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut_lineage`` that nothing will read again."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context; they need not have it installed.

    Call it before functions of the package are handed to Spark.
    """
    context = spark.sparkContext
    if getattr(context, "_repohealth_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "repohealth.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    context.addPyFile(path)
    context._repohealth_shipped = True
