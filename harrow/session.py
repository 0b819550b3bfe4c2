"""Session construction and cluster-safe checkpoint location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Initial shuffle partitions on a cluster; adaptive execution merges small ones.
CLUSTER_SHUFFLE_PARTITIONS = 4000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "harrow") -> SparkSession:
    """A session configured the way every operator here expects.

    UTC session time zone (reference timestamps are naive UTC), AQE with skew
    join handling, and Arrow for the few vectorized UDFs.  On one machine
    (``local[...]``) shuffles get a partition per core, on a cluster many that
    AQE coalesces.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if not shuffle_partitions:
        local = (master or "").startswith("local[")
        shuffle_partitions = (os.cpu_count() or 8) if local else CLUSTER_SHUFFLE_PARTITIONS
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HARROW_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or the one set on the context.

    Executors may run anywhere, so no folder of this machine is made up: without
    a setting this raises.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    current = current or sc.getCheckpointDir()
    if not current:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return current


def _work_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/harrow-{spark.sparkContext.applicationId}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back, which cuts its lineage.

    A lost executor re-reads the files instead of recomputing the lineage, Spark
    knows the size of what it joins next, and small parts are read together.
    """
    spark = df.sparkSession
    path = f"{_work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_checkpoints(spark: SparkSession) -> None:
    """Remove everything that ``reliable_checkpoint`` wrote in this application; call it when all results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
