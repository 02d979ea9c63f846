"""Session settings and the shared scratch folder used for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join partitions even when that costs the shuffle of the aggregate above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Shuffles start with many partitions and are coalesced to so many bytes, so that a task's memory does not grow with the tables.
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# So many bytes of a file are one split: what a task groups before an exchange grows with its split.
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def tune(spark: SparkSession, initial_partitions: int | None = None) -> SparkSession:
    """Apply the runtime settings the operators rely on; all are per-session SQL settings."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if initial_partitions is None:
        spark.conf.unset(INITIAL_PARTITIONS)
        spark.conf.unset(PARTITION_BYTES)
        spark.conf.unset(SPLIT_BYTES)
    else:
        spark.conf.set(INITIAL_PARTITIONS, str(initial_partitions))
        spark.conf.set(PARTITION_BYTES, "16m")
        spark.conf.set(SPLIT_BYTES, "16m")
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and everything runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        return named
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written and read back by a job."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, for tasks that open files themselves: a bare one belongs to Spark's default file system, wherever the task runs."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to four tasks a core: a small file is one split, and all work on its rows would be one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism * 4, 32), *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in tasks of ``PARTITION_BYTES``, before they are grouped into very many groups: a task groups what it reads before it sends it on,
    and a file that cannot be split is read by one task. ``keys`` tell rows apart, not groups: a hot group stays in many tasks."""
    return df.hint("rebalance", *keys)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below the shared folder and read back, for what is read several times."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
