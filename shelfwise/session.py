"""Session helpers."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "shelfwise") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a local one only where none is set and the master is local."""
    if spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-ckpt-"))


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """Run the collectors of the driver, so that Spark's cleaner drops the shuffle files of plans nobody holds."""
    gc.collect()
    spark._jvm.System.gc()
