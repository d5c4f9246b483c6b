"""Session defaults. A job on a cluster keeps whatever its own configuration sets."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "tillwork", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the engine's defaults; extra settings as keyword arguments with ``__`` for dots.

    The master is local only where neither a running session nor the launcher (spark-submit, MASTER) has chosen one.
    """
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None and not os.environ.get("MASTER") and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(f"local[{cores}]")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables: the session's own setting.

    Only a session whose executors are threads of the driver may do without; it gets a folder that is removed when the driver ends.
    """
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if chosen:
        return chosen
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(spark.conf.get("spark.local.dir", "/tmp"), f"tillwork-{spark.sparkContext.applicationId}-{os.getpid()}")
    if not os.path.isdir(folder):
        os.makedirs(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that is large and read several times to the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the planner real sizes, so that it broadcasts only what is small.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
