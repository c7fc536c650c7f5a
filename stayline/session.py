"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "stayline") -> SparkSession:
    """A single-machine session for tests and timings; a cluster brings its own."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Recording the Python line of every column expression costs more than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stayline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is ever overwritten there."""
    return f"{shared_folder(spark)}/stayline/{uuid.uuid4().hex}/{name}"


def freeze(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage and go on from the written rows.

    Needed wherever a later step must see exactly the same row placement even
    after an executor is lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Unlike a checkpoint the result keeps column pruning, pushed filters and
    size statistics, so it is the form to use before several passes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
