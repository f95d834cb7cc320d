"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs. On a cluster, use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set up where it is not yet.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local master
    without that setting gets a temporary folder, which is removed at exit; a cluster
    without it is an error, because a folder of one machine would be lost with that machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder (``shared_folder``), its lineage cut.

    The files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as in ``local_session``; else they stay for the application's user to remove.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
