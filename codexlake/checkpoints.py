"""Cutting a plan's lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in one process (``local[n]``, as in tests) may leave it unset; it
    gets a temporary folder that is removed when the driver ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codexlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, computed now and written to the shared folder."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has the driver notice now which shuffles and checkpoints nothing refers to any more, whose files Spark then deletes."""
    gc.collect()
    time.sleep(1)  # Python gives up its references to the JVM's objects in a thread of its own
    spark.sparkContext._jvm.System.gc()
