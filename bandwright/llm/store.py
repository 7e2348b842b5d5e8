"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
in local mode (tests, a laptop) is a folder of our own taken, and the session's
settings stay as they are. On a cluster an unset folder is an error. A written Parquet table keeps
its statistics for the planner and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="bandwright-"))
        folder = _own[0]
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for the text operators.

    Smaller Arrow batches than Spark's default of 10,000 rows, which are whole
    texts here (a setting of the user's stays), and this package's folder on
    the Python workers' path where they share it with the driver.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, PACKAGE_ROOT)))
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(16 << 20))):
        try:
            now = spark.conf.get(key)
        except Exception:  # this version has no such setting
            continue
        if now == default or default is None and int(now.rstrip("bB") or 0) > 1 << 30:
            spark.conf.set(key, ours)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done, which it does when the driver's JVM collects its garbage.

    A plan that has just ended is let go of by the first collection and its files by the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; its rows are computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bandwright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
