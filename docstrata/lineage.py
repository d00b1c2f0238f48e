"""Cutting the lineage of a DataFrame, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A folder set by ``setCheckpointDir`` or ``spark.checkpoint.dir`` is taken. Where none is
    set, a temporary one is made if the whole of Spark runs in this process, as in tests; on a
    cluster that is an error, as executors could not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if top is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(top)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    shared_top(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder of one's own, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
