"""Where intermediate tables live, and how lineage is cut between the steps of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only in local mode, where it is unset, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that a lost executor costs no more than the current step."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    named = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if named.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(named.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
