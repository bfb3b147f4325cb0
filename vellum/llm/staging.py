"""Where intermediate results live, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` names it on a cluster. Only in local mode, and where that is unset (as in tests), is a temporary
    folder chosen, which then also becomes the checkpoint folder of the context; elsewhere its lack is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Has Spark delete the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so later steps neither recompute it nor depend on its lineage.

    The shuffles that led to it are of no use any more and go with the query that wrote it. ``level`` is that of zstd.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged = (path,)
    return staged


def reads(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """``result``, marked as a reader of staged tables, which release() then deletes with it."""
    result._staged = tuple(p for t in tables for p in getattr(t, "_staged", ()))
    return result


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and those that a result of reads() was made of."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for name in getattr(table, "_staged", ()):
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; meant for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
