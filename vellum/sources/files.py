"""A sink of one file for each row, with a commit: all files and then their manifest, or nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vellum.operators import integrity
from vellum.sources.documents import opened

MANIFEST = "manifest"
#: Files that one task writes.
FILES = 2_000


def _store(place: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place if re.match("[a-z0-9+.-]+:/", place) else f"file://{place}")


class OneFileEach(DataSource):
    """Writes rows ``(id, raw)`` to ``<path>/<id><suffix>``, the text's bytes as they are and then ``end``.

    A task writes each file under a name of its own attempt and moves it into place, so an attempt that is repeated or runs
    twice replaces a file whole. The target had to be empty, so a job that fails takes all of it away again.
    """

    @classmethod
    def name(cls) -> str:
        return "one_file_each"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["id", "raw"]:
            raise ValueError("the columns must be id and raw")
        return _FilesWriter(self.options["path"], self.options.get("suffix", ""), self.options.get("end", ""))


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, end: str):
        self.path, self.suffix, self.end = path, suffix, end.encode()

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, base = _store(self.path)
        attempt = TaskContext.get().taskAttemptId()
        for row in iterator:
            name = f"{base}/{row['id']}{self.suffix}"
            with store.open_output_stream(f"{name}.{attempt}") as out:
                out.write(row["raw"].encode("utf-8", "surrogatepass") + self.end)
            store.move(f"{name}.{attempt}", name)
        return WriterCommitMessage()

    def abort(self, messages) -> None:
        store, base = _store(self.path)
        store.delete_dir(base)


def write_files(rows: DataFrame, path: str, suffix: str = ".json", end: str = "\n") -> None:
    """``(id, raw)`` to one file each, and their manifest (sizes and digests, without the line end) under ``manifest``.

    Ids that aren't safe as names or occur twice are an error, null texts are one, and so is a target that isn't empty; then
    nothing is written. The manifest comes last, by an ordinary Spark write: where it is complete, so are the files.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("raw").cast("string").alias("raw"))
    wrong = integrity.split_problems(rows.select("id")).union(rows.where("raw is null").select("id", F.lit("no text"))).first()
    if wrong:
        raise ValueError(f"{wrong['id']!r}: {wrong['problem']}")
    from pyarrow import fs

    store, base = _store(path)
    if store.get_file_info(base).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(base)):
        raise FileExistsError(f"{path} is not empty")
    store.create_dir(base, recursive=True)
    spark.dataSource.register(OneFileEach)
    # opening and moving a file costs more than its bytes, so tasks are cut by rows and not by the splits of the input
    tasks = max(1, -(-rows.count() // FILES))
    rows.repartition(tasks).write.format(OneFileEach.name()).mode("append").options(path=path, suffix=suffix, end=end).save()
    integrity.manifest(rows).write.json(f"{path}/{MANIFEST}")


def read_files(spark: SparkSession, path: str, suffix: str = ".json", end: str = "\n") -> DataFrame:
    """``(id, raw)`` of files that write_files wrote."""
    reader, path = opened(spark, f"{path}/*{suffix}")
    found = reader.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    raw = F.decode("content", "utf-8")
    return found.select(name.substr(F.lit(1), F.length(name) - len(suffix)).alias("id"), F.when(F.endswith(raw, F.lit(end)), F.left(raw, F.length(raw) - len(end))).otherwise(raw).alias("raw"))


def verify_files(spark: SparkSession, path: str, suffix: str = ".json", end: str = "\n") -> DataFrame:
    """``(id, raw_bytes, raw_sha256, status)``: the files of a folder against its manifest."""
    known = spark.read.schema("id string, raw_bytes long, raw_sha256 string").json(f"{path}/{MANIFEST}")
    return integrity.verify(known, read_files(spark, path, suffix, end)).join(known, "id", "left").select("id", "raw_bytes", "raw_sha256", "status")
