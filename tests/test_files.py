"""The file sink: all files and their manifest, or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.sources import documents, files


def test_files_come_back_as_they_were(spark, tmp_path):
    texts = ["a\r\nb\n", "", "ß💬 \n\n", "x" * 3_000_000, "﻿mark", '{"a": [1,  2]}\r\n']
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, raw string").repartition(4)
    path = str(tmp_path / "out")
    files.write_files(rows, path, ".txt")
    assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == [*(f"k{i}.txt" for i in range(6)), "manifest"]
    for i, t in enumerate(texts):
        with open(f"{path}/k{i}.txt", "rb") as file:
            assert file.read() == t.encode() + b"\n"
    assert {r["id"]: r["raw"] for r in files.read_files(spark, path, ".txt").collect()} == {f"k{i}": t for i, t in enumerate(texts)}
    assert {r["status"] for r in files.verify_files(spark, path, ".txt").collect()} == {"ok"}
    with open(f"{path}/k1.txt", "wb") as file:
        file.write(b"more\n")
    os.remove(f"{path}/k0.txt")
    assert {r["id"]: r["status"] for r in files.verify_files(spark, path, ".txt").where("status != 'ok'").collect()} == {"k0": "missing", "k1": "changed"}
    with pytest.raises(FileExistsError):
        files.write_files(rows, path, ".txt")


@pytest.mark.parametrize("wrong", [("a/b", "x"), ("k0", "again"), ("", "x"), ("k9", None)])
def test_plans_that_cannot_be_written_write_nothing(spark, tmp_path, wrong):
    rows = spark.createDataFrame([("k0", "x"), ("k1", "y"), wrong], "id string, raw string")
    with pytest.raises(ValueError):
        files.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.lit("x").alias("raw")).repartition(8)
    failing = rows.withColumn("raw", F.when(F.col("id") == "k77", F.raise_error(F.lit("no"))).otherwise(F.col("raw")))
    path = tmp_path / "out"
    spark.dataSource.register(files.OneFileEach)
    path.mkdir()
    with pytest.raises(Exception, match="no"):
        failing.write.format("one_file_each").mode("append").options(path=str(path)).save()
    assert not path.exists()
    files.write_files(rows, str(path))
    assert len(os.listdir(path)) >= 201


def test_an_empty_table_writes_an_empty_manifest(spark, tmp_path):
    files.write_files(spark.createDataFrame([], "id string, raw string"), str(tmp_path / "out"))
    assert spark.read.schema("id string").json(str(tmp_path / "out" / "manifest")).count() == 0


def test_files_are_written_by_tasks_of_few_rows_and_listed_by_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES", 3)
    folder, tracker = str(tmp_path / "out"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few rows", "few rows")
    try:
        files.write_files(spark.range(10).coalesce(1).selectExpr("concat('d', id) AS id", "repeat('x', int(id)) AS raw"), folder, ".txt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("few rows") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert 4 in tasks
    for found in (files.read_files(spark, folder, ".txt"), documents.read_texts(spark, f"{folder}/*.txt")):
        assert "InMemoryFileIndex(1 paths)" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 10
    assert files.verify_files(spark, folder, ".txt").where("status = 'ok'").count() == 10


def test_texts_are_read_by_their_bytes_as_the_text_source_reads_them(spark, tmp_path):
    import gzip

    for name, raw in {"a.txt": b"x\r\ny", "b.txt": "﻿ß\n💬".encode(), "c.txt": b"\xff\xfe\x00z", "d e.txt": b" \n", "none.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    with gzip.open(tmp_path / "f.txt.gz", "wb") as out:
        out.write(b"packed")
    bits = lambda df: {r["p"]: r["h"] for r in df.selectExpr("path AS p", "hex(text) AS h").collect()}
    for pattern in ("*.txt", "a.txt", "*"):
        whole = spark.read.text(f"{tmp_path}/{pattern}", wholetext=True).selectExpr("_metadata.file_path AS path", "value AS text")
        assert bits(documents.read_texts(spark, f"{tmp_path}/{pattern}")) == bits(whole), pattern
    plan = documents.read_texts(spark, f"{tmp_path}/*.txt")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan  # the text source takes about a millisecond for each file
    assert "packed" in {r["text"] for r in documents.read_texts(spark, f"{tmp_path}/*").collect()}
