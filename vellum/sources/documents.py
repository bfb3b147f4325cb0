"""Readers of nested documents, texts and stored state, and writers of one file for each document."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAPTER = "id string, part string, title string, icon string, summary string, sections array<struct<title: string, legalText: string, qas: array<struct<q: string, a: string>>>>"
NODE = "struct<id: string, type: string, text: string, helpText: string, outcome: string, reference: string, options: array<struct<label: string, next: string>>>"
TREE = f"id string, title string, category string, description string, relatedChapter variant, relatedSection variant, nodes array<{NODE}>"
QUESTION = "id string, chapterId string, question string, options array<struct<id: string, text: string, isCorrect: boolean>>, hint string, explanation string"


def as_array(value: Column) -> Column:
    """A variant that holds a string or a list of strings, as a list; null is an empty one."""
    whole = F.try_variant_get(value, "$", "array<string>")
    one = F.try_variant_get(value, "$", "string")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<string>")).otherwise(F.coalesce(whole, F.array(one)))


def opened(spark: SparkSession, path: str) -> tuple[DataFrameReader, str]:
    """A reader, and what to load with it. A pattern for the names in one folder becomes a filter, so that the folder is
    listed once and its files aren't each a path of their own; where none fits there are no rows."""
    folder, _, name = path.rpartition("/")
    if folder and any(c in name for c in "*?[{") and not any(c in folder for c in "*?[{"):
        return spark.read.option("pathGlobFilter", name), folder
    return spark.read, path


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """One chapter for each JSON file, with ``file``, its name without folder and ending. Broken files keep their text in ``_corrupt_record``."""
    reader, path = opened(spark, path)
    files = reader.schema(f"{CHAPTER}, _corrupt_record string").json(path, multiLine=True)
    return files.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("file"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """The trees of a file whose root holds them under ``trees``; related ids are lists whatever they were."""
    tree = T.StructType.fromDDL(TREE)
    reader, path = opened(spark, path)
    roots = reader.schema(T.StructType([T.StructField("trees", T.ArrayType(tree))])).json(path, multiLine=True)
    trees = roots.select(F.posexplode("trees").alias("pos", "t")).select("pos", "t.*")
    return trees.withColumns({"relatedChapter": as_array(F.col("relatedChapter")), "relatedSection": as_array(F.col("relatedSection"))})


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a file whose root is a list of them."""
    reader, path = opened(spark, path)
    return reader.schema(QUESTION).json(path, multiLine=True)


def against_order(files: DataFrame, order: DataFrame) -> DataFrame:
    """``(id, problem)``: files that the order list lacks, listed ids without a file, and files whose id isn't their name."""
    extra = files.join(order, files["file"] == order["id"], "left_anti").select(F.col("file").alias("id"), F.lit("unexpected").alias("problem"))
    missing = order.join(files, files["file"] == order["id"], "left_anti").select("id", F.lit("missing").alias("problem"))
    unlike = files.where(~F.col("id").eqNullSafe(F.col("file"))).select(F.col("file").alias("id"), F.lit("other id").alias("problem"))
    return extra.union(missing).union(unlike)


#: Names that no compressed file has.
PLAIN = re.compile(r"\.(?:txt|text|md|html?|xml|csv|json)$", re.IGNORECASE)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: each file as one text.

    The text source makes a Hadoop configuration for each file, which costs more than most texts, so files whose pattern ends
    in a plain name's ending are read as bytes. What may be compressed is left to the text source, which unpacks it.
    """
    plain = PLAIN.search(path)
    reader, path = opened(spark, path)
    files = reader.format("binaryFile").load(path) if plain else reader.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text") if plain else F.col("value").alias("text"))


#: Names of a word-processor file's body: paragraph, run of text, tab, and what holds no text of its own.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ASIDE = (f"{_WORD}pPr", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Choice")


def word_text(content: bytes) -> str | None:
    """The text of a zipped word-processor file, each paragraph followed by an empty line; None if it can't be read."""
    parts: list[str] = []
    aside = 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as files, files.open("word/document.xml") as body:
            for event, node in ElementTree.iterparse(body, ("start", "end")):
                if node.tag in _ASIDE:
                    aside += 1 if event == "start" else -1
                elif event == "end" and not aside:
                    if node.tag == f"{_WORD}t":
                        parts.append(node.text or "")
                    elif node.tag == f"{_WORD}tab":
                        parts.append("\t")
                    elif node.tag == f"{_WORD}p":
                        parts.append("\n\n")
                        node.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, zlib.error):
        return None
    return "".join(parts)


@F.pandas_udf(T.StringType())
def _word_texts(content: pd.Series) -> pd.Series:
    return content.map(word_text)


def read_word_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, problem)`` of each file: a word-processor file's text, or the problem ``unreadable``; files whose
    names don't end as those do are ``unsupported`` and not opened. Files without a byte give no row."""
    reader, path = opened(spark, path)
    files = reader.format("binaryFile").load(path)
    known = F.lower("path").rlike(r"\.docx?$")
    read = files.where(known).select("path", _word_texts("content").alias("text"))
    read = read.select("path", "text", F.when(F.col("text").isNull(), "unreadable").alias("problem"))
    return read.union(files.where(~known).select("path", F.lit(None).cast("string"), F.lit("unsupported")))


def stored_list(text: Column, item: str) -> Column:
    """A stored JSON list of ``item``; anything that can't be read is an empty one."""
    kind = f"array<{item}>"
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def registered_names(source: Column, variable: str) -> Column:
    """The keys of ``const <variable> = {...}`` in a source text."""
    body = F.regexp_extract(source, rf"(?s)const\s+{variable}\s*=\s*\{{(.*?)\}}", 1)
    return F.regexp_extract_all(body, F.lit(r"""(?m)^\s*['"]?([A-Za-z0-9_-]+)['"]?\s*(?:,|:|$)"""), F.lit(1))


def write_each(df: DataFrame, path: str, key: str = "id") -> None:
    """One folder of JSON for each key; an existing target is an error. Rows of a key are not gathered: the writer splits by value."""
    df.write.partitionBy(key).mode("errorifexists").json(path)
