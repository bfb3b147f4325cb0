"""Positioned text runs to lines and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

LINE, RESET = 5, 8


def page_texts(runs: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, pos, text, x, y, has_eol)`` to ``(*keys, raw, text)``.

    A line breaks where y moves by more than five units, or x falls back by more than eight on the same line, unless the
    run before ended the line itself. Windows over each page's own runs, then one ordered join of its pieces.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    lag = lambda c: F.lag(c).over(order)
    moved = F.abs(F.col("y") - lag("y")) > LINE
    reset = (F.col("x") + RESET < lag("x")) & ~moved
    ended = lag("has_eol")
    # a run that ends in a line end itself, with nothing after it, can only be followed by a blank
    broken = F.coalesce((moved | reset) & ~ended, F.lit(False))
    rows = runs.withColumn("piece", F.concat(F.when(broken, "\n").otherwise(""), "text", F.when(F.col("has_eol"), "\n").otherwise(" ")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"])
    return rows.groupBy(*keys).agg(F.array_join(pieces, "").alias("raw")).withColumn("text", tx.normalize_source(F.col("raw")))


def page_scope(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(key, scope)``: the texts of the pages of each ``(key, first_page, last_page)``, in order; ranges may overlap.

    The ranges are one row for each chapter; each is spread over its pages, so the join is on equality.
    """
    spread = ranges.select("key", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    joined = spread.join(pages, "page")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return joined.groupBy("key").agg(F.array_join(parts, "\n").alias("scope"))


def page_dump(pages: DataFrame) -> DataFrame:
    """Each page text under its ``--- PAGE n ---`` mark."""
    return pages.select("page", F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text")).alias("text"))
