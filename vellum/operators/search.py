"""Counts of a search term per document and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx

METRICS = ("title", "text", "qa")


def count_hits(docs: DataFrame, term: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Add ``<metric>_hits`` for title, text and qa columns of ``docs`` and their sum ``hits``; metrics not asked for are 0."""
    counts = {f"{m}_hits": tx.occurrences(F.col(m), term) if m in metrics else F.lit(0) for m in METRICS}
    out = docs.withColumns({k: v.cast("long") for k, v in counts.items()})
    return out.withColumn("hits", sum(F.col(f"{m}_hits") for m in METRICS))


def group_totals(hits: DataFrame, *keys: str) -> DataFrame:
    """Totals of each group with any hit, and ``expanded``: whether the group opens by itself."""
    sums = hits.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*[f"{m}_hits" for m in METRICS], "hits")], F.count_if(F.col("hits") > 0).alias("items"))
    return sums.where("hits > 0").withColumn("expanded", F.lit(True))


def filter_titles(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows with the query in any of the columns, in any case; an empty query keeps all."""
    if not query:
        return df
    found = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower())) for c in columns]
    test = found[0]
    for other in found[1:]:
        test = test | other
    return df.where(test)


#: The parts in the order they are listed, with their labels.
PARTS = (("intro", "Introductory Chapters"), ("part1", "Part 1: The Code"), ("part2", "Part 2: Complaint Handling"), ("part3", "Part 3: Annexes & Glossary"), ("website", "Website"))


def listed(chapters: DataFrame, part: str = "part", parts: tuple[tuple[str, str], ...] = PARTS) -> DataFrame:
    """Add ``label`` and ``place`` of each chapter's part; chapters of any other part are left out, as they are never listed."""
    known = chapters.sparkSession.createDataFrame([(name, label, place) for place, (name, label) in enumerate(parts)], "_part string, label string, place int")
    return chapters.join(F.broadcast(known), F.col(part) == F.col("_part")).drop("_part")


def has_questions(qas: Column) -> Column:
    """Whether a section shows its badge of questions."""
    return F.coalesce(F.size(qas) > 0, F.lit(False))


def has_contents(sections: Column, summary: Column) -> Column:
    """Whether a chapter shows a list of contents: it has two sections or more, or a summary."""
    return (F.coalesce(F.size(sections), F.lit(0)) >= 2) | F.coalesce(F.length(tx.trim(summary)) > 0, F.lit(False))
