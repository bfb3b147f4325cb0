"""Quizzes: what can be asked, samples, shared sequences, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import times as tm

#: Least percent of each grade.
GRADES = ((90, "Excellent"), (70, "Great"), (50, "Good"))
DEFAULT_LENGTH = 10


def available(chapters: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Chapters with a question, their number of questions, and the length a quiz over each starts with."""
    counts = questions.groupBy(key).agg(F.count("*").alias("n_questions"))
    return chapters.join(counts, key).withColumn("start_length", F.least(F.lit(DEFAULT_LENGTH), "n_questions").cast("long"))


def shared(sequences: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """``(share_id, keys)`` to ``(share_id, place, <question columns>)``: order and repeats kept, unknown keys dropped."""
    return sequences.select("share_id", F.posexplode("keys").alias("place", key)).join(questions, key)


def hashed_sample(questions: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` questions in an order that only the seed and their keys decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return questions.withColumn("digest", digest).orderBy("digest").limit(n)


def random_sample(questions: DataFrame, n: int, seed: int) -> DataFrame:
    return questions.orderBy(F.rand(seed)).limit(n)


def grade(percent: Column) -> Column:
    out = F.when(percent >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        out = out.when(percent >= least, name)
    return F.when(percent.isNotNull(), out.otherwise("Keep Learning"))


def score(answers: DataFrame, correct: str, *keys: str) -> DataFrame:
    """Per key: answers, right ones, percent half up, and its grade; nothing is asked of an empty quiz."""
    sums = answers.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("n_correct"))
    return sums.withColumn("percent", tm.round_percent(F.col("n_correct"), F.col("n"))).withColumn("grade", grade(F.col("percent")))


def share_text(score: Column, total: Column, titles: Column, n_chapters: Column, ids: Column, url: str, name: str) -> Column:
    """The text that shares a result: score, percent, scope, and a link to the same questions in their order.

    The scope is general where all chapters were asked, their titles up to three of them, and unnamed beyond; null titles
    stand for a shared quiz.
    """
    percent = tm.round_percent(score, total).cast("string")
    scope = F.when(titles.isNull(), "Specific Challenge").when(F.size(titles) >= n_chapters, "General Knowledge").when(F.size(titles) <= 3, F.array_join(titles, ", ")).otherwise("Specific Chapters")
    asked = F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return F.concat(F.lit("I scored "), score.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent, F.lit(f"%) on the {name}!\nScope: "), scope, F.lit(f"\n\nCan you beat my score?\nTake the challenge: {url}#quiz?q="), asked)
