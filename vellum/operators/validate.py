"""Content rules: each is a small query that yields ``(rule, path, value)``; a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx


def _errors(df: DataFrame, rule: str, path: Column, value: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), path.cast("string").alias("path"), value.cast("string").alias("value"))


def required(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """A row for each of the columns that is null or blank."""
    blank = F.array(*[F.when(~F.coalesce(F.length(tx.trim(F.col(c).cast("string"))) > 0, F.lit(False)), F.lit(c)) for c in columns])
    found = df.select(F.col(key).alias("_key"), F.explode(F.array_compact(blank)).alias("_column"))
    return _errors(found, "required", F.col("_key"), F.col("_column"))


def in_domain(df: DataFrame, key: str, column: str, values: tuple[str, ...]) -> DataFrame:
    return _errors(df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))), f"domain of {column}", F.col(key), F.col(column))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each combination that occurs more than once; nulls don't count."""
    kept = df.dropna(subset=list(columns))
    found = kept.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return _errors(found, f"unique {', '.join(columns)}", F.concat_ws("/", *[F.col(c).cast("string") for c in columns]), F.col("n"))


def refers(df: DataFrame, key: str, column: str, to: DataFrame, target: str) -> DataFrame:
    """A row for each non-null reference without a target."""
    parents = to.select(F.col(target).alias("_target")).distinct()
    found = df.where(F.col(column).isNotNull()).join(parents, df[column] == parents["_target"], "left_anti")
    return _errors(found, f"{column} refers to {target}", F.col(key), F.col(column))


def exactly(df: DataFrame, group: str, test: Column, number: int = 1) -> DataFrame:
    """A row for each group in which the test doesn't hold for exactly ``number`` rows."""
    found = df.groupBy(group).agg(F.count_if(test).alias("n")).where(F.col("n") != number)
    return _errors(found, f"exactly {number}", F.col(group), F.col("n"))


def matches(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _errors(df.where(~F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False))), f"form of {column}", F.col(key), F.col(column))


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


#: The parts, the outcomes of results, the types of nodes, and the form of the ids.
PARTS = ("intro", "part1", "part2", "part3", "website")
OUTCOMES = ("compliant", "non-compliant", "conditional", "consult-legal", "not-required", "out-of-scope", "not-applicable", "prior-review", "in-scope")
NODE_TYPES = ("question", "result")


def flatten_sections(chapters: DataFrame) -> DataFrame:
    """``(chapter_id, index, title, legalText, qas, section_id)`` of nested chapters."""
    rows = chapters.select(F.col("id").alias("chapter_id"), F.posexplode("sections").alias("index", "s")).select("chapter_id", "index", "s.*")
    return rows.withColumn("section_id", tx.section_slug(F.col("chapter_id"), F.col("title"), F.col("index")))


def chapter_rules(chapters: DataFrame, icons: DataFrame) -> DataFrame:
    """Errors of nested chapters; ``icons`` has the registered ``name``s. Numbers are icons too."""
    sections = flatten_sections(chapters)
    questions = sections.select("section_id", F.posexplode("qas").alias("n", "qa")).select(F.concat_ws("/", "section_id", F.col("n").cast("string")).alias("path"), "qa.q", "qa.a")
    named = chapters.where(~tx.is_numeric_icon(F.col("icon")))
    return report(
        required(chapters, "id", "id", "title", "icon"),
        in_domain(chapters, "id", "part", PARTS),
        refers(named, "id", "icon", icons, "name"),
        unique(chapters, "id"),
        unique(sections, "section_id"),
        required(sections, "section_id", "legalText"),
        _errors(chapters.where("sections is null"), "sections is a list", F.col("id"), F.lit(None)),
        _errors(sections.where("qas is null"), "qas is a list", F.col("section_id"), F.lit(None)),
        required(questions, "path", "q", "a"),
    )


def tree_rules(trees: DataFrame, chapters: DataFrame) -> DataFrame:
    """Errors of nested trees: ids, nodes, targets of options inside the same tree, outcomes, and references to content.

    A tree without nodes gets that error and no further ones.
    """
    whole = trees.where(F.size("nodes") > 0)
    nodes = whole.select(F.col("id").alias("tree_id"), F.posexplode("nodes").alias("n", "node")).select("tree_id", "n", "node.*")
    nodes = nodes.withColumn("path", F.concat_ws("/", "tree_id", F.coalesce("id", F.col("n").cast("string"))))
    asked = nodes.where("type = 'question' and size(options) > 0")
    options = asked.select("tree_id", "path", F.posexplode("options").alias("o", "option")).select("tree_id", F.concat_ws("/", "path", F.col("o").cast("string")).alias("path"), "option.*")
    options = options.withColumn("target", F.concat_ws("/", "tree_id", "next"))
    sections = flatten_sections(chapters)
    return report(
        required(trees, "id", "id", "title"),
        matches(trees.where("id is not null"), "id", "id", "^dt-"),
        unique(trees, "id"),
        _errors(trees.where("not coalesce(size(nodes) > 0, false)"), "nodes", F.col("id"), F.lit(None)),
        unique(nodes, "tree_id", "id"),
        _errors(nodes.groupBy("tree_id").agg(F.count_if(F.col("id") == "start").alias("starts")).where("starts = 0"), "start node", F.col("tree_id"), F.lit(None)),
        required(nodes, "path", "id", "text"),
        in_domain(nodes, "path", "type", NODE_TYPES),
        _errors(nodes.where("type = 'question' and not coalesce(size(options) > 0, false)"), "options", F.col("path"), F.lit(None)),
        required(options, "path", "label", "next"),
        refers(options.where("next is not null"), "path", "target", nodes.where("id is not null"), "path"),
        in_domain(nodes.where("type = 'result'"), "path", "outcome", OUTCOMES),
        refers(whole.select("id", F.explode("relatedChapter").alias("related_chapter")), "id", "related_chapter", chapters.select(F.col("id").alias("chapter_id")), "chapter_id"),
        refers(whole.select("id", F.explode("relatedSection").alias("related_section")), "id", "related_section", sections, "section_id"),
    )


def question_rules(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Errors of quiz questions; one with fewer than two options gets that error and none about its options."""
    whole = questions.where("size(options) >= 2")
    options = whole.select(F.col("id").alias("question_id"), F.posexplode("options").alias("o", "option")).select("question_id", F.concat_ws("/", "question_id", F.col("o").cast("string")).alias("path"), "option.*")
    return report(
        required(questions, "id", "id", "question"),
        unique(questions, "id"),
        refers(questions, "id", "chapterId", chapters.select(F.col("id").alias("chapter_id")), "chapter_id"),
        _errors(questions.where("not coalesce(size(options) >= 2, false)"), "two options", F.col("id"), F.lit(None)),
        unique(options, "question_id", "id"),
        required(options, "path", "id", "text", "isCorrect"),
        exactly(options, "question_id", F.coalesce("isCorrect", F.lit(False))),
    )


def stats(chapters: DataFrame, trees: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of counts: chapters, sections, question-answer pairs, trees, nodes, questions."""
    sized = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).cast("long")
    content = chapters.agg(F.count("*").alias("chapters"), sized(F.expr("transform(sections, s -> 1)")).alias("sections"), F.coalesce(F.sum(F.expr("aggregate(sections, 0, (t, s) -> t + greatest(0, coalesce(size(s.qas), 0)))")), F.lit(0)).cast("long").alias("qas"))
    graphs = trees.agg(F.count("*").alias("trees"), sized(F.expr("transform(nodes, n -> 1)")).alias("nodes"))
    return content.join(graphs).join(questions.agg(F.count("*").alias("questions")))
