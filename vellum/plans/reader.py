"""Queries over what a reader is shown: parts in order, badges, marks and links, shared scores, paths, nested rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import agenda, glossary, graph, integrity, quiz, search, validate
from vellum.plans import agendas
from vellum.plans.tables import registry, table

QUERIES, ORACLE_SQL, register = registry()


@register("SELECT p.label, p.place, d.source, count(*) AS n FROM documents d JOIN (VALUES ('en', 'English', 0), ('de', 'German', 1), ('fr', 'French', 2)) p(id, label, place) ON p.id = d.lang GROUP BY ALL")
def listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as parts; what is of no listed part is never shown."""
    shown = search.listed(table(spark, sf_dir, "documents"), "lang", (("en", "English"), ("de", "German"), ("fr", "French")))
    return shown.groupBy("label", "place", "source").agg(F.count("*").alias("n"))


@register("""SELECT conv_id, count_if(role = 'assistant') > 0 AS badge, count(*) >= 2 OR coalesce(max(CASE WHEN turn = 0 THEN trim(text) END), '') <> '' AS contents, count_if(length(text) > 200) > 0 AS available FROM conversations GROUP BY conv_id""")
def shown_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapters: turns are sections, answers their questions, the first turn the summary."""
    sections = F.collect_list(F.struct(F.when(F.col("role") == "assistant", F.array("turn")).otherwise(F.array()).alias("qas"), (F.length("text") > 200).alias("available")))
    chapters = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sections.alias("sections"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("summary"))
    return chapters.select("conv_id", F.exists("sections", lambda s: search.has_questions(s["qas"])).alias("badge"), search.has_contents(F.col("sections"), F.col("summary")).alias("contents"), (F.size(F.filter("sections", lambda s: s["available"])) > 0).alias("available"))


@register("""WITH q AS (SELECT p_brand, p_partkey // 64 AS part, count(*) AS n, count_if(p_size > 25) AS s, list(DISTINCT p_type ORDER BY p_type) AS t, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY ALL)
SELECT p_brand, part, 'I scored ' || s || '/' || n || ' (' || CAST(round(100.0::DOUBLE * s / n) AS INTEGER) || '%) on the Parts Quiz!' || chr(10) || 'Scope: ' || CASE WHEN len(t) >= 5 THEN 'General Knowledge' WHEN len(t) <= 3 THEN array_to_string(t, ', ') ELSE 'Specific Chapters' END
    || chr(10) || chr(10) || 'Can you beat my score?' || chr(10) || 'Take the challenge: https://x.example/quiz#quiz?q=' || ids AS share FROM q""")
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quiz over the parts of each brand, 64 keys at a time; types are its chapters."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", F.expr("p_partkey div 64").alias("part"))
    played = groups.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("score"), F.sort_array(F.collect_set("p_type")).alias("titles"), F.sort_array(F.collect_list("p_partkey")).alias("ids"))
    text = quiz.share_text(F.col("score"), F.col("n"), F.col("titles"), F.lit(5), F.col("ids"), "https://x.example/quiz", "Parts Quiz")
    return played.select("p_brand", "part", text.alias("share"))


@register("""WITH f AS (SELECT n_regionkey, min(n_nationkey) AS first FROM nation GROUP BY 1) SELECT n_regionkey AS region, n_nationkey AS nation, n_nationkey = first AS highlighted FROM nation JOIN f USING (n_regionkey)""")
def highlighted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's path leads to its first nation; options on it are highlighted."""
    nations = table(spark, sf_dir, "nation")
    first = nations.groupBy(F.col("n_regionkey").alias("region")).agg(F.min("n_nationkey").alias("first"))
    path = F.array(F.concat(F.lit("r"), F.col("region").cast("string")), F.concat(F.lit("n"), F.col("first").cast("string")))
    options = nations.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).join(first, "region")
    return options.select("region", "nation", graph.on_path(path, F.concat(F.lit("n"), F.col("nation").cast("string"))).alias("highlighted"))


_MARKED = r"""array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|<[^>]*$|[^<]+'), lambda p: CASE WHEN starts_with(p, '<') THEN p ELSE regexp_replace(p, {}, 'g') END), '')"""

_SHOWN = r"'(?i)\b(?:next page|contact|about|home|the|and)\b'"
_LINK = """list_transform(range(1, len(regexp_extract_all({0}, {1})) + 1), lambda k: '<span data-term="' || lower(regexp_extract_all({0}, {1})[k]) || '">' || regexp_extract_all({0}, {1})[k] || '</span>' || regexp_split_to_array({0}, {1})[k + 1])"""
_LINKED = f"""array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|<[^>]*$|[^<]+'), lambda p: CASE WHEN starts_with(p, '<') OR len(regexp_extract_all(p, {_SHOWN})) = 0 THEN p ELSE regexp_split_to_array(p, {_SHOWN})[1] || array_to_string({_LINK.format('p', _SHOWN)}, '') END), '')"""


@register(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_MARKED.format("'(?i)(an)', '<mark>\\1</mark>'")} WHEN 1 THEN coalesce(html, '') ELSE {_LINKED} END AS shown FROM pages""")
def shown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search beats glossary links, and the glossary itself is never linked: every third page is searched, every third is glossary."""
    pages = table(spark, sf_dir, "pages")
    terms = ["the", "and", "home", "about", "contact", "next page"]
    searched = tx.shown_html(F.col("html"), " an ", terms, F.lit(False))
    plain = tx.shown_html(F.col("html"), " ", terms, F.col("page_id") % 3 == 1)
    return pages.select("page_id", F.when(F.col("page_id") % 3 == 0, searched).otherwise(plain).alias("shown"))


@register(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), k AS (SELECT DISTINCT w[1] || ' ' || w[2] AS key FROM w WHERE len(w) >= 2 UNION SELECT DISTINCT w[3] FROM w WHERE len(w) >= 3), g AS (
    SELECT doc_id, unnest(w) AS key FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS key FROM w
) SELECT doc_id, key, count(*) AS hits FROM g WHERE key IN (SELECT key FROM k) GROUP BY ALL""")
def phrase_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one and two words, taken from the texts' beginnings, in all texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    keys = words.where("size(w) >= 2").select(F.array_join(F.slice("w", 1, 2), " ").alias("key")).union(words.where("size(w) >= 3").select(F.get("w", F.lit(2)))).distinct()
    return glossary.phrase_hits(docs, keys, 2)


@register(f"""{agendas._SESSIONS} SELECT doc_id, pos, CASE title WHEN 'Hands-on training' THEN '<mark>Hands-on</mark> training' WHEN 'Live surgery' THEN '<mark>Live surgery</mark>' WHEN 'Case presentation' THEN '<mark>Case presentation</mark>' WHEN 'Coffee break' THEN '<mark>Coffee</mark> <mark>break</mark>' ELSE title END AS marked FROM s""")
def marked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agendas.agenda_sessions(spark, sf_dir).select("doc_id", "pos", agenda.mark_keywords(F.col("title"), F.col("type")).alias("marked"))


@register("""SELECT event_id AS key, 2::BIGINT AS n, upper(sha256('[["/kind","' || event_type || '"],["/a~1b/0","' || replace(props, '"', '\\"') || '"]]')) AS digest FROM events""".replace("\\\\", "\\"))
def strings_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("number"), F.array("props").alias("a/b")))
    return integrity.strings_digest(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), raw.alias("raw")))


@register("""WITH q AS (SELECT 'q' || conv_id AS id, CAST(conv_id % 7 AS VARCHAR) AS chapter, count(*) AS n, count_if(role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT 'chapterId refers to chapter_id' AS rule, id AS path, chapter AS value FROM q WHERE chapter IN ('5', '6') UNION ALL SELECT 'two options', id, NULL FROM q WHERE n < 2 UNION ALL SELECT 'exactly 1', id, CAST(a AS VARCHAR) FROM q WHERE n >= 2 AND a <> 1
UNION ALL SELECT 'required', 'q' || conv_id || '/' || o, 'text' FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 2 AND trim(coalesce(text, '')) = ''""")
def question_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as quiz questions: turns are options, answers the right ones; two of seven chapters don't exist."""
    option = F.struct("turn", F.struct(F.col("turn").cast("string").alias("id"), "text", (F.col("role") == "assistant").alias("isCorrect")).alias("o"))
    options = F.transform(F.array_sort(F.collect_list(option)), lambda x: x["o"])
    questions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(options.alias("options"))
    questions = questions.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("id"), F.lit("?").alias("question"), (F.col("conv_id") % 7).cast("string").alias("chapterId"), "options")
    chapters = spark.range(5).select(F.col("id").cast("string").alias("id"))
    return validate.question_rules(questions, chapters)


_TREES = """t AS (SELECT r_regionkey AS r, CASE WHEN r_regionkey = 3 THEN 'x-3' ELSE 'dt-' || r_regionkey END AS id, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS title FROM region),
n AS (SELECT t.id AS tree_id, n_nationkey AS k, CASE WHEN n_nationkey = first AND r <> 1 THEN 'start' ELSE CAST(n_nationkey AS VARCHAR) END AS id, CASE n_nationkey % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'result' ELSE 'other' END AS type,
    CASE n_nationkey % 4 WHEN 1 THEN 'compliant' ELSE 'maybe' END AS outcome, CAST((n_nationkey + 5) % 25 AS VARCHAR) AS next FROM nation JOIN t ON n_regionkey = r JOIN (SELECT n_regionkey, min(n_nationkey) AS first FROM nation GROUP BY 1) USING (n_regionkey))"""


@register(f"""WITH {_TREES} SELECT 'required' AS rule, id AS path, 'title' AS value FROM t WHERE title = '' UNION ALL SELECT 'form of id', id, id FROM t WHERE id NOT LIKE 'dt-%' UNION ALL SELECT 'start node', id, NULL FROM t WHERE r = 1
UNION ALL SELECT 'domain of type', tree_id || '/' || id, type FROM n WHERE type = 'other' UNION ALL SELECT 'domain of outcome', tree_id || '/' || id, outcome FROM n WHERE type = 'result' AND outcome = 'maybe'
UNION ALL SELECT 'target refers to path', tree_id || '/' || id || '/0', tree_id || '/' || next FROM n WHERE type = 'question' AND tree_id || '/' || next NOT IN (SELECT tree_id || '/' || id FROM n)
UNION ALL SELECT 'related_chapter refers to chapter_id', id, CAST(r AS VARCHAR) FROM t WHERE r = 4""")
def tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as trees whose nodes are nations, with faults of every kind that the data can show."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key, text = F.col("n_nationkey"), lambda c: c.cast("string")
    first = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    kind = F.when(key % 3 == 0, "question").when(key % 3 == 1, "result").otherwise("other")
    node = F.struct(
        F.when((key == F.col("first")) & (F.col("n_regionkey") != 1), "start").otherwise(text(key)).alias("id"),
        kind.alias("type"),
        F.col("n_name").alias("text"),
        F.when(key % 4 == 1, "compliant").otherwise("maybe").alias("outcome"),
        F.array(F.struct(F.col("n_name").alias("label"), text((key + 5) % 25).alias("next"))).alias("options"),
    )
    nodes = nations.join(first, "n_regionkey").groupBy("n_regionkey").agg(F.collect_list(node).alias("nodes"))
    trees = regions.join(nodes, F.col("r_regionkey") == F.col("n_regionkey"))
    number = F.col("r_regionkey")
    trees = trees.select(F.when(number == 3, "x-3").otherwise(F.concat(F.lit("dt-"), text(number))).alias("id"), F.when(number == 2, "").otherwise(F.col("r_name")).alias("title"), "nodes", F.array(text(number)).alias("relatedChapter"), F.array().cast("array<string>").alias("relatedSection"))
    section = "array<struct<title: string, legalText: string, qas: array<struct<q: string, a: string>>>>"
    chapters = spark.range(4).select(text(F.col("id")).alias("id"), F.array().cast(section).alias("sections"))
    return validate.tree_rules(trees, chapters)
