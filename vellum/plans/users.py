"""Queries over user activity and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import times as tm
from vellum.operators import activity, quiz
from vellum.plans.tables import registry, table

QUERIES, ORACLE_SQL, register = registry()


@register("SELECT user_id, event_type, ts, place FROM (SELECT user_id, event_type, max(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type)::INTEGER AS place FROM events WHERE event_type <> 'home' GROUP BY user_id, event_type) WHERE place <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.recent(table(spark, sf_dir, "events"), "user_id", "event_type", "ts").select("user_id", "event_type", "ts", "place")


_SEARCHES = "SELECT user_id, ts, CASE event_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN '  Gift ' WHEN 2 THEN 'gift' WHEN 3 THEN upper(event_type) WHEN 4 THEN event_type ELSE event_type || ' ' || event_id % 4 END AS term FROM events"


@register(f"""WITH s AS (SELECT user_id, ts, trim(term) AS term FROM ({_SEARCHES}) WHERE length(trim(term)) >= 2), l AS (SELECT user_id, lower(term) AS f, arg_max(term, (ts, term)) AS term, max(ts) AS ts FROM s GROUP BY 1, 2)
SELECT user_id, term, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, f)::INTEGER AS place FROM l) WHERE place <= 4""")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id") % 7, F.col("event_type")
    term = F.when(e == 0, "x").when(e == 1, "  Gift ").when(e == 2, "gift").when(e == 3, F.upper(kind)).when(e == 4, kind).otherwise(F.concat(kind, F.lit(" "), (F.col("event_id") % 4).cast("string")))
    return activity.recent_searches(table(spark, sf_dir, "events").select("user_id", "ts", term.alias("term")), "user_id", "term", "ts").select("user_id", "term", "ts", "place")


@register("SELECT user_id, props, max(ts) AS ts FROM events GROUP BY user_id, props HAVING count(*) % 2 = 1")
def bookmark_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.toggled(table(spark, sf_dir, "events"), "ts", "user_id", "props")


_EVENT = "{'kind': CASE event_type WHEN 'click' THEN 'toggle' WHEN 'view' THEN 'show' WHEN 'signup' THEN 'search' WHEN 'error' THEN 'clear' ELSE '' END, 'item': nullif(props, '{\"k\": 0}'), 'open': []::VARCHAR[], 'before': NULL::VARCHAR[]}"


@register(f"""WITH l AS (SELECT user_id, list({_EVENT} ORDER BY ts, event_id) AS e FROM events GROUP BY user_id), f AS (
    SELECT user_id, list_reduce(list_prepend({{'kind': '', 'item': NULL, 'open': []::VARCHAR[], 'before': NULL::VARCHAR[]}}, e), lambda a, x: {{'kind': '', 'item': NULL,
        'open': CASE WHEN x.kind = 'clear' THEN coalesce(a.before, a.open) WHEN x.item IS NULL THEN a.open WHEN x.kind = 'toggle' AND list_contains(a.open, x.item) THEN list_filter(a.open, lambda i: i <> x.item)
            WHEN x.kind IN ('toggle', 'show', 'search') AND NOT list_contains(a.open, x.item) THEN list_append(a.open, x.item) ELSE a.open END,
        'before': CASE WHEN x.kind = 'clear' THEN NULL WHEN x.kind = 'search' THEN coalesce(a.before, a.open) ELSE a.before END}}) AS s FROM l)
SELECT user_id, unnest(s.open) AS props FROM f""")
def expanded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks turn a group over, views open it, signups search, errors clear the search."""
    kind = F.when(F.col("event_type") == "click", "toggle").when(F.col("event_type") == "view", "show").when(F.col("event_type") == "signup", "search").when(F.col("event_type") == "error", "clear").otherwise("")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.when(F.col("props") != '{"k": 0}', F.col("props")).alias("props"))
    return activity.expanded_groups(events, "user_id", "kind", "props", "ts", "event_id")


@register("SELECT user_id, ts, event_type, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n - ts >= INTERVAL 30 MINUTE")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id", 30 * 60 * 1000)


@register("SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY n_chars, doc_id)")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.neighbours(table(spark, sf_dir, "documents"), "doc_id", "n_chars", "source", "lang").select("doc_id", "previous", "next")


@register("SELECT c_custkey, c_name, n_questions, least(10, n_questions) AS start_length FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_questions FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) USING (c_custkey)")
def chapter_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return quiz.available(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), asked, "c_custkey")


@register("SELECT event_id AS share_id, n AS place, p_partkey, p_name FROM (SELECT event_id, unnest([0, 1, 2]) AS n, unnest([event_id % 500, 999999999, event_id % 77]) AS p_partkey FROM events) JOIN part USING (p_partkey)")
def shared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.col("event_id") % 500, F.lit(999999999).cast("long"), F.col("event_id") % 77)
    return quiz.shared(table(spark, sf_dir, "events").select(F.col("event_id").alias("share_id"), keys.alias("keys")), table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")


@register("""SELECT source, n, n_correct, percent, CASE WHEN percent >= 90 THEN 'Excellent' WHEN percent >= 70 THEN 'Great' WHEN percent >= 50 THEN 'Good' WHEN percent IS NOT NULL THEN 'Keep Learning' END AS grade
FROM (SELECT source, count(*) AS n, count_if(quality = 1)::BIGINT AS n_correct, CAST(round(100.0::DOUBLE * count_if(quality = 1) / count(*)) AS INTEGER) AS percent FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("right", F.col("quality") == 1)
    return quiz.score(answers, "right", "source")


@register("SELECT source, doc_id // 4096 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS wrong FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 GROUP BY 1, 2")
def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrong answers of each source in parts of bounded size: those of one stretch of 4,096 ids each."""
    answers = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality != 1")
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return answers.groupBy("source", F.expr("doc_id div 4096").alias("part")).agg(F.array_join(ids, ",").alias("wrong"))


@register("SELECT p_partkey, p_name, sha256('quiz:' || p_partkey) AS digest FROM part ORDER BY digest LIMIT 10")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions that only the seed decides."""
    return quiz.hashed_sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 10, "quiz")


@register()
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.random_sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 10, 3)


@register("SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"r": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    return turns.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@register("SELECT p_partkey, least(greatest(p_retailprice / 12, 0), 100) AS progress, greatest(1, ceil(length(p_name) / greatest(1, floor(80 / (12 * 0.58::DOUBLE))))) * 16.0::DOUBLE AS height FROM part")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tm.clamp(F.col("p_retailprice") / 12, 0.0, 100.0).alias("progress"), tm.text_height(F.length("p_name"), 80, 12).cast("double").alias("height"))
