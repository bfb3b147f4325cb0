"""Agendas made of events: one document for each user and day, a line ``HH:MM title`` for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions import times as tm
from vellum.operators import agenda
from vellum.plans.tables import registry, table

QUERIES, ORACLE_SQL, register = registry()
TITLES = {"click": "Hands-on training", "view": "Live surgery", "purchase": "Case presentation", "signup": "Plenary lecture", "error": "Coffee break"}
_TITLE = "CASE event_type WHEN 'click' THEN 'Hands-on training' WHEN 'view' THEN 'Live surgery' WHEN 'purchase' THEN 'Case presentation' WHEN 'signup' THEN 'Plenary lecture' WHEN 'error' THEN 'Coffee break' END"
_TYPE = "CASE event_type WHEN 'click' THEN 'Hands-on' WHEN 'view' THEN 'Streaming' WHEN 'purchase' THEN 'Case Study' WHEN 'signup' THEN 'General Educational' WHEN 'error' THEN 'Other' END"
_SESSIONS = f"""
WITH e AS (
    SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS doc_id, event_id, hour(ts) * 60 + minute(ts) AS m, event_type FROM events
), l AS (
    SELECT *, row_number() OVER w - 1 AS pos, lead(m) OVER w AS n FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY m, event_id)
), s AS (
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_TITLE} AS title, printf('%02d:%02d', m // 60, m % 60) AS start_time, CASE WHEN n IS NULL THEN '' ELSE printf('%02d:%02d', n // 60, n % 60) END AS end_time, CAST(coalesce(n - m, 0) AS INTEGER) AS duration_minutes, {_TYPE} AS type FROM l
)"""


def agendas(spark: SparkSession, sf_dir: str, twelve: bool = False) -> DataFrame:
    """``(doc_id, text)``; ``twelve`` writes hours 1 to 12 without am or pm."""
    events = table(spark, sf_dir, "events")
    title = F.lit(None).cast("string")
    for kind, text in TITLES.items():
        title = F.when(F.col("event_type") == kind, text).otherwise(title)
    hour = F.hour("ts")
    shown = F.format_string("%d:%02d", (hour + 11) % 12 + 1, F.minute("ts")) if twelve else F.format_string("%02d:%02d", hour, F.minute("ts"))
    line = F.struct((hour * 60 + F.minute("ts")).alias("m"), "event_id", F.concat(shown, F.lit(" "), title).alias("line"))
    doc = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("doc_id")
    grouped = events.groupBy(doc).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


@register(f"{_SESSIONS} SELECT * FROM s")
def agenda_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.parse(agendas(spark, sf_dir))


_ELIGIBLE = f"""{_SESSIONS}, t AS (
    SELECT doc_id, CAST(sum(duration_minutes) AS BIGINT) AS total, CAST(sum(CASE WHEN type = 'Hands-on' THEN duration_minutes ELSE 0 END) AS BIGINT) AS hands_on,
        CAST(sum(CASE WHEN type IN ('Hands-on', 'Streaming', 'Case Study') THEN duration_minutes ELSE 0 END) AS BIGINT) AS practical FROM s GROUP BY doc_id
), g AS (SELECT *, total > 0 AND 3 * hands_on >= total AND 2 * practical > total AS passes_agenda FROM t)"""


@register(f"{_ELIGIBLE} SELECT * FROM g")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.eligibility(agenda_sessions(spark, sf_dir), "doc_id")


@register(f"""{_ELIGIBLE} SELECT doc_id, printf('%dh %dm', total // 60, total % 60) AS shown_total, CASE WHEN total > 0 THEN CAST(round(100.0::DOUBLE * hands_on / total) AS INTEGER) END AS hands_on_percent,
    CASE WHEN length(doc_id) % 5 = 0 THEN NULL WHEN NOT passes_agenda THEN 'TPOEE' WHEN length(doc_id) % 2 = 0 THEN 'TPPT' ELSE 'MIXED' END AS final_class FROM g""")
def final_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("doc_id")
    first = F.when(n % 5 != 0, F.when(n % 2 == 0, "Yes").otherwise("No"))
    rows = eligibility(spark, sf_dir)
    return rows.select("doc_id", tm.format_duration(F.col("total")).alias("shown_total"), tm.round_percent(F.col("hands_on"), F.col("total")).alias("hands_on_percent"), agenda.final_class(F.col("passes_agenda"), first, F.lit("No"), F.lit("Yes")).alias("final_class"))


@register(f"""{_ELIGIBLE} SELECT doc_id, count(*) AS n_sessions, any_value(total) AS total,
    printf('%.1f', any_value(CASE WHEN total > 0 THEN floor(1000.0::DOUBLE * hands_on / total + 0.5) / 10 ELSE 0 END)) AS hands_on_percent, any_value(CASE WHEN passes_agenda THEN 'pass' ELSE 'fail' END) AS verdict FROM s JOIN g USING (doc_id) GROUP BY doc_id""")
def agenda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.report(agenda_sessions(spark, sf_dir), "doc_id")


@register("""
WITH RECURSIVE e AS (
    SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS doc_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY hour(ts) * 60 + minute(ts), event_id) - 1 AS line_no, (hour(ts) + 11) % 12 + 1 AS h, minute(ts) AS mi FROM events
), f AS (
    SELECT doc_id, line_no, (h * 60 + mi) AS start FROM e WHERE line_no = 0
    UNION ALL
    SELECT e.doc_id, e.line_no, CASE WHEN e.h < 12 AND f.start <= 960 AND e.h * 60 + e.mi < f.start AND e.h * 60 + e.mi + 720 - f.start BETWEEN 0 AND 180 THEN e.h * 60 + e.mi + 720 ELSE e.h * 60 + e.mi END
    FROM f JOIN e ON e.doc_id = f.doc_id AND e.line_no = f.line_no + 1
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(start AS INTEGER) AS start FROM f""")
def time_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without am or pm, decided by the session before."""
    return agenda.timed(agenda.mark_lines(agenda.lines(agendas(spark, sf_dir, twelve=True)))).select("doc_id", "line_no", "start")


@register("""
SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])(break|lunch|dinner|registration|welcome|closing|close|discussion|reception|coffee|refreshment|exhibition|farewell|buffet|tea|opening|certificate|end|closing|summary)([^a-z0-9_]|$)') OR contains(t, 'q&a') OR contains(t, 'q & a') THEN 'Other'
    WHEN regexp_matches(t, '(^|[^a-z0-9_])(cadaver|cadaveric|dissection|dissect|simulation|simulator)([^a-z0-9_]|$)') OR regexp_matches(t, 'hands on|hands-on|practical exercise|dry lab|wet lab|dry-lab|wet-lab|anatomical lab|live tissue|ex vivo|bone model') THEN 'Hands-on'
    WHEN regexp_matches(t, '(^|[^a-z0-9_])(streaming|demonstration|transmission)([^a-z0-9_]|$)') OR regexp_matches(t, 'live surgery|live surgeries|live demo|live broadcast|live transmission|operative demonstration|live case|pre-recorded operative') THEN 'Streaming'
    WHEN regexp_matches(t, '(^|[^a-z0-9_])roundtable([^a-z0-9_]|$)') OR regexp_matches(t, 'case study|case studies|case-based|clinical case|case presentation|case discussion|discussion cases|cases discussion|panel discussion') THEN 'Case Study'
    ELSE 'General Educational' END AS type
FROM (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS t FROM documents)""")
def classify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", agenda.classify(F.col("text")).alias("type"))


@register()
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggested name for each text."""
    return agenda.event_name(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(f"""{_SESSIONS}, c AS (SELECT doc_id, pos, pos % 3 AS k FROM s WHERE pos % 3 <> 2)
SELECT s.doc_id, s.pos, title, start_time, CASE WHEN c.k = 1 THEN '23:59' ELSE end_time END AS end_time, type,
    CAST(CASE WHEN c.k = 1 THEN 1439 - (split_part(start_time, ':', 1)::INT * 60 + split_part(start_time, ':', 2)::INT)
        WHEN end_time = '' THEN CASE WHEN start_time = '00:00' THEN 0 ELSE 1440 - (split_part(start_time, ':', 1)::INT * 60 + split_part(start_time, ':', 2)::INT) END
        ELSE duration_minutes END AS INTEGER) AS duration_minutes
FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.pos = s.pos WHERE c.k IS DISTINCT FROM 0""")
def agenda_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third session removed, every third given a new end; older changes of the same sessions don't count."""
    sessions = agenda_sessions(spark, sf_dir)
    none = F.lit(None).cast("string")
    change = lambda k, ts, removed, end: sessions.where(F.col("pos") % 3 == k).select("doc_id", "pos", F.lit(ts).alias("ts"), F.lit(removed).alias("removed"), none.alias("title"), none.alias("start_time"), F.lit(end).cast("string").alias("end_time"), none.alias("type"))
    changes = change(0, 1, False, "01:00").union(change(0, 2, True, None)).union(change(1, 5, False, "23:59")).union(change(1, 4, True, None))
    return agenda.edited(sessions, changes)


@register(f"""SELECT event_id, {_TITLE} AS title, printf('%02d:%02d', hour(ts), minute(ts)) AS clock, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes,
    CAST((1440 + 15 - (hour(ts) * 60 + minute(ts))) % 1440 AS INTEGER) AS until_quarter FROM events""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-hour times with am or pm, parsed back; minutes to a quarter past midnight."""
    events = table(spark, sf_dir, "events")
    title = F.lit(None).cast("string")
    for kind, text in TITLES.items():
        title = F.when(F.col("event_type") == kind, text).otherwise(title)
    written = F.concat(F.date_format("ts", "h:mm a"), F.lit(" "), title)
    part = lambda i: F.regexp_extract("written", tm.SINGLE, i)
    rows = events.select("event_id", written.alias("written"))
    clock = tm.clock(tm.to_minutes(part(1), part(2), tm.marker(part(3))))
    rows = rows.select("event_id", tx.trim(F.array_join(F.split("written", tm.SINGLE, 2), "")).alias("title"), clock.alias("clock"))
    return rows.select("event_id", "title", "clock", tm.minutes(F.col("clock")).alias("minutes"), tm.duration(F.col("clock"), F.lit("00:15")).alias("until_quarter"))


_KIND = "CASE l_returnflag WHEN 'A' THEN 'Hands-on training' WHEN 'R' THEN 'Live surgery' ELSE 'Plenary lecture' END"
_PROGRAMME = f"""WITH i AS (
    SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag, l_linenumber) AS k, l_partkey AS p, {_KIND} AS name, CASE l_returnflag WHEN 'A' THEN 'Hands-on' WHEN 'R' THEN 'Streaming' ELSE 'General Educational' END AS type FROM lineitem QUALIFY k <= 7
), t AS (
    SELECT *, row_number() OVER w - 1 AS pos, [480, 530, 580, 760, 800, 840, 885][k] AS start, [480 + 20 + p % 20, 530 + 35, 580 + 20 + p % 20, NULL, NULL, NULL, NULL][k] AS finish FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), n AS (SELECT *, coalesce(finish, lead(start) OVER (PARTITION BY doc_id ORDER BY k)) AS stop FROM t)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN k <= 3 THEN '[Workshop Programme]' || chr(10) ELSE '' END || name || CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN ' and questions' WHEN 2 THEN chr(10) || 'first point' || chr(10) || 'second point' ELSE ' at post' || 'graduate level' END AS title,
    printf('%02d:%02d', start // 60, start % 60) AS start_time, CASE WHEN stop IS NULL THEN '' ELSE printf('%02d:%02d', stop // 60, stop % 60) END AS end_time, coalesce(stop - start, 0)::INTEGER AS duration_minutes, type FROM n"""


def programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: each order's first seven lines as a programme with days, a section, ranges and single times in several spellings, bullets,
    continued and hyphenated titles, and lines that name no session."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_returnflag", "l_linenumber"))
    items = table(spark, sf_dir, "lineitem").withColumn("k", place).where("k <= 7")
    k, clock = F.col("k"), lambda m: F.format_string("%d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))
    stop = lambda start: start + 20 + F.col("l_partkey") % 20
    time = F.when(k == 1, F.concat(F.lit("8:00 - "), clock(stop(F.lit(480))))).when(k == 2, "08:50 am – 9:25am").when(k == 3, F.concat(F.lit("9.40 to "), F.replace(clock(stop(F.lit(580))), F.lit(":"), F.lit("h"))))
    time = time.when(k == 4, "12:40 pm").when(k == 5, "1:20").when(k == 6, "2.00").otherwise("14:45")
    name = F.when(F.col("l_returnflag") == "A", "Hands-on training").when(F.col("l_returnflag") == "R", "Live surgery").otherwise("Plenary lecture")
    way = F.col("l_partkey") % 4
    more = F.when(way == 0, "").when(way == 1, "\nand questions").when(way == 2, "\n• first point\n- second point").otherwise(" at post-\ngraduate level")
    before = F.when(k == 4, "Day 2\n").otherwise("")
    line = F.struct("k", F.concat(before, time, F.lit("  "), name, more).alias("line"))
    grouped = items.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    head = "Venue: main hall\r\n\nDay one\nWORKSHOP PROGRAMME\n8:00 - 18:00 Course day\n"
    return grouped.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


@register(_PROGRAMME)
def programme_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.parse(programmes(spark, sf_dir))


_REPORT = f"""WITH s AS ({_PROGRAMME}), t AS (
    SELECT doc_id, count(*) AS n_sessions, sum(duration_minutes)::BIGINT AS total, sum(CASE WHEN type = 'Hands-on' THEN duration_minutes ELSE 0 END)::BIGINT AS hands_on,
        sum(CASE WHEN type IN ('Hands-on', 'Streaming', 'Case Study') THEN duration_minutes ELSE 0 END)::BIGINT AS practical FROM s GROUP BY doc_id
), d AS (
    SELECT l_orderkey AS doc_id, arg_min(w, k) FILTER (w > 0) AS w FROM (
        SELECT l_orderkey, l_partkey % 4 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag, l_linenumber) AS k FROM lineitem QUALIFY k <= 7
    ) GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN 'No times here' WHEN w = 1 THEN 'and questions' WHEN w = 2 THEN 'first point second point' WHEN w = 3 THEN 'graduate level' ELSE 'My MedTech Event' END AS name, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN n_sessions END AS n_sessions, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN total END AS total,
    CASE WHEN doc_id % 10 NOT IN (3, 4) THEN printf('%.1f', CASE WHEN total > 0 THEN floor(1000.0::DOUBLE * hands_on / total + 0.5) / 10 ELSE 0 END) END AS hands_on_percent,
    CASE WHEN doc_id % 10 NOT IN (3, 4) THEN CASE WHEN total > 0 AND 3 * hands_on >= total AND 2 * practical > total THEN 'pass' ELSE 'fail' END END AS verdict, CASE doc_id % 10 WHEN 3 THEN 'no text' WHEN 4 THEN 'no sessions' END AS problem FROM d JOIN t USING (doc_id)"""


@register(_REPORT)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every programme; of ten, one has no text and one no times."""
    text = F.when(F.col("doc_id") % 10 == 4, "No times here").when(F.col("doc_id") % 10 != 3, F.regexp_replace("text", "^Venue: main hall", "Venue: hall"))
    return agenda.batch_report(programmes(spark, sf_dir).select("doc_id", text.alias("text")))
