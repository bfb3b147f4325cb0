"""Queries that write data as files of the readers' formats and read it back, and queries over single lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import agenda, runs
from vellum.plans.tables import registry, table
from vellum.sources import documents, files
from vellum.sources.staging import shared_dir

QUERIES, ORACLE_SQL, register = registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT 'd' || doc_id AS id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS raw_bytes, upper(sha256(coalesce(text, ''))) AS raw_sha256, 'ok' AS status FROM documents")
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text written to a file of its own, read back and held against the manifest."""
    folder = _folder(spark, "files")
    files.write_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("raw")), folder, ".txt")
    return files.verify_files(spark, folder, ".txt")


_CHAPTERS = "SELECT conv_id, count(*) AS n, sum(length(text)) AS size, max(turn) AS last FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"


@register(f"""SELECT 'c' || conv_id AS id, CASE WHEN conv_id % 13 = 0 THEN 'z' || conv_id ELSE 'c' || conv_id END AS file, n::INTEGER AS sections, size::BIGINT AS size, FALSE AS broken FROM ({_CHAPTERS}) WHERE conv_id % 17 <> 0
UNION ALL SELECT NULL, 'c' || conv_id, NULL, NULL, TRUE FROM ({_CHAPTERS}) WHERE conv_id % 17 = 0""")
def chapters_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapter files; some have another name than their id, some are cut short."""
    return _chapters(spark, sf_dir).select("id", "file", F.when(F.col("_corrupt_record").isNull(), F.size("sections")).alias("sections"), F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.length(s["legalText"])).alias("size"), F.col("_corrupt_record").isNotNull().alias("broken"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    sections = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["turn"].cast("string").alias("title"), t["text"].alias("legalText"), F.array().cast("array<struct<q: string, a: string>>").alias("qas")))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    whole = turns.groupBy("conv_id").agg(sections.alias("sections")).select("conv_id", F.to_json(F.struct(name.alias("id"), "sections")).alias("raw"))
    cut = F.when(F.col("conv_id") % 17 == 0, F.left("raw", F.length("raw") - 2)).otherwise(F.col("raw"))
    folder = _folder(spark, "chapters")
    files.write_files(whole.select(F.when((F.col("conv_id") % 13 == 0) & (F.col("conv_id") % 17 != 0), F.concat(F.lit("z"), F.col("conv_id").cast("string"))).otherwise(name).alias("id"), cut.alias("raw")), folder)
    return documents.read_chapters(spark, f"{folder}/*.json")


@register(f"""WITH c AS ({_CHAPTERS}), f AS (SELECT CASE WHEN conv_id % 17 = 0 THEN NULL ELSE 'c' || conv_id END AS id, CASE WHEN conv_id % 13 = 0 AND conv_id % 17 <> 0 THEN 'z' || conv_id ELSE 'c' || conv_id END AS file FROM c),
o AS (SELECT 'c' || conv_id AS id FROM c WHERE conv_id % 5 <> 0 UNION ALL SELECT 'm' || conv_id FROM c WHERE conv_id % 7 = 0)
SELECT file AS id, 'unexpected' AS problem FROM f WHERE file NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'missing' FROM o WHERE id NOT IN (SELECT file FROM f) UNION ALL SELECT file, 'other id' FROM f WHERE id IS DISTINCT FROM file""")
def order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter files against an order that lacks some and lists others that aren't there."""
    ids = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id").distinct()
    order = ids.where("conv_id % 5 != 0").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id")).union(ids.where("conv_id % 7 = 0").select(F.concat(F.lit("m"), F.col("conv_id").cast("string"))))
    return documents.against_order(_chapters(spark, sf_dir), order)


@register("""SELECT 't' || o_custkey AS id, len(list(o_orderkey))::INTEGER AS nodes, CASE o_custkey % 3 WHEN 0 THEN 'c1' WHEN 1 THEN 'c1,c2' ELSE '' END AS chapters FROM orders GROUP BY o_custkey""")
def trees_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written as files of one root, whose related chapter is a string, a list or missing."""
    node = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("result").alias("type"), F.col("o_orderpriority").alias("text"))
    trees = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(node)).alias("nodes"))
    related = F.when(F.col("o_custkey") % 3 == 0, ', "relatedChapter": "c1"').when(F.col("o_custkey") % 3 == 1, ', "relatedChapter": ["c1", "c2"]').otherwise("")
    raw = F.concat(F.lit('{"id": "t'), F.col("o_custkey").cast("string"), F.lit('"'), related, F.lit(', "nodes": '), "nodes", F.lit("}"))
    roots = trees.groupBy(F.expr("o_custkey div 64").alias("part")).agg(F.array_join(F.collect_list(raw), ",\n").alias("trees"))
    folder = _folder(spark, "trees")
    files.write_files(roots.select(F.concat(F.lit("p"), F.col("part").cast("string")).alias("id"), F.concat(F.lit('{"trees": ['), "trees", F.lit("]}")).alias("raw")), folder)
    return documents.read_trees(spark, f"{folder}/*.json").select("id", F.size("nodes").alias("nodes"), F.array_join("relatedChapter", ",").alias("chapters"))


@register("SELECT 'q' || p_partkey AS id, p_name AS question, 1 + p_size % 4 AS options, p_size % 2 = 0 AS correct FROM part")
def questions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as files of one list, a list for each 64 keys."""
    option = F.transform(F.sequence(F.lit(1), (1 + F.col("p_size") % 4).cast("int")), lambda i: F.struct(i.cast("string").alias("id"), ((i == 1) & (F.col("p_size") % 2 == 0)).alias("isCorrect")))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("question"), option.alias("options")).alias("q"))
    lists = asked.groupBy(F.expr("p_partkey div 64").alias("part")).agg(F.to_json(F.collect_list("q")).alias("raw"))
    folder = _folder(spark, "questions")
    files.write_files(lists.select(F.concat(F.lit("l"), F.col("part").cast("string")).alias("id"), "raw"), folder)
    return documents.read_questions(spark, f"{folder}/*.json").select("id", "question", F.size("options").cast("long").alias("options"), F.exists("options", lambda o: o["isCorrect"]).alias("correct"))


@register("SELECT 'd' || doc_id AS id, md5(coalesce(text, '') || chr(10)) AS digest FROM documents")
def texts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text written to a file of its own and read as a whole."""
    folder = _folder(spark, "texts")
    files.write_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("raw")), folder, ".txt")
    return documents.read_texts(spark, f"{folder}/*.txt").select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("id"), F.md5("text").alias("digest"))


_CLEAN = "html"
for _tag in ("script", "style", "iframe", "object", "embed"):
    _CLEAN = rf"regexp_replace({_CLEAN}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '(?i)</?(?:script|style|iframe|object|embed)\b[^>]*>', '', 'g'), '(?i)\s+on[a-z]+\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)(href|src)\s*=\s*([\"'']?)\s*javascript:[^\"''>\s]*', '\1=\2#', 'g')"
_UNSAFE = """coalesce(html, '') || '<p onclick="go(1)" class=x>t</p><a HREF=javascript:run()>' || url || '</a><iframe src=x>in</iframe><embed src=''javascript:x''>'"""


@register(f"SELECT page_id, {_CLEAN.replace('html', 'h', 1)} AS clean FROM (SELECT page_id, {_UNSAFE} AS h FROM pages)")
def sanitized_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with event attributes, script links and frames added."""
    unsafe = F.concat(F.coalesce("html", F.lit("")), F.lit('<p onclick="go(1)" class=x>t</p><a HREF=javascript:run()>'), "url", F.lit("</a><iframe src=x>in</iframe><embed src='javascript:x'>"))
    return table(spark, sf_dir, "pages").select("page_id", tx.sanitize_html(unsafe).alias("clean"))


_HEADER = "MEDTECH EUROPE - CODE OF ETHICAL BUSINESS PRACTICE"
_TRIMMED = r"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '[ \t-\r]+$', '')), chr(10))"


@register(rf"""SELECT doc_id AS page, '--- PAGE ' || doc_id || ' ---' || chr(10) || CASE doc_id % 4 WHEN 3 THEN '17' || chr(10) ELSE '' END || {_TRIMMED} AS text FROM documents""")
def page_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages under a header, with a page number and a running header or without; a number alone is no furniture."""
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    page = F.when(k == 0, F.concat(F.lit(_HEADER + "\r\n12  \r\nCHAPTER 3: EVENTS\r\n"), text)).when(k == 1, F.concat(F.lit(_HEADER + "\nSCOPE\n"), text)).when(k == 2, F.concat(F.lit(f"  {_HEADER}: more\n5\n"), text)).otherwise(F.concat(F.lit("17\n"), text))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), tx.remove_page_furniture(page).alias("text"))
    return runs.page_dump(pages)


@register(r"""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || CASE doc_id % 5 WHEN 0 THEN '--- PAGE 4 ---' WHEN 1 THEN ' 123 ' WHEN 2 THEN 'ANNEX II' WHEN 3 THEN 'MEDTECH EUROPE – CODE OF ETHICAL BUSINESS PRACTICE 2024' ELSE 'Annex II' END, chr(10)) AS p FROM documents)), t AS (SELECT doc_id, n, trim(line) AS x FROM l)
SELECT doc_id, count_if(regexp_matches(x, '^--- PAGE [0-9]+ ---$') OR regexp_matches(x, '^MEDTECH EUROPE\s+[-–]\s+CODE OF ETHICAL BUSINESS PRACTICE') OR regexp_matches(x, '^[0-9]+$') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND length(x) < 40)) AS furniture FROM t GROUP BY doc_id""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    last = F.when(k == 0, "--- PAGE 4 ---").when(k == 1, " 123 ").when(k == 2, "ANNEX II").when(k == 3, "MEDTECH EUROPE – CODE OF ETHICAL BUSINESS PRACTICE 2024").otherwise("Annex II")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), last), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(tx.is_furniture_line(F.col("line"))).alias("furniture"))


@register(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|<[^>]*$|[^<]+'), lambda p: CASE WHEN starts_with(p, '<') THEN p ELSE regexp_replace(p, '(?i)( an )', '<mark>\1</mark>', 'g') END), '') AS marked FROM pages""")
def highlight_as_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose blanks count."""
    return table(spark, sf_dir, "pages").select("page_id", tx.highlight(F.col("html"), " an ", keep_blanks=True).alias("marked"))


@register("""SELECT p_partkey, upper(left(p_type, 1)) || substr(p_type, 2) AS shown, 'mailto:a@b.example?subject=' || CASE WHEN p_size % 3 = 0 THEN 'Suggestion' ELSE replace(p_name, ' ', '%20') END || '&body=' || replace(replace(p_type, ' ', '%20'), '&', '%26') || '%3F%C3%A9!' AS link,
    length(p_type) > 0 AS has_key FROM part""")
def mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a capital first, and links to write about them."""
    parts = table(spark, sf_dir, "part")
    link = tx.mailto("a@b.example", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise("  "), F.concat("p_type", F.lit("?é!")))
    key = tx.stable_key(F.col("p_name"), F.col("p_partkey").cast("string"))
    return parts.select("p_partkey", tx.first_upper(F.col("p_type")).alias("shown"), link.alias("link"), key.rlike("^[0-9a-z]{7}$").alias("has_key"))


_WORDS = {"ignored": agenda.IGNORED, "header": agenda.HEADERS}
_LINE = """CASE event_id % 12 WHEN 0 THEN 'Day 2' WHEN 1 THEN 'Programme - Day two' WHEN 2 THEN 'Monday, 3 March 2025' WHEN 3 THEN '12 May 2024' WHEN 4 THEN 'Gold sponsorship: ' || event_type WHEN 5 THEN 'WORKSHOP ' || upper(event_type) WHEN 6 THEN 'Closing of the ' || event_type
    WHEN 7 THEN 'Closing discussion ' || event_type WHEN 8 THEN 'Course ' || event_type WHEN 9 THEN 'Dr ' || event_type WHEN 10 THEN 'A B C D ' || event_type ELSE 'Lecture on ' || event_type || ' holidays' END"""


@register(f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, event_id % 12 < 4 AS day, event_id % 12 = 4 AS ignored, event_id % 12 = 5 AS header, event_id % 12 = 8 OR event_id % 12 = 0 OR event_id % 12 = 1 AS high, event_id % 12 = 6 AS terminal,
    event_id % 12 IN (3, 9, 10) AS noise FROM l""")
def agenda_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every kind, each told by its own test."""
    line = F.col("line")
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_LINE).alias("line"))
    tests = {"day": agenda.is_day_change(line), "ignored": agenda.is_ignorable(line), "header": agenda.is_section_header(line), "high": agenda.is_high_level(line, F.lit(180)), "terminal": agenda.is_terminal(line), "noise": agenda.is_name_noise(line)}
    return lines.select("event_id", *[t.alias(n) for n, t in tests.items()])


@register(r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'My MedTech Event' ELSE 'Annual ' || upper(left(source, 1)) || substr(source, 2) || ' course on imaging in ' || lang END AS name FROM documents""".replace("upper(left(source, 1)) || substr(source, 2)", "source"))
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes whose name stands behind noise and goes on over lines, made from the documents' sources."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("Venue: hall\n12 May 2024\n• Annual "), "source", F.lit(" course\non imaging\nin "), "lang", F.lit("\n9:00 Welcome\nlater line\n"))
    return agenda.event_name(docs.select("doc_id", F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(name).alias("text")))
