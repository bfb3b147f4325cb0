"""Queries over structured content: validation, integrity, routes, positioned runs, decision graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import graph, integrity, routes, runs, validate
from vellum.plans.tables import registry, table

QUERIES, ORACLE_SQL, register = registry()

_REPORT = r"""
    SELECT 'required' AS rule, CAST(doc_id AS VARCHAR) AS path, 'title' AS value FROM documents WHERE trim(left(coalesce(text, ''), doc_id % 2)) = ''
    UNION ALL SELECT 'domain of lang', CAST(doc_id AS VARCHAR), lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')
    UNION ALL SELECT 'unique source, n_chars', source || '/' || n_chars, CAST(count(*) AS VARCHAR) FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source, n_chars HAVING count(*) > 1
    UNION ALL SELECT 'doc_id refers to doc_id', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'exactly 1', CAST(conv_id AS VARCHAR), CAST(count_if(role = 'assistant') AS VARCHAR) FROM conversations GROUP BY conv_id HAVING count_if(role = 'assistant') <> 1
    UNION ALL SELECT 'form of source', CAST(doc_id AS VARCHAR), source FROM documents WHERE source IS NULL OR NOT regexp_matches(source, '^src1')"""


@register(f"SELECT * FROM ({_REPORT})")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, turns = (table(spark, sf_dir, n) for n in ("documents", "labels", "conversations"))
    titled = docs.withColumn("title", F.expr("left(coalesce(text, ''), int(doc_id % 2))"))
    return validate.report(
        validate.required(titled, "doc_id", "title"),
        validate.in_domain(docs, "doc_id", "lang", ("en", "de")),
        validate.unique(docs, "source", "n_chars"),
        validate.refers(docs, "doc_id", "doc_id", labels, "doc_id"),
        validate.exactly(turns, "conv_id", F.col("role") == "assistant"),
        validate.matches(docs, "doc_id", "source", "^src1"),
    )


@register(f"SELECT rule, count(*) AS n FROM ({_REPORT}) GROUP BY rule")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_report(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


@register("SELECT 'o_custkey refers to c_custkey' AS rule, CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers outside all segments but one."""
    parents = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'")
    return validate.refers(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", parents, "c_custkey")


def nested_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of the conversations: one for each, a section for each user turn with the answer that follows as its pair."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    section = F.struct(F.expr("left(text, 20)").alias("title"), F.col("text").alias("legalText"), F.when(F.col("turn") % 3 != 0, F.array(F.struct(F.col("role").alias("q"), F.col("text").alias("a")))).otherwise(F.array().cast("array<struct<q: string, a: string>>")).alias("qas"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("t"))
    sections = F.transform("t", lambda x: x["s"])
    return grouped.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.when(F.col("conv_id") % 4 == 0, "part9").otherwise("part1").alias("part"), F.lit("Title").alias("title"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).otherwise("Book").alias("icon"), F.lit("").alias("summary"), sections.alias("sections")
    )


@register("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS chapters, count(*) AS sections, count_if(turn % 3 <> 0)::BIGINT AS qas, (SELECT count(*) FROM customer) AS trees, (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM part) AS questions FROM conversations""")
def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("nodes"))
    customers = table(spark, sf_dir, "customer")
    trees = customers.join(nodes, customers["c_custkey"] == nodes["o_custkey"], "left").select("c_custkey", "nodes")
    return validate.stats(nested_chapters(spark, sf_dir), trees, table(spark, sf_dir, "part"))


@register("""SELECT 'domain of part' AS rule, 'c' || conv_id AS path, 'part9' AS value FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 0
UNION ALL SELECT 'icon refers to name', 'c' || conv_id, 'Book' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 1
UNION ALL SELECT 'unique section_id', s, CAST(count(*) AS VARCHAR) FROM (SELECT 'c' || conv_id || '-' || regexp_replace(regexp_replace(lower(left(text, 20)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM conversations) GROUP BY s HAVING count(*) > 1""")
def chapter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    icons = spark.createDataFrame([("Star",), ("Home",)], "name string")
    return validate.chapter_rules(nested_chapters(spark, sf_dir), icons)


@register("SELECT doc_id, upper(sha256(coalesce(text, ''))) AS digest, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS raw_bytes FROM documents")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("raw"))
    return integrity.manifest(files).select(F.col("id").alias("doc_id"), F.col("raw_sha256").alias("digest"), "raw_bytes")


@register("SELECT upper(sha256(text)) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def row_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", integrity.digest(F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("""WITH a AS (SELECT lang, doc_id >> 12 AS k, count(*) AS n, upper(sha256(string_agg(d, '' ORDER BY doc_id, d))) AS d FROM (SELECT lang, doc_id, upper(sha256(CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, ''))) AS d FROM documents) GROUP BY ALL),
b AS (SELECT lang, k >> 12 AS k, sum(n) AS n, upper(sha256(string_agg(d, '' ORDER BY k))) AS d FROM a GROUP BY lang, a.k >> 12) SELECT lang, sum(n)::BIGINT AS n, upper(sha256(string_agg(d, '' ORDER BY k))) AS digest FROM b GROUP BY lang""")
def aggregate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.table_digest(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@register("SELECT conv_id, upper(sha256(string_agg(text, '' ORDER BY turn))) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return integrity.rebuild(turns, "turn", "text", "conv_id").select("conv_id", integrity.digest(F.col("text")).alias("digest"))


@register("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 AND doc_id % 13 <> 0 THEN 'changed' WHEN doc_id % 13 = 0 THEN 'unexpected' ELSE 'ok' END AS status FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)")
def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("raw"))
    known = integrity.manifest(docs.where("id % 13 != 0"))
    files = docs.where("id % 11 != 0").withColumn("raw", F.when(F.col("id") % 7 == 0, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    return integrity.verify(known, files)


@register("SELECT id, problem FROM (SELECT source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END AS id FROM documents) d, (SELECT 'unsafe id' AS problem) WHERE id LIKE '%/' UNION ALL SELECT source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END, 'duplicate id' FROM documents GROUP BY 1 HAVING count(*) > 1")
def split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.concat("source", F.when(F.col("doc_id") % 3 == 0, "/").otherwise("")).alias("id"))
    return integrity.split_problems(ids)


@register("SELECT event_id AS key, 0 AS n, '/kind' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 1, '/a~1b/0', props FROM events")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("number"), F.array("props").alias("a/b")))
    return integrity.json_strings(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), raw.alias("raw")))


@register("""SELECT event_id AS key, n AS pos, CASE n WHEN 0 THEN 8 ELSE 8 + length(props) + 3 END::INTEGER AS begin, CASE n WHEN 0 THEN 8 + length(props) ELSE 8 + length(props) + 3 + length(event_type) + 2 END::INTEGER AS "end",
    CASE n WHEN 0 THEN props ELSE '"' || event_type || '"' END AS element FROM events, (SELECT unnest([0, 1]) AS n)""")
def json_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array elements as written, blanks included."""
    raw = F.concat(F.lit('{ "x": ['), "props", F.lit(' , "'), "event_type", F.lit('" ] }'))
    return integrity.array_slices(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), raw.alias("raw")), "x").select("key", "pos", "begin", "end", "element")


@register("""SELECT event_id AS key, CASE event_id % 7 WHEN 1 THEN 'brackets without end' WHEN 2 THEN 'colon expected' WHEN 3 THEN 'wrong closing bracket' WHEN 4 THEN 'object expected' WHEN 5 THEN 'comma or ] expected' ELSE 'string without end' END AS problem,
    CASE event_id % 7 WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 8 + length(props) WHEN 4 THEN 0 WHEN 5 THEN 9 + length(props) ELSE 10 + length(props) END::INTEGER AS problem_at FROM events WHERE event_id % 7 <> 0""")
def json_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of seven documents are broken, each in its way; every one has one row that says how and where."""
    whole = F.concat(F.lit('{ "x": ['), "props", F.lit(' , "'), "event_type", F.lit('" ] }'))
    ways = (whole, F.concat(F.lit('{ "x": ['), "props"), F.concat(F.lit('{ "x" ['), "props", F.lit("]}")), F.concat(F.lit('{ "x": ['), "props", F.lit("} ]")), F.concat("props", F.lit("]")), F.concat(F.lit('{ "x": ['), "props", F.lit(' "a"]}')), F.concat(F.lit('{ "x": ['), "props", F.lit(', "a]}')))
    broken = F.when(F.col("event_id") % 7 == 4, F.concat(F.lit("["), "props", F.lit("]")))
    for k, way in enumerate(ways):
        broken = broken.when(F.col("event_id") % 7 == k, way)
    found = integrity.array_slices(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), broken.alias("raw")), "x")
    return found.where("problem is not null").select("key", "problem", "problem_at")


_FAULTS = """t AS (SELECT conv_id AS source, turn AS pos, conv_id % 11 AS fault, text, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id))"""
_VERIFY = f"""WITH {_FAULTS}, s AS (SELECT source, min(pos) AS first, any_value(fault) AS fault, any_value(n) AS n FROM t GROUP BY source), f AS (
    SELECT source, 'f' || first || '.json' AS file, first, fault, n FROM s), bad AS (
    SELECT source, unnest(['raw bytes', 'raw digest', 'string digest', 'section routes']) AS "check", file AS subject FROM f WHERE fault = 1
    UNION ALL SELECT source, unnest(['source bytes', 'source digest', 'content digest']), '' FROM f WHERE fault = 1
    UNION ALL SELECT source, 'line end', file FROM f WHERE fault = 2
    UNION ALL SELECT source, 'file set', file FROM f WHERE fault = 3
    UNION ALL SELECT source, unnest(['source bytes', 'source digest', 'content digest', 'total chapters', 'total sections', 'total qas', 'total strings']), '' FROM f WHERE fault = 3
    UNION ALL SELECT source, 'file set', 'other.json' FROM f WHERE fault = 4
    UNION ALL SELECT source, unnest(['raw bytes', 'raw digest', 'string count', 'string digest', 'question count']), file FROM f WHERE fault = 5
    UNION ALL SELECT source, unnest(['source bytes', 'source digest', 'content digest', 'total qas', 'total strings']), '' FROM f WHERE fault = 5
    UNION ALL SELECT source, 'version', '' FROM f WHERE fault = 6
    UNION ALL SELECT source, unnest(['raw bytes', 'raw digest']), file FROM f WHERE fault = 7
    UNION ALL SELECT source, unnest(['source bytes', 'source digest']), '' FROM f WHERE fault = 7
    UNION ALL SELECT source, 'order', CAST(first AS VARCHAR) FROM f WHERE fault = 8
    UNION ALL SELECT source, 'chapter order', file FROM f WHERE fault = 8
    UNION ALL SELECT source, unnest(['chapter id', 'raw bytes', 'raw digest', 'string digest', 'section routes', 'chapter order']), file FROM f WHERE fault = 9
    UNION ALL SELECT source, unnest(['source bytes', 'source digest', 'content digest']), '' FROM f WHERE fault = 9
) SELECT source, "check", subject FROM bad"""


@register(_VERIFY)
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sources split by turn; in most of them one fault is planted after the manifest was made."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), "text")
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("source"))
    turns = turns.withColumn("fault", F.when(first, F.col("source") % 11).otherwise(0))
    document = lambda title, questions, id_: F.to_json(F.struct(id_.alias("id"), F.array(F.struct(title.alias("title"), questions.alias("qas"))).alias("sections")))
    title, name = F.concat(F.lit("Turn "), F.left("text", F.lit(20))), F.concat(F.lit("c"), F.col("pos").cast("string"))
    raw = document(title, F.array("text"), name)
    changed = F.when(F.col("fault") == 1, document(F.concat(title, F.lit("x")), F.array("text"), name)).when(F.col("fault") == 5, document(title, F.array("text", F.lit("more")), name))
    changed = changed.when(F.col("fault") == 7, F.concat(F.lit(" "), raw)).when(F.col("fault") == 9, document(title, F.array("text"), F.concat(name, F.lit("x")))).otherwise(raw)
    ended = F.when(F.col("fault") == 2, "").when(F.col("pos") % 2 == 0, "\n").otherwise("\r\n")
    file = F.concat(F.lit("f"), F.col("pos").cast("string"), F.lit(".json"))
    files = lambda text, end: turns.select("source", "pos", "fault", file.alias("file"), F.concat(text, end).alias("raw"))
    clean = files(raw, F.lit("\n"))
    facts = integrity.chapter_facts(clean.select("source", "file", "raw"))
    placed = clean.select("source", "file", "pos", F.when(F.col("pos") % 3 == 0, ",\n").otherwise(", ").alias("separator"))
    chapters = placed.join(facts.select("source", "file", *integrity.FACTS), ["source", "file"])
    sources = integrity.source_facts(facts, placed).withColumn("version", F.when(F.col("source") % 11 == 6, 2).otherwise(1))
    now = files(changed, ended).where("fault != 3").select("source", "file", "raw")
    extra = turns.where("fault = 4").select("source", F.lit("other.json"), F.lit('{"id": "other"}\n'))
    order = turns.select("source", "pos", F.when(F.col("fault") == 8, "another").otherwise(name).alias("id"))
    return integrity.verification(chapters, sources, order, now.union(extra)).where("not ok").select("source", "check", "subject")


@register(r"""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) END AS k FROM events""")
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON read back; what can't be read is an empty list."""
    from vellum.sources.documents import stored_list

    blob = F.when(F.col("event_id") % 4 == 0, F.lit("[broken")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(stored_list(blob, "struct<k: int>"), F.lit(0))["k"].alias("k"))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@register(f"""WITH u AS (SELECT page_id, '/' || CASE page_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'trees' WHEN 2 THEN 'quiz' WHEN 3 THEN 'code/src' || page_id % 30 ELSE '' END AS path, CASE page_id % 3 WHEN 0 THEN '#src' || page_id % 40 WHEN 1 THEN '' ELSE '#quiz:1' END AS fragment FROM pages), c AS (SELECT DISTINCT source AS id FROM documents),
r AS (SELECT *, regexp_replace(fragment, '^#', '') AS h, regexp_replace(path, '^/code/', '') AS b FROM u)
SELECT page_id, path, fragment, CASE WHEN path LIKE '/code%' AND (path = '/code' OR b IN (SELECT id FROM c)) THEN 'code' WHEN path = '/trees' THEN 'trees' WHEN path = '/quiz' THEN 'quiz' WHEN h LIKE 'quiz%' THEN 'quiz' WHEN h IN (SELECT id FROM c) THEN 'code' END AS active_section,
    CASE WHEN path = '/code' THEN CASE WHEN h IN (SELECT id FROM c) THEN h ELSE 'home' END WHEN path LIKE '/code/%' AND b IN (SELECT id FROM c) THEN b WHEN path = '/trees' THEN 'trees-home' WHEN path = '/quiz' THEN 'quiz' WHEN h LIKE 'quiz%' THEN 'quiz' WHEN h IN (SELECT id FROM c) THEN h ELSE 'home' END AS active_id,
    CAST(NULL AS VARCHAR) AS anchor,
    CASE WHEN path = '/code' THEN CASE WHEN h IN (SELECT id FROM c) THEN '/code/' || h ELSE '/code' END WHEN path LIKE '/code/%' AND b IN (SELECT id FROM c) THEN '/code/' || b WHEN path = '/trees' THEN '/trees' WHEN path = '/quiz' THEN CASE WHEN h LIKE 'quiz%' THEN '/quiz' || fragment ELSE '/quiz' END
        WHEN h LIKE 'quiz%' THEN '/quiz' || fragment WHEN h IN (SELECT id FROM c) THEN '/code/' || h ELSE '/' END AS canonical_url FROM r""")
def parse_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    path = F.when(p % 5 == 0, "code").when(p % 5 == 1, "trees").when(p % 5 == 2, "quiz").when(p % 5 == 3, F.concat(F.lit("code/src"), (p % 30).cast("string"))).otherwise("")
    fragment = F.when(p % 3 == 0, F.concat(F.lit("#src"), (p % 40).cast("string"))).when(p % 3 == 1, "").otherwise("#quiz:1")
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), path).alias("path"), fragment.alias("fragment"))
    chapters = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    sections = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("section_id"), F.col("source").alias("chapter_id"))
    trees = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))
    return routes.parse_routes(urls, chapters, sections, trees)


@register(f"SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS segments FROM pages")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", routes.segments(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("segments"))


@register("""WITH r AS (SELECT l_orderkey AS page, l_linenumber AS pos, l_returnflag || l_linestatus AS text, l_quantity AS x, 700 - 4.0 * (l_partkey % 4) AS y, l_suppkey % 3 = 0 AS e FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1), w AS (
    SELECT *, lag(x) OVER o AS lx, lag(y) OVER o AS ly, lag(e) OVER o AS le FROM r WINDOW o AS (PARTITION BY page ORDER BY pos)
) SELECT page, string_agg(CASE WHEN coalesce((abs(y - ly) > 5 OR (x + 8 < lx AND NOT abs(y - ly) > 5)) AND NOT le, FALSE) THEN chr(10) ELSE '' END || text || CASE WHEN e THEN chr(10) ELSE ' ' END, '' ORDER BY pos) AS raw FROM w GROUP BY page""")
def line_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs made of order lines."""
    items = table(spark, sf_dir, "lineitem")
    run = F.struct("l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("x"), (700 - 4.0 * (F.col("l_partkey") % 4)).alias("y"), (F.col("l_suppkey") % 3 == 0).alias("has_eol"))
    one = items.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos")).agg(F.min(run).alias("r")).select("page", "pos", "r.text", "r.x", "r.y", "r.has_eol")
    return runs.page_texts(one, "page").select("page", "raw")


_EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), roots AS (SELECT 'r' || r_regionkey AS node FROM region)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mark = lambda sign, column: F.concat(F.lit(sign), F.col(column).cast("string"))
    nations = table(spark, sf_dir, "nation").select(mark("r", "n_regionkey").alias("src"), mark("n", "n_nationkey").alias("dst"))
    customers = table(spark, sf_dir, "customer").select(mark("n", "c_nationkey").alias("src"), mark("c", "c_custkey").alias("dst"))
    return nations.union(customers), table(spark, sf_dir, "region").select(mark("r", "r_regionkey").alias("node"))


@register(f"WITH RECURSIVE {_EDGES}, t AS (SELECT node, 0 AS depth FROM roots UNION ALL SELECT e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node) SELECT node, min(depth)::INTEGER AS depth FROM t GROUP BY node")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(*_edges(spark, sf_dir))


@register(f"WITH RECURSIVE {_EDGES}, t AS (SELECT node, node AS path FROM roots UNION ALL SELECT e.dst, t.path || '>' || e.dst FROM t JOIN e ON e.src = t.node) SELECT node, path, FALSE AS cyclic FROM t")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(*_edges(spark, sf_dir)).select("node", F.array_join("path", ">").alias("path"), "cyclic")


_LEAVES = f"""WITH {_EDGES}, c AS (SELECT src, dst FROM e WHERE src LIKE 'n%'), n AS (SELECT e.dst AS node, greatest(1, count(c.dst)) AS leaves FROM e LEFT JOIN c ON c.src = e.dst WHERE e.src LIKE 'r%' GROUP BY 1), l AS (
    SELECT dst AS node, 1 AS leaves FROM c UNION ALL SELECT * FROM n UNION ALL SELECT node, coalesce((SELECT sum(leaves) FROM n JOIN e ON e.dst = n.node WHERE e.src = roots.node), 1) FROM roots)"""


@register(f"{_LEAVES} SELECT node, leaves::BIGINT AS leaves FROM l")
def leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leaf_counts(*_edges(spark, sf_dir))


@register(f"""{_LEAVES}, s AS (SELECT node, leaves * 1.0::DOUBLE + (leaves - 1) * 0.5::DOUBLE AS span FROM l), r AS (
    SELECT node, 0 AS depth, span, sum(span + 0.5) OVER (ORDER BY node) - (span + 0.5) AS lft FROM s JOIN roots USING (node)
), m AS (SELECT s.node, 1 AS depth, s.span, r.lft + sum(s.span + 0.5) OVER (PARTITION BY e.src ORDER BY s.node) - (s.span + 0.5) AS lft FROM r JOIN e ON e.src = r.node JOIN s ON s.node = e.dst), k AS (
    SELECT s.node, 2 AS depth, s.span, m.lft + sum(s.span + 0.5) OVER (PARTITION BY e.src ORDER BY s.node) - (s.span + 0.5) AS lft FROM m JOIN e ON e.src = m.node JOIN s ON s.node = e.dst
) SELECT node, depth::INTEGER AS depth, span, lft + span / 2 AS x FROM (SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM k)""")
def tree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every node of the regions, nations and customers, all leaves of one width."""
    return graph.layout(*_edges(spark, sf_dir))


_HIGH = lambda text, signs, line: f"greatest(ceil(length({text}) / {signs}.0::DOUBLE), 1) * {line}"
_BOXES = f"""WITH c AS (
    SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS node, c_custkey AS place, c_acctbal >= 0 AS drawn, CASE WHEN c_acctbal >= 0 THEN 240.0::DOUBLE ELSE 0 END AS tw,
        CASE WHEN c_acctbal >= 0 THEN greatest(16 + {_HIGH("repeat(c_mktsegment || ' ', (c_custkey % 12)::INTEGER)", 36, 14)} + 28, 50)::DOUBLE ELSE 0 END AS h, greatest({_HIGH("repeat(c_mktsegment || ' ', (c_custkey % 5)::INTEGER)", 23, 14)} + 10, 24)::DOUBLE AS lh FROM customer
), cs AS (SELECT src, sum(tw) + (count(*) - 1) * 36 AS row_w, max(h) AS row_h, max(lh) AS most FROM c GROUP BY src), n AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS node, n_nationkey AS place, greatest({_HIGH("repeat(n_name || ' ', n_nationkey)", 39, 15)} + 28, 50)::DOUBLE AS h, greatest({_HIGH('n_name', 23, 14)} + 10, 24)::DOUBLE AS lh FROM nation
), nn AS (SELECT n.*, row_w, greatest(280, coalesce(row_w, 0)) AS tw, h + 36 + most AS row_y, coalesce(h + 36 + most + row_h, h) AS th FROM n LEFT JOIN cs ON cs.src = n.node), ns AS (
    SELECT src, sum(tw) + (count(*) - 1) * 36 AS row_w, max(th) AS row_h, max(lh) AS most FROM nn GROUP BY src
), r AS (SELECT 'r' || r_regionkey AS node, greatest({_HIGH("repeat(r_name || ' ', 1 + r_regionkey * 3)", 39, 15)} + 28, 50)::DOUBLE AS h FROM region), rr AS (
    SELECT r.node, h, row_w, greatest(280, coalesce(row_w, 0)) AS tw, h + 36 + most AS row_y FROM r LEFT JOIN ns ON ns.src = r.node
), np AS (
    SELECT rr.node AS root, nn.place::VARCHAR AS way, nn.*, rr.row_y AS top, rr.h + 28 AS label_y, (rr.tw - rr.row_w) / 2 + sum(nn.tw + 36) OVER (PARTITION BY nn.src ORDER BY nn.place) - (nn.tw + 36) AS lft FROM nn JOIN rr ON rr.node = nn.src
), cp AS (
    SELECT np.root, np.way || '.' || c.place AS way, c.*, np.top + np.row_y AS top, np.top + np.h + 28 AS label_y, np.lft + (np.tw - np.row_w) / 2 + sum(c.tw + 36) OVER (PARTITION BY c.src ORDER BY c.place) - (c.tw + 36) AS lft FROM c JOIN np ON np.node = c.src
), boxes AS (
    SELECT node AS root, '' AS way, node, NULL::INTEGER AS place, 0 AS depth, (tw - 280) / 2 AS x, 0.0 AS y, 280.0 AS w, h FROM rr
    UNION ALL SELECT root, way, node, NULL, 1, lft + (tw - 280) / 2, top, 280.0, h FROM np UNION ALL SELECT root, way, node, NULL, 2, lft, top, 240.0, h FROM cp WHERE drawn
    UNION ALL SELECT root, way, node, place, 0, lft + tw / 2 - 75, label_y, 150.0, lh FROM np UNION ALL SELECT root, way, node, place, 1, lft + tw / 2 - 75, label_y, 150.0, lh FROM cp)
SELECT root, way AS "at", node, place::INTEGER AS place, depth::INTEGER AS depth, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, FALSE AS cyclic FROM boxes"""


@register(_BOXES)
def tree_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and labels of the regions' trees; customers in debt have no node."""
    mark = lambda sign, column: F.concat(F.lit(sign), F.col(column).cast("string"))
    regions, nations, customers = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    nodes = regions.select(mark("r", "r_regionkey").alias("node"), F.lit("question").alias("kind"), F.expr("repeat(concat(r_name, ' '), 1 + r_regionkey * 3)").alias("text"))
    nodes = nodes.union(nations.select(mark("n", "n_nationkey"), F.lit("question"), F.expr("repeat(concat(n_name, ' '), n_nationkey)")))
    nodes = nodes.union(customers.where("c_acctbal >= 0").select(mark("c", "c_custkey"), F.lit("result"), F.expr("repeat(concat(c_mktsegment, ' '), cast(c_custkey % 12 as int))")))
    edges = nations.select(mark("r", "n_regionkey").alias("src"), F.col("n_nationkey").cast("int").alias("place"), mark("n", "n_nationkey").alias("dst"), F.col("n_name").alias("label"))
    edges = edges.union(customers.select(mark("n", "c_nationkey"), F.col("c_custkey").cast("int"), mark("c", "c_custkey"), F.expr("repeat(concat(c_mktsegment, ' '), cast(c_custkey % 5 as int))")))
    return graph.sized_layout(nodes, edges, regions.select(mark("r", "r_regionkey").alias("node")))


@register(f"WITH {_EDGES} SELECT dst AS node FROM e WHERE dst LIKE 'c%' AND src NOT IN (SELECT dst FROM e JOIN roots ON e.src = node WHERE node <> 'r0')")
def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that can't be reached once the first region is closed."""
    edges, roots = _edges(spark, sf_dir)
    nodes = edges.where("dst like 'c%'").select(F.col("dst").alias("node"))
    return graph.unreachable(nodes, edges, roots.where("node != 'r0'"))


@register("""WITH l AS (SELECT user_id, event_id, ts, event_type, props FROM events), f AS (SELECT user_id, list(props ORDER BY ts, event_id) FILTER (event_type IN ('click', 'view')) AS p FROM l GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS walk_id, len(coalesce(p, []))::INTEGER AS n, p[len(p)] AS last FROM f""")
def tree_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of each user in order: clicks and views choose, the others do nothing."""
    action = F.when(F.col("event_type").isin("click", "view"), "choose").otherwise("look")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("walk_id"), F.struct("ts", "event_id").alias("step"), action.alias("action"), F.col("props").alias("node"))
    return graph.walk(log).select("walk_id", F.size("path").alias("n"), F.get("path", F.size("path") - 1).alias("last"))


@register("SELECT coalesce(p_type, 'default') AS category, p_partkey // 4096 AS part, count(*) AS n, min(p_partkey) AS first_key, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1, 2")
def group_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of each category in parts of bounded size: the keys of one stretch of 4,096 each."""
    members = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    rows = table(spark, sf_dir, "part").groupBy(F.coalesce("p_type", F.lit("default")).alias("category"), F.expr("p_partkey div 4096").alias("part"))
    return rows.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), F.array_join(members, ",").alias("members"))


@register("SELECT p_brand AS brand, row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part GROUP BY p_brand")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first row: one row for each value is all that is ordered."""
    from pyspark.sql import Window

    firsts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("first"))
    return firsts.select("brand", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


@register("SELECT s.s_suppkey AS tree, n.n_name AS chapter, CASE WHEN s.s_suppkey % 3 = 0 THEN r.r_name END AS section FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey OR n.n_nationkey = (s.s_nationkey + 1) % 25 JOIN region r ON r.r_regionkey = n.n_regionkey")
def related_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with lists of related chapters, one row for each relation; every third names a section too."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array_distinct(F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25))).alias("n_nationkey"))
    joined = suppliers.join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("tree"), F.col("n_name").alias("chapter"), F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).alias("section"))
