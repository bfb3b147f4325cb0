"""Known answers of the functions and operators."""

import json
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions import times as tm
from vellum.operators import activity, agenda, audit, glossary, graph, integrity, quiz, routes, runs, search, validate
from vellum.plans import agendas
from vellum.sources import documents
from vellum.streaming import activity as streams


def of(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def test_durations(spark):
    rows = [("23:30", "00:15"), ("", ""), ("00:00", "00:00"), ("10:00", ""), ("09:00", "09:30"), (None, None), ("x", "01:00")]
    assert [r[0] for r in of(spark, rows, "s string, e string", tm.duration(F.col("s"), F.col("e")))] == [45, 0, 0, 840, 30, 0, 60]


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ("11:30 Talk A\n1:00 Talk B", [("11:30", "13:00", 90), ("13:00", "", 0)]),
        ("10:00 Talk A\n1:30 Talk B", [("10:00", "", 0), ("01:30", "", 0)]),
        ("1:00 - 2:30 pm Talk", [("13:00", "14:30", 90)]),
        ("9:00 - 12:30 pm Talk", [("21:00", "12:30", 930)]),
        ("11:00 - 1:00 pm Talk", [("23:00", "13:00", 840)]),
        ("9:00 am - 1:00 Talk", [("09:00", "13:00", 240)]),
        ("12:00 am Talk A\n12:30 pm Talk B", [("00:00", "12:30", 750), ("12:30", "", 0)]),
        ("09:00 Talk A\nDay 2\n10:00 Talk B", [("09:00", "", 0), ("10:00", "", 0)]),
        ("9am Talk", []),
    ],
)
def test_agenda_times(spark, lines, expected):
    docs = spark.createDataFrame([("d", lines)], "doc_id string, text string")
    got = agenda.parse(docs).orderBy("pos").collect()
    assert [(r["start_time"], r["end_time"], r["duration_minutes"]) for r in got] == expected


def test_titles_and_types(spark):
    text = "PROGRAMME FOR THE LAB\n09:00 - 09:30 WELCOME TO THE EUS-FNA\n• SECOND LINE\n09:30 - 11:00 Cadaver work-\nshop\nwith more"
    got = agenda.parse(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("pos").collect()
    assert [r["type"] for r in got] == ["Other", "Hands-on"]
    assert got[0]["title"].endswith("Welcome to the EUS-FNA\nSecond Line")
    assert got[1]["title"].endswith("Cadaver workshop with more")


def test_classification(spark):
    rows = [("Case discussion",), ("Case discussions",), ("Team exercise",), ("Tea",), ("Hands-on training",), ("Live surgery",), (None,)]
    assert [r[0] for r in of(spark, rows, "t string", agenda.classify(F.col("t")))] == ["Other", "Case Study", "General Educational", "Other", "Hands-on", "Streaming", "General Educational"]
    assert of(spark, [("Lecture",)], "t string", agenda.classify(F.col("t"), F.lit("PRACTICAL SESSIONS")))[0][0] == "Case Study"


def test_eligibility_boundaries(spark):
    sessions = [(1, "Hands-on", 60), (1, "Case Study", 40), (1, "General Educational", 80), (2, "Hands-on", 60), (2, "Case Study", 30), (2, "General Educational", 90), (3, "Other", None)]
    got = {r["k"]: (r["total"], r["passes_agenda"]) for r in agenda.eligibility(spark.createDataFrame(sessions, "k int, type string, duration_minutes int"), "k").collect()}
    assert got == {1: (180, True), 2: (180, False), 3: (0, False)}


def test_final_classes(spark):
    rows = [(True, "Yes", "No", "Yes"), (True, "No", "Yes", "No"), (True, "Yes", "Yes", "Yes"), (True, "Yes", None, "Yes"), (False, "Yes", "No", "Yes")]
    assert [r[0] for r in of(spark, rows, "p boolean, a string, b string, c string", agenda.final_class(*(F.col(c) for c in "pabc")))] == ["TPPT", "TPOEE", "MIXED", None, "TPOEE"]


def test_capitals(spark):
    rows = [("EUS-FNA TRAINING",), ("INTRODUCTION TO THE LAB",), ("Lunch: BREAK",), ("A::B",), ("Mixed Case stays",), (None,)]
    assert [r[0] for r in of(spark, rows, "t string", tx.capitalize("t"))] == ["EUS-FNA Training", "Introduction to the Lab", "Lunch:Break", "A:B", "Mixed Case stays", ""]


def test_slugs_counts_and_marks(spark):
    rows = [("ch1", "***", 0), ("ch1", "", 2), ("ch1", "Gifts & Co.", 0), ("", "x", 1)]
    assert [r[0] for r in of(spark, rows, "c string, t string, n int", tx.section_slug(F.col("c"), F.col("t"), F.col("n")))] == ["ch1-", "ch1-section-2", "ch1-gifts-co", ""]
    assert of(spark, [("aaaa", "<strong>x</strong>")], "a string, b string", tx.occurrences(F.col("a"), "aa"), tx.occurrences(F.col("b"), "strong"), tx.occurrences(F.col("a"), "  "))[0] == (2, 2, 0)
    assert of(spark, [("a <b>a</b>",)], "h string", tx.highlight(F.col("h"), " A "))[0][0] == "<mark>a</mark> <b><mark>a</mark></b>"
    assert of(spark, [("Hello.\n09:00 Talk",)], "t string", tx.normalize_source(F.col("t")))[0][0] == "Hello.09:00 Talk"


def test_html(spark):
    page = "<style>x</style><p>A&amp;B</p><script>var a='<p>';</script><p onclick=\"x()\">C<br>D</p>"
    shown, plain, safe = of(spark, [(page,)], "h string", tx.visible_text(F.col("h")), tx.strip_html(F.col("h")), tx.sanitize_html(F.col("h")))[0]
    assert shown.split() == ["A&B", "C", "D"] and "C\nD" in plain and "onclick" not in safe and "<script" not in safe


def test_glossary(spark):
    terms = spark.createDataFrame([(1, "Grants", "one"), (2, "Grant", "two"), (3, "Event:", "one"), (4, "Event", "two"), (5, "x", "short")], "pos int, term string, definition string")
    got = {r["key"]: r["definition"] for r in glossary.glossary_map(terms).collect()}
    assert got == {"grants": "one", "grant": "two", "event": "two", "events": "one"}
    docs = spark.createDataFrame([(1, "Grant, grants and a grant.")], "doc_id int, text string")
    assert {(r["key"], r["hits"]) for r in glossary.term_hits(docs, glossary.glossary_map(terms)).collect()} == {("grant", 2), ("grants", 1)}
    drift = [("a" * 69, "b" * 100), ("a" * 70, "b" * 100), ("a" * 94, "b" * 100), ("a" * 95, "b" * 100), ("x", ""), ("same", "same")]
    side = lambda i: spark.createDataFrame([(n, r[i]) for n, r in enumerate(drift)], "key int, definition string")
    assert [r["status"] for r in glossary.compare(side(0), side(1)).orderBy("key").collect()] == ["PARAPHRASED", "TRUNCATED", "TRUNCATED", "MINOR DIFF", "PARAPHRASED", "equal"]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("c", "e"), ("z", "z")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.depths(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)}
    assert {tuple(r) for r in graph.leaf_counts(edges, roots).collect()} == {("a", 3), ("b", 1), ("c", 2), ("d", 1), ("e", 1)}
    assert {(r["node"], r["x"]) for r in graph.layout(edges, roots).collect()} == {("a", 2.0), ("b", 0.5), ("c", 2.75), ("d", 2.0), ("e", 3.5)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {tuple(r) for r in graph.depths(loop, roots).collect()} == {("a", 0), ("b", 1)}
    assert {(r["node"], r["cyclic"]) for r in graph.paths(loop, roots).collect()} == {("a", False), ("b", False), ("a", True)}
    log = spark.createDataFrame([("w", i, a, n) for i, (a, n) in enumerate([("choose", "s"), ("choose", "q"), ("back", None), ("choose", "r"), ("choose", "t"), ("reset", None)])], "walk_id string, step int, action string, node string")
    assert [graph.walk(log.where(f"step <= {i}")).first()["path"] for i in (2, 4, 5)] == [["s"], ["s", "r", "t"], ["s"]]


def chapter(**changes):
    return {"id": "c1", "part": "part1", "title": "T", "icon": "1", "summary": "", "sections": [{"title": "One", "legalText": "Text", "qas": [{"q": "Q?", "a": "A"}]}]} | changes


def tree(**changes):
    nodes = [{"id": "start", "type": "question", "text": "?", "options": [{"label": "go", "next": "end"}]}, {"id": "end", "type": "result", "text": "!", "outcome": "compliant"}]
    return {"id": "dt-1", "title": "T", "relatedChapter": "c1", "relatedSection": ["c1-one"], "nodes": nodes} | changes


def question(**changes):
    return {"id": "q1", "chapterId": "c1", "question": "?", "options": [{"id": "a", "text": "A", "isCorrect": True}, {"id": "b", "text": "B", "isCorrect": False}]} | changes


def errors(spark, folder, chapters, trees, questions):
    for name, value in (("chapters", chapters), ("trees", {"trees": trees}), ("questions", questions)):
        (folder / f"{name}.json").write_text(json.dumps(value))
    c, t, q = documents.read_chapters(spark, str(folder / "chapters.json")), documents.read_trees(spark, str(folder / "trees.json")), documents.read_questions(spark, str(folder / "questions.json"))
    icons = spark.createDataFrame([("Book",)], "name string")
    found = validate.report(validate.chapter_rules(c, icons), validate.tree_rules(t, c), validate.question_rules(q, c))
    return {r["rule"] for r in found.collect()}, tuple(validate.stats(c, t, q).first())


def test_validation_of_nested_content(spark, tmp_path):
    assert errors(spark, tmp_path, [chapter()], [tree()], [question()]) == (set(), (1, 1, 1, 1, 2, 1))
    broken = tree()
    broken["nodes"][0]["options"][0]["next"] = "nowhere"
    assert errors(spark, tmp_path, [chapter(icon="Moon")], [broken], [question()])[0] == {"icon refers to name", "target refers to path"}
    two = question(options=[{"id": "a", "text": "A", "isCorrect": True}, {"id": "a", "text": "B", "isCorrect": True}])
    assert errors(spark, tmp_path, [chapter(part="part9")], [tree(relatedChapter=["c9"], nodes=[])], [two, question(chapterId="c7", options=[])])[0] == {"domain of part", "nodes", "unique id", "unique question_id, id", "exactly 1", "two options", "chapterId refers to chapter_id"}


def test_routes(spark):
    chapters = spark.createDataFrame([("gifts",), ("a b",)], "id string")
    sections = spark.createDataFrame([("gifts-one", "gifts")], "section_id string, chapter_id string")
    trees = spark.createDataFrame([("dt-1",)], "id string")
    urls = [
        ("/", "", None, "home", None, "/"), ("/code", "", "code", "home", None, "/code"), ("/code/gifts/", "", "code", "gifts", None, "/code/gifts"), ("/code/a%20b", "", "code", "a b", None, "/code/a%20b"),
        ("/code/gifts", "#gifts-one", "code", "gifts", "gifts-one", "/code/gifts#gifts-one"), ("/", "#gifts", "code", "gifts", None, "/code/gifts"), ("/", "#gifts-one", "code", "gifts", "gifts-one", "/code/gifts#gifts-one"),
        ("/trees/dt-1", "", "trees", "dt-1", None, "/trees/dt-1"), ("/", "#dt-1", "trees", "dt-1", None, "/trees/dt-1"), ("/trees", "", "trees", "trees-home", None, "/trees"), ("/quiz", "#quiz:q1", "quiz", "quiz", None, "/quiz#quiz:q1"),
        ("/quiz", "#quiz", "quiz", "quiz", None, "/quiz"), ("/tppt", "", "tppt", "tppt-home", None, "/tppt"), ("/nowhere", "", None, "home", None, "/"), ("/%E0%A4%A", "", None, "home", None, "/"), ("/code/none", "#x", None, "home", None, "/"),
    ]
    table = spark.createDataFrame([u[:2] for u in urls], "path string, fragment string")
    got = {(r["path"], r["fragment"]): tuple(r)[2:] for r in routes.parse_routes(table, chapters, sections, trees).collect()}
    assert got == {u[:2]: u[2:] for u in urls}


def test_histories(spark):
    visits = spark.createDataFrame([(1, x, i) for i, x in enumerate("ABACDEF")] + [(1, "home", 99)], "u int, x string, ts int")
    assert "".join(r["x"] for r in activity.recent(visits, "u", "x", "ts").orderBy("place").collect()) == "FEDCA"
    terms = spark.createDataFrame([(1, x, i) for i, x in enumerate(("Gift", "x", "GIFT", "tea", "fee", "hcp"))], "u int, x string, ts int")
    assert [r["x"] for r in activity.recent_searches(terms, "u", "x", "ts").orderBy("place").collect()] == ["hcp", "fee", "tea", "GIFT"]
    marks = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "u int, x string, ts int")
    assert [r["x"] for r in activity.toggled(marks, "ts", "u", "x").collect()] == ["b"]


def test_grades(spark):
    rows = [(179, 200), (7, 10), (1, 2), (49, 100), (0, 0)]
    assert [r[0] for r in of(spark, rows, "c int, n int", quiz.grade(tm.round_percent(F.col("c"), F.col("n"))))] == ["Excellent", "Great", "Good", "Keep Learning", None]


def test_runs_to_lines(spark):
    table = spark.createDataFrame([(1, i, t, x, y, e) for i, (t, x, y, e) in enumerate([("a", 10.0, 700.0, False), ("b", 50.0, 700.0, False), ("c", 10.0, 690.0, True), ("d", 10.0, 680.0, False), ("e", 1.0, 680.0, False)])], "page int, pos int, text string, x double, y double, has_eol boolean")
    assert runs.page_texts(table, "page").first()["raw"] == "a b \nc\nd \ne "


def test_json_slices_and_strings(spark):
    raw = '{ "n": 1, "items" : [ {"a":"}] \\" ["} ,\n {"b": [1, 2]} ], "z": "s" }'
    table = spark.createDataFrame([(1, raw), (2, "{broken"), (3, None)], "key long, raw string")
    every = integrity.array_slices(table, "items")
    assert {(r["key"], r["problem"], r["problem_at"]) for r in every.where("problem is not null").collect()} == {(2, "name expected", 1), (3, "object expected", 0)}
    got = every.where("problem is null").orderBy("pos").collect()
    assert [r["element"] for r in got] == ['{"a":"}] \\" ["}', '{"b": [1, 2]}'] and all(raw[r["begin"] : r["end"]] == r["element"] for r in got)
    assert [(r["path"], r["value"]) for r in integrity.json_strings(table).orderBy("n").collect()] == [("/items/0/a", '}] " ['), ("/z", "s")]
    ids = spark.createDataFrame([("ok-1",), ("../x",), ("d",), ("d",)], "id string")
    assert {tuple(r) for r in integrity.split_problems(ids).collect()} == {("../x", "unsafe id"), ("d", "duplicate id")}


def test_bounded_differences(spark):
    source = " ".join(f"word{i}" for i in range(200))
    field = " ".join(f"word{i}" if i != 70 else "other" for i in range(50, 90))
    fields = spark.createDataFrame([("p", "c", "body", field), ("n", "c", "footnote", "zz qq")], "path string, chapter_id string, kind string, text string")
    scopes = spark.createDataFrame([("c", source)], "chapter_id string, scope string")
    compared = audit.compare_fields(fields, scopes)
    assert {r["path"]: r["status"] for r in compared.collect()} == {"p": "substantive_review_required", "n": "footnote_difference"}
    found = {r["path"]: r for r in audit.differences(compared, scopes).collect()}
    row = found["p"]
    assert found["n"]["similarity"] == 0 and found["n"]["operation_count"] == 1
    assert row["operation_count"] == 1 and tuple(row["operations"][0]) == ("replace", "other", "word70")
    assert row["similarity"] == pytest.approx(SequenceMatcher(None, field.split(), source.split()[50:90]).ratio(), abs=1e-6)
    pairs = spark.createDataFrame([(1, source, " ".join(source.split()[:100] + source.split()[130:]))], "key long, expected string, actual string")
    assert audit.missing_chunks(pairs).first()["chunk"].split() == [f"word{i}" for i in range(100, 130)]


def test_the_stretch_that_stands_for_a_field(spark):
    source = [f"w{i}" for i in range(400)]
    fields = [
        ("middle", source[100:150]),
        ("insertion", source[200:230] + source[290:320]),
        ("unanchored", ["x", "y", *source[60:100], *["z"] * 80]),
        ("nowhere", ["q"] * 30),
        ("short", source[5:7]),
    ]
    rows = spark.createDataFrame([(p, "c", a) for p, a in fields], "path string, chapter_id string, a array<string>")
    got = {r["path"]: (r["start"], r["stop"]) for r in audit.locate(rows, spark.createDataFrame([("c", source)], "chapter_id string, b array<string>")).collect()}
    assert got == {"middle": (100, 150), "insertion": (200, 320), "unanchored": (58, 180)}


def test_fields_of_nested_content(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([chapter(sections=[{"title": "S", "legalText": "<p>Body</p><hr>Note", "qas": [{"q": "Q&A 1: Why?", "a": "So"}]}])]))
    got = {(r["kind"], r["text"].strip()) for r in audit.collect_fields(documents.read_chapters(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {("title", "T"), ("section_title", "S"), ("body", "Body"), ("footnote", "Note"), ("question", "Why?"), ("answer", "So")}


def test_readers_and_writers(spark, tmp_path):
    for name in ("c1", "c2"):
        (tmp_path / f"{name}.json").write_text(json.dumps(chapter(id="c1")))
    files = documents.read_chapters(spark, str(tmp_path / "*.json"))
    order = spark.createDataFrame([("c1",), ("c3",)], "id string")
    assert {tuple(r) for r in documents.against_order(files, order).collect()} == {("c2", "unexpected"), ("c3", "missing"), ("c2", "other id")}
    documents.write_each(order.withColumn("v", F.lit(1)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        documents.write_each(order.withColumn("v", F.lit(1)), str(tmp_path / "out"))
    source = "const icons = {\n  Book,\n  'Star': StarIcon,\n};"
    assert of(spark, [(source,)], "s string", documents.registered_names(F.col("s"), "icons"))[0][0] == ["Book", "Star"]
    assert search.filter_titles(order, "C3", "id").count() == 1


def test_streamed_debounce(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}.{ms:03d}", f"{s}.{ms}") for s, ms in ((0, 0), (0, 100), (0, 350), (2, 0), (40, 0))]
    spark.createDataFrame(rows, "u int, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, v string").parquet(str(tmp_path / "in"))
    query = streams.debounce_stream(stream, "u", "ts", "v").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r["v"] for r in spark.table("bursts").collect()} == {"0.350", "2.0"}


def test_word_files(spark, tmp_path):
    w, mc = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/markup-compatibility/2006"
    box = "<mc:AlternateContent><mc:Choice><w:t>twice</w:t></mc:Choice><mc:Fallback><w:t>once</w:t></mc:Fallback></mc:AlternateContent>"
    body = f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>09:00</w:t><w:tab/><w:t>Ünit &amp; </w:t></w:r><w:r>{box}</w:r></w:p><w:p/><w:p><w:r><w:t>10:00 Break</w:t><w:delText>gone</w:delText></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:mc="{mc}"><w:body>{body}</w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("word/else.xml", "<x/>")
    (tmp_path / "old.DOC").write_bytes(b"not zipped")
    (tmp_path / "a.txt").write_text("10:00 Talk")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in documents.read_word_files(spark, str(tmp_path)).collect()}
    assert got.pop("a.docx") == ("09:00\tÜnit & once\n\n\n\n10:00 Break\n\n", None)
    assert got == {"other.docx": (None, "unreadable"), "old.DOC": (None, "unreadable"), "a.txt": (None, "unsupported")}


def test_token_diff_reads_whole_documents(spark, tmp_path):
    """The text of document 2 that its sixth field is cut from lies behind more than 20,000 others."""
    from vellum.plans import texts

    text = " ".join(f"word{i}" for i in range(4000))
    start = 5 * 4000 + 7 * 7919 % (4000 - 79)
    assert len(text) > 6 * 4000 and start > 20_000
    spark.createDataFrame([(2, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = texts.token_diff(spark, str(tmp_path)).where("path = '2/5'").first()
    whole = text[start : start + 80].split()[1:-1]
    assert all(w in row["expected_excerpt"].split() and w in row["actual_excerpt"].split() for w in whole)
    assert row["similarity"] > 0.7


def test_table_digest_in_levels(spark):
    import hashlib

    from vellum.operators import integrity

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest().upper()
    rows = [(i * 37 % 500, f"text {i}" if i % 9 else None, ("a", "b", None)[i % 3]) for i in range(500)]
    got = integrity.table_digest(spark.createDataFrame(rows, "k long, t string, g string"), "k", "t", "g")
    # all keys lie in one stretch of each level
    expected = {g: sha(sha(sha("".join(sha(f"{k}\0{t or ''}") for k, t, _ in sorted((r for r in rows if r[2] == g), key=lambda r: r[0]))))) for g in ("a", "b", None)}
    assert {r["g"]: r["digest"] for r in got.collect()} == expected
    assert sum(r["n"] for r in got.collect()) == 500


def test_deeply_nested_json(spark):
    """Brackets of any depth are sliced; the decoder behind json_strings can't follow them and leaves the document out."""
    deep = '{"items": [' + "[" * 200_000 + "]" * 200_000 + "]}"
    table = spark.createDataFrame([(1, deep), (2, '{"items": ["a"]}'), (3, None)], "key long, raw string")
    got = integrity.array_slices(table, "items").collect()
    assert {(r["key"], r["problem"], len(r["element"] or "")) for r in got} == {(1, None, 400_000), (2, None, 3), (3, "object expected", 0)}
    assert {r["key"] for r in integrity.json_strings(table).collect()} == {2}


def test_marks_of_titles(spark):
    rows = [("Dry-lab and wet lab", "Hands-on"), ("Steam and tea", "Other"), ("", "Other"), (None, "Hands-on"), ("Plenary", "General Educational")]
    got = [r[0] for r in of(spark, rows, "t string, k string", agenda.mark_keywords(F.col("t"), F.col("k")))]
    assert got == ["<mark>Dry-lab</mark> and <mark>wet lab</mark>", "S<mark>tea</mark>m and <mark>tea</mark>", "Untitled Session", "Untitled Session", "Plenary"]


def test_titles_compile_no_pattern_for_each_row(spark):
    """Gaps were split by a look-around over all white space, which Spark compiles again for every title."""
    docs = spark.createDataFrame([("a", "PROGRAMME OF THE DAY\n9:00 - 9:30 LIVE SURGERY OF THE EUS/CT\n9h30 Tea| coffee \n10.00 am to 11.00 am end")], "doc_id string, text string")
    parsed = agenda.parse(docs)
    assert "(?<=[\\t" not in parsed._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["title"], r["start_time"], r["end_time"]) for r in parsed.orderBy("pos").collect()]
    assert rows == [("[Programme of the Day]\nLive Surgery of the EUS/CT", "09:00", "09:30"), ("[Programme of the Day]\nTea|coffee", "09:30", "10:00"), ("[Programme of the Day]\nend", "10:00", "11:00")]


def test_only_references_leave_the_jvm(spark):
    rows = [(1, "a &amp b &#x41;&#66; &copyx &none; &&lt;&lt; &notin; x&"), (2, "none"), (3, None), (4, "&amp;" * 3 + "🙂&eacute;🙂")]
    got = spark.createDataFrame(rows, "id int, t string").select("id", tx.decode_references(F.col("t")).alias("d"))
    assert [r["d"] for r in got.orderBy("id").collect()] == ["a & b AB ©x &none; &<< ∉ x&", "none", None, "&&&🙂é🙂"]
    call = got._jdf.queryExecution().optimizedPlan().toString().split("_decoded(")[1]
    assert "regexp_extract_all" in call[:200]


def test_python_holds_few_texts_and_places_at_a_time():
    import pyarrow as pa

    firsts = pa.array([[{"piece": "a", "child": "n", "key": "a", "open": True}]] * 40, pa.list_(pa.struct([("piece", pa.string()), ("child", pa.string()), ("key", pa.string()), ("open", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["a b " * 1000] * 40), firsts], ["doc_id", "text", "firsts"])
    sizes = [b.num_rows for b in glossary._follow(30)(iter([batch]))]
    assert sum(sizes) == 40_000 and max(sizes) <= glossary.PLACES
    spans = pa.array([[{"start": 2, "stop": 3, "key": "b"}], None] * 20, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("key", pa.string())])))
    linked = list(glossary._with_links(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["a b"] * 40), spans], ["doc_id", "text", "spans"])])))
    assert [b.num_rows for b in linked] == [16, 16, 8]
    assert linked[0].column(1).to_pylist()[:2] == ['a <span data-term="b">b</span>', "a b"]


def test_runs_are_counted_in_their_text_and_only_likely_keys_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "Red fox, red fox; red"), (2, None), (3, ""), (1, "the red fox red"), (None, "red fox"), (4, "fox")], "doc_id long, text string")
    keys = spark.createDataFrame([("red",), ("red fox",), ("fox red fox",), ("red",), (None,)], "key string")
    found = glossary.phrase_hits(docs, keys, 3)
    assert {(r.doc_id, r.key): r.hits for r in found.collect()} == {(1, "red"): 5, (1, "red fox"): 3, (1, "fox red fox"): 1, (None, "red"): 1, (None, "red fox"): 1}
    once = docs.where("doc_id > 2")
    for hits in (glossary.phrase_hits(once, keys, 2), glossary.term_hits(once, keys)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan and "getbit" in plan


def test_runs_are_counted_alike_however_texts_are_cut(monkeypatch):
    import pyarrow as pa

    texts = [["a", "b", "a", "b"], None, [], ["b"], ["c", "a", "b"], ["a"]]
    batch = pa.record_batch([pa.array(range(10, 16), pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "words"])
    expected = Counter((10 + n, " ".join(t[i : i + k])) for n, t in enumerate(texts) if t for k in (1, 2, 3) for i in range(len(t) - k + 1))
    for words in (1, 3, 5, 100):
        monkeypatch.setattr(glossary, "WORDS", words)
        for cut in (batch, batch.slice(3), batch.slice(1, 3)):
            rows = [tuple(r.values()) for out in glossary._counted(3)([cut]) for r in out.to_pylist()]
            ids = set(cut.column(0).to_pylist())
            assert sorted(rows) == sorted((i, k, n) for (i, k), n in expected.items() if i in ids)


def test_event_names_are_read_in_their_row(spark):
    rows = [(1, "Venue: hall\n12 May 2024\n- Annual course\non imaging\n9:00 Welcome\nlater"), (1, "A B C D\nOther course"), (None, "Dr X\n10 High Street\nFirst\nof\nfour lines\nthat go on\nand on"), (2, None), (3, "abc\n17:30\nDay 2"), (4, "MASTERSTREETS AND THE LAB")]
    named = agenda.event_name(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.name) for r in named.collect()) == [(0, "First"), (1, "Annual course on imaging"), (1, "Other course"), (2, "My MedTech Event"), (3, "My MedTech Event"), (4, "Masterstreets and the Lab")]
    assert "Exchange" not in named._jdf.queryExecution().executedPlan().toString()


def test_only_grams_of_fields_leave_their_scope(spark):
    words = [f"w{i}" for i in range(3000)]
    fields = spark.createDataFrame([("p", "c", words[100:130]), ("short", "c", ["w1"]), ("else", "d", words[:9])], "path string, chapter_id string, a array<string>")
    scopes = spark.createDataFrame([("c", " ".join(words)), ("d", ""), ("e", "no fields here")], "chapter_id string, scope string")
    found = audit.locate(fields, scopes, tx.tokens(F.col("scope")))
    assert [tuple(r) for r in found.collect()] == [("p", "c", 100, 130)]
    cut = scopes.join(fields.groupBy("chapter_id").agg(F.array_distinct(F.flatten(F.collect_list(audit._grams(F.col("a"))))).alias("own")), "chapter_id")
    own = cut.select("chapter_id", audit._grams(tx.tokens(F.col("scope"))).alias("g"), "own").mapInArrow(audit._wanted, "chapter_id string, b int, gram long")
    assert sorted(r["b"] for r in own.collect()) == list(range(100, 128))


def test_reports_keep_the_names_that_were_read(spark, small):
    found = {r["name"] for r in agendas.batch_report(spark, small).select("name").distinct().collect()}
    assert found >= {None, "No times here", "and questions", "first point second point", "graduate level"}


def test_agendas_are_parsed_once_and_without_windows(spark):
    docs = spark.createDataFrame([(1, "Course\n  9:00  - 9.30  \t Tea \r\n\n\n\nx-\nray\n- point\nDay 2\nlost\n1:00 pm | end"), (2, None), (3, "DAY PROGRAMME\n8:00 - 18:00 Course\n11:30\n1:15\n- only")], "doc_id long, text string")
    parsed = agenda.parse(docs)
    rows = [tuple(r)[1:6] for r in parsed.orderBy("doc_id", "pos").collect()]
    assert rows == [(0, "Tea xray\npoint", "09:00", "09:30", 30), (1, "end", "13:00", "", 0), (0, "[Day Programme]\n", "11:30", "13:15", 105), (1, "[Day Programme]\nonly", "13:15", "", 0)]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    report = agenda.batch_report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert report.count("posexplode") == 1
