"""Glossary links, the containment ladder and patience alignment against plain versions."""

import collections
import random
import re
from bisect import bisect_left
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import audit, glossary
from vellum.plans import texts

PART = re.compile("<[^>]*>|<[^>]*$|[^<]+")


def plain_spans(text, keys):
    """One alternation of all terms, longest first, between boundaries."""
    if text is None or not keys:
        return []
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k))) + r")\b", re.ASCII | re.IGNORECASE)
    return [(m.start(), m.end(), m[0].lower()) for p in PART.finditer(text) if not p[0].startswith("<") for m in pattern.finditer(text[: p.end()], p.start())]


def glossary_texts():
    rng = random.Random(5)
    words = ["next", "page", "Next Page", "c++", "a-b", "a", "b", "the", "of the", "naïve", "é", "x_1", "<b>", "</b>", "<a href='next page'>", " ", "  ", "-", "+", "<", "\n", ".", "page.", "(a)"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", "", " ")) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [None, "", "next page", "nextpage next  page", "a b a b a b a b", *texts, "a b " * 5000, "x" * 100_000]


def test_spans_equal_one_alternation(spark):
    keys = ["next", "next page", "page", "a b", "b a b", "a-b", "c++", "(a)", "of the", "naïve", "é", "x_1", "the next page of the", "A", "", None, "next page"]
    rows = [(i, t, "z") for i, t in enumerate(glossary_texts())]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    known = spark.createDataFrame([(k, "d") for k in keys], "key string, definition string")
    got = collections.defaultdict(list)
    for r in glossary.term_spans(table, known).collect():
        got[r["doc_id"]].append((r["start"], r["stop"], r["key"]))
    wanted = sorted({k.lower() for k in keys if k})
    for i, text, _ in rows:
        assert sorted(got[i]) == plain_spans(text, wanted), (i, text)
    linked = {r["doc_id"]: r["linked"] for r in glossary.link_glossary(table, known).collect()}
    assert linked[0] is None and linked[1] == "" and linked[2] == '<span data-term="next page">next page</span>'
    assert all(re.sub(r'<span data-term="[^"]*">|</span>', "", linked[i]) == t for i, t, _ in rows[1:])
    assert glossary.term_spans(table, known.where("false")).count() == 0
    assert glossary.term_spans(table.where("false"), known).count() == 0


def test_a_list_of_terms_links_alike(spark):
    keys = ["next", "next page", "a b", "b a b", "a-b", "c++", "(a)", "of the"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(glossary_texts()[:80])], "doc_id long, text string")
    by_join = {r[0]: r[1] for r in glossary.link_glossary(table, spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    by_list = {r[0]: r[1] for r in table.select("doc_id", tx.link_terms(F.col("text"), keys).alias("t")).collect()}
    assert by_list == {k: v or "" for k, v in by_join.items()}


def test_glossaries_of_many_terms(spark):
    """More terms than one pattern could hold, with one frequent beginning."""
    keys = [f"term {i} of {i % 7}" for i in range(20_000)] + ["term"]
    texts = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("term "), F.col("id").cast("string"), F.lit(" of "), (F.col("id") % 7).cast("string"), F.lit(" and term 9x")).alias("text"))
    got = glossary.term_spans(texts, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert sorted((r["doc_id"], r["key"]) for r in got) == sorted((i, k) for i in range(50) for k in (f"term {i} of {i % 7}", "term"))


def plain_alignment(a, b):
    """Matched places, by recursion over the gaps."""

    def rise(pairs):
        tops, piles, before = [], [], []
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            before.append(piles[at - 1] if at else None)
            tops[at : at + 1], piles[at : at + 1] = [j], [k]
        out, k = [], piles[-1] if piles else None
        while k is not None:
            out.append(pairs[k])
            k = before[k]
        return out[::-1]

    def solve(i0, i1, j0, j1):
        at_a, at_b = collections.defaultdict(list), collections.defaultdict(list)
        for i in range(i0, i1):
            at_a[a[i]].append(i)
        for j in range(j0, j1):
            at_b[b[j]].append(j)
        once = sorted((at_a[t][0], at_b[t][0]) for t in at_a if len(at_a[t]) == 1 == len(at_b.get(t, ())))
        pairs = once or sorted(p for t in at_a for p in zip(at_a[t], at_b.get(t, ())))
        if not pairs:
            return []
        out, i, j = [], i0, j0
        for x, y in [*rise(pairs), (i1, j1)]:
            out += solve(i, x, j, y)
            if x < i1:
                out.append((x, y))
            i, j = x + 1, y + 1
        return out

    return solve(0, len(a), 0, len(b))


def alignment_pairs():
    rng = random.Random(17)
    pairs = [([], []), (["x"], []), ([], ["y"]), (["a"] * 50, ["a"] * 30), (list("abcabba"), list("cbabac"))]
    for _ in range(120):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcxyz"))
        pairs.append((a, b))
    long = [f"w{i % 997}" for i in range(20_000)]
    return [*pairs, (long, long[:5000] + ["new"] + long[5001:15_000] + long[15_100:])]


def test_alignment_equals_a_plain_recursion(spark):
    pairs = alignment_pairs()
    table = spark.createDataFrame([(str(k), a, b) for k, (a, b) in enumerate(pairs)], "key string, a array<string>, b array<string>").repartition(3)
    got = collections.defaultdict(lambda: ([], []))
    for r in audit.align(table).where("matched").collect():
        got[r["key"]][r["side"] == "b"].append(r["n"])
    for k, (a, b) in enumerate(pairs):
        i, j = (sorted(x) for x in got[str(k)])
        assert list(zip(i, j, strict=True)) == plain_alignment(a, b), k


def test_differences_of_planted_changes(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(3000)]
    scope = " ".join(rng.choice(words) for _ in range(4000))
    tokens = scope.split()
    rows, expected = [], {}
    for k in range(60):
        at = rng.randrange(0, 3900)
        own = tokens[at : at + 60]
        change = k % 3
        if change == 0:
            own = [*own[:30], "brandnew", *own[30:]]
            expected[f"f{k}"] = [("delete", "brandnew", "")]
        elif change == 1:
            expected[f"f{k}"] = [("insert", "", " ".join(own[20:24]))]
            own = own[:20] + own[24:]
        else:
            expected[f"f{k}"] = [("replace", "other", own[40])]
            own = [*own[:40], "other", *own[41:]]
        rows.append((f"f{k}", 1, "body", " ".join(own)))
    compared = audit.compare_fields(spark.createDataFrame(rows, "path string, chapter_id long, kind string, text string"), spark.createDataFrame([(1, scope)], "chapter_id long, scope string"))
    got = {r["path"]: r for r in audit.differences(compared, spark.createDataFrame([(1, scope)], "chapter_id long, scope string")).collect()}
    for path, ops in expected.items():
        assert [tuple(o) for o in got[path]["operations"]] == ops, path
        assert got[path]["operation_count"] == 1 and got[path]["similarity"] > 0.95


def test_differences_on_the_table(spark, small):
    """Every field that isn't exact has its difference; matched tokens are nearly as many as a longest-match search finds."""
    compared, scopes = texts._audited(spark, small)
    left = compared.where(~F.col("status").isin(*audit.STATUSES[:2]))
    assert texts.token_diff(spark, small).count() == left.count() > 50
    pairs = left.join(audit.locate(left.select("path", "chapter_id", tx.tokens(F.col("expected")).alias("a")), scopes.select("chapter_id", tx.tokens(tx.normalize_layout(F.col("scope"))).alias("b"))), ["path", "chapter_id"])
    pairs = pairs.join(scopes, "chapter_id").select(F.col("path").alias("key"), tx.tokens(F.col("expected")).alias("a"), F.slice(tx.tokens(tx.normalize_layout(F.col("scope"))), F.col("start") + 1, F.col("stop") - F.col("start")).alias("b"))
    found = {r["key"]: r["n"] for r in audit.align(pairs).where("side = 'a'").groupBy("key").agg(F.count_if("matched").alias("n")).collect()}
    ours = other = 0
    for r in pairs.collect():
        assert found[r["key"]] == len(plain_alignment(r["a"], r["b"]))
        ours += found[r["key"]]
        other += sum(m.size for m in SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_matching_blocks())
    assert ours >= 0.99 * other, (ours, other)


@pytest.mark.parametrize("block", [10_000, 2])
def test_ladder_equals_containment_tests(spark, block):
    scope = "The Quick-brown fox,\njumps over the lazy dog. Soft hyphen­ated and bro-\nken words; MORE text (here)"
    fields = ["Quick-brown fox", "quick brown FOX", "Quick brown fox jumps", "bro-ken words", "broken words", "words MORE text", "nothing of it", "", "here", "here)", "fox, jumps over"]
    rows = [(f"p{k}", c, ("body", "footnote")[k % 2], t) for k, t in enumerate(fields) for c in (1, 2, 3)]
    table = spark.createDataFrame(rows, "path string, chapter_id long, kind string, text string")
    scopes = spark.createDataFrame([(1, scope), (2, None)], "chapter_id long, scope string")
    got = {(r["path"], r["chapter_id"]): r["status"] for r in audit.compare_fields(table, scopes, block).collect()}
    strict, loose = tx.normalize_layout(F.col("t")), tx.normalize_layout(F.col("t"), True)
    forms = lambda values: spark.createDataFrame([(v,) for v in values], "t string").select(strict, loose, tx.words_only(strict), tx.words_only(strict, True)).collect()
    whole = forms([scope])[0]
    for k, parts in enumerate(forms(fields)):
        hit = next((s for s, w, p in zip(audit.STATUSES, whole, parts, strict=False) if p and p in w), audit.STATUSES[4 + (k % 2 == 0)])
        assert got[f"p{k}", 1] == hit, fields[k]
        assert got[f"p{k}", 2] == got[f"p{k}", 3] == audit.STATUSES[4 + (k % 2 == 0)]


def test_chunks_that_are_missing(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" for i in range(100) if not 30 <= i < 60 and not 80 <= i < 90)
    rows = [(1, a, b), (2, a, a), (3, "", b), (4, b, a), (5, a, "")]
    got = {(r["key"], r["chunk"]) for r in audit.missing_chunks(spark.createDataFrame(rows, "key long, expected string, actual string")).collect()}
    assert got == {(1, " ".join(f"w{i}" for i in range(30, 60))), (5, a)}


def plain_visible(text):
    """What a parser of HTML hands out as data."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.depth = [], 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag in tx.HIDDEN_TAGS
            if not self.depth and tag in tx.BLOCK_TAGS:
                self.parts.append("\n")

        def handle_startendtag(self, tag, attrs):
            if not self.depth and tag in tx.BLOCK_TAGS:
                self.parts.append("\n")

        def handle_endtag(self, tag):
            if tag in tx.HIDDEN_TAGS:
                self.depth = max(0, self.depth - 1)
            elif not self.depth and tag in tx.BLOCK_TAGS:
                self.parts.append("\n")

        def handle_data(self, data):
            if not self.depth:
                self.parts.append(data)

    reader = Reader()
    reader.feed(text)
    reader.close()
    return "".join(reader.parts)


def test_visible_text_equals_a_parser(spark, small):
    planted = ["a&eacute;b<p>c&#x41;&#66;</p>&amp;lt;", "&l<b>t;</b>&lt", "<script>&amp;x</script>y<br/>z&nbsp;.", "<!-- &amp; -->&copy&middot;", "no tags &amp no end", ""]
    pages = [r[0] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    rows = [(i, t) for i, t in enumerate([*planted, *pages])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.visible_text(F.col("t"))).collect()}
    whole = [i for i, t in rows if "<" not in re.sub(r"<[^<>]*>", "", t)]
    assert [got[i] for i in whole] == [plain_visible(rows[i][1]) for i in whole] and len(whole) >= 0.9 * len(rows)


def test_levels_of_the_trie_are_deleted_once_read(spark):
    import glob

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/*/rdd-*"))
    table = spark.createDataFrame([(1, "a b c d e, a b c x")], "doc_id long, text string")
    known = spark.createDataFrame([("a b c d e",), ("a b",), ("c",)], "key string")
    found = glossary.term_spans(table, known)
    # the trie and the last level; a place carries one short text, not a list of pieces
    assert len(set(glob.glob(f"{folder}/*/rdd-*")) - before) == 2
    assert [tuple(r) for r in found.orderBy("start").collect()] == [(1, 0, 9, "a b c d e"), (1, 11, 14, "a b"), (1, 15, 16, "c")]
    assert glossary._PLACES.field("rest").type == "string"


def test_visible_text_of_cut_references_equals_its_sql(spark, tmp_path):
    import duckdb

    planted = ["token = &quot<p>x", "&lt&gt&copy&middot&nbsp&#39 &amp&ampquot;&amp;lt;", "&am<a>p;&l<b>t;</b>", "<style>&amp;</style>&am<!-- x -->p", "&eacute;&#x41;\uffff", "<scripté>a</script>b", "<script>a</script\x0b>b</script >c", None, ""]
    spark.createDataFrame(list(enumerate(planted)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r["page_id"]: r["visible"] for r in texts.visible_text(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(texts.ORACLE_SQL["visible_text"]).fetchall())
    assert got[0] == "token = &quot\nx"


def test_ladder_goes_to_python_twice_however_many_tests(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(audit, "checkpoint", lambda df: kept.append(df) or df)
    fields = spark.createDataFrame([("p", 1, "body", "a-b"), ("q", 1, "body", "A b"), ("r", 1, "body", "c")], "path string, chapter_id long, kind string, text string")
    compared = audit.compare_fields(fields, spark.createDataFrame([(1, "x a b y")], "chapter_id long, scope string"))
    assert {r["path"]: r["status"] for r in compared.collect()} == {"p": audit.STATUSES[2], "q": audit.STATUSES[3], "r": audit.STATUSES[5]}
    # each pass holds a Python process of its own for every core
    assert compared._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    # what is kept are the fields, no scopes
    assert [df.columns for df in kept] == [["chapter_id", "path", "kind", "e", "status"]]
