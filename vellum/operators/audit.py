"""Fields held against their source: a ladder of containment tests, and a bounded difference where all of them fail."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vellum.functions import text as tx
from vellum.sources.staging import checkpoint

STATUSES = ("exact_after_layout_normalization", "exact_after_pdf_wrap_dehyphenation", "punctuation_difference", "case_or_punctuation_difference", "footnote_difference", "substantive_review_required")
#: Tokens of an anchor, kept operations, tokens and signs of excerpts, signs of operations and of plain excerpts.
ANCHOR, OPERATIONS, FIRST, EXCERPT, OPERATION, PLAIN = 3, 12, 40, 300, 500, 240

#: Fields of a chapter that are sought in its scope at once.
BLOCK = 10_000


def collect_fields(chapters: DataFrame) -> DataFrame:
    """``(path, chapter_id, kind, text)``: the visible texts of nested chapters; what follows ``<hr>`` in a section is its footnote."""
    titles = chapters.select(F.concat(F.lit("/"), "id", F.lit("/title")).alias("path"), F.col("id").alias("chapter_id"), F.lit("title").alias("kind"), F.col("title").alias("html"))
    sections = chapters.select(F.col("id").alias("chapter_id"), F.posexplode("sections").alias("n", "s"))
    base = F.concat(F.lit("/"), "chapter_id", F.lit("/sections/"), F.col("n").cast("string"))
    halves = F.split("s.legalText", r"(?i)<hr\s*/?>", 2)
    fields = sections.select(
        "chapter_id",
        F.inline(
            F.array(
                F.struct(F.concat(base, F.lit("/title")).alias("path"), F.lit("section_title").alias("kind"), F.col("s.title").alias("html")),
                F.struct(F.concat(base, F.lit("/legalText")).alias("path"), F.lit("body").alias("kind"), F.get(halves, F.lit(0)).alias("html")),
                F.struct(F.concat(base, F.lit("/footnote")).alias("path"), F.lit("footnote").alias("kind"), F.get(halves, F.lit(1)).alias("html")),
            )
        ),
    )
    questions = sections.select("chapter_id", base.alias("base"), F.posexplode("s.qas").alias("q", "qa"))
    asked = questions.select(
        "chapter_id",
        F.inline(
            F.array(
                F.struct(F.concat("base", F.lit("/qas/"), F.col("q").cast("string"), F.lit("/q")).alias("path"), F.lit("question").alias("kind"), tx.strip_question_prefix(F.col("qa.q")).alias("html")),
                F.struct(F.concat("base", F.lit("/qas/"), F.col("q").cast("string"), F.lit("/a")).alias("path"), F.lit("answer").alias("kind"), F.col("qa.a").alias("html")),
            )
        ),
    )
    every = titles.unionByName(fields).unionByName(asked)
    return every.select("path", "chapter_id", "kind", tx.visible_text(F.col("html")).alias("text")).where(F.length(tx.trim(F.col("text"))) > 0)


@F.arrow_udf(ArrayType(IntegerType()))
def _first_held(scopes: pa.Array, fields: pa.Array) -> pa.Array:
    """For each field of a scope the first of its forms, by number, that stands in the scope's form of that number, or null.

    One automaton of all fields and one scan for each form; what a form has settled isn't sought in the next. Null or empty
    forms stand nowhere. Rows become Python objects one after the other, so a task holds one scope beside Arrow's batch.
    """
    out: list[list[int | None] | None] = []
    for whole, own in zip(scopes, fields, strict=True):
        whole, own = whole.as_py(), own.as_py()
        if whole is None or own is None:
            out.append(None)
            continue
        first: list[int | None] = [None] * len(own)
        for n, form in enumerate(whole):
            wanted: dict[str, list[int]] = {}
            for k, forms in enumerate(own):
                if form and first[k] is None and forms and forms[n]:
                    wanted.setdefault(forms[n], []).append(k)
            if not wanted:
                continue
            automaton = ahocorasick.Automaton()
            for part in wanted:
                automaton.add_word(part, part)
            automaton.make_automaton()
            for _, part in automaton.iter(form):
                # a part that ends where a longer one does is reported with it, so the scan may stop once all are found
                for k in wanted.pop(part, ()):
                    first[k] = n
                if not wanted:
                    break
        out.append(first)
    return pa.array(out, pa.list_(pa.int32()))


def compare_fields(fields: DataFrame, scopes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(path, chapter_id, kind, text)`` and ``(chapter_id, scope)`` to ``(path, chapter_id, kind, sha256, characters, status, expected)``.

    A scope is one chapter's source text, a field one of its texts. The fields of a chapter travel together to its scope, at
    most about ``block`` of them at once, and are sought with an automaton over all of them: a scope is scanned once for a
    test, however many fields it has. Tests come from the strictest to the loosest; the looser forms of a scope are only worked
    out where fields are left that the strictest has not settled, and go to Python together. What is kept are the judged fields.
    """
    rows = fields.withColumn("_e", tx.normalize_layout(F.col("text")))
    blocks = fields.groupBy("chapter_id").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    rows = rows.join(blocks, "chapter_id").withColumn("_block", F.pmod(F.xxhash64("path"), F.col("_blocks")))
    field = F.struct("path", "kind", "text", F.col("_e").alias("e"))
    grouped = rows.groupBy("chapter_id", "_block").agg(F.collect_list(field).alias("_fields"))
    # by a given number, as fields are small and would else draw their scopes into a few tasks
    tasks = int(scopes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = grouped.repartition(tasks, "chapter_id").join(scopes.select("chapter_id", "scope").repartition(tasks, "chapter_id"), "chapter_id", "left")
    state = state.withColumn("_strict", tx.normalize_layout(F.col("scope")))
    state = state.withColumn("_exact", _first_held(F.array("_strict"), F.transform("_fields", lambda f: F.array(f["e"]))))
    left = F.exists("_exact", lambda n: n.isNull())  # else neither the parts nor these forms of the scope are needed
    # a column of its own, so that the words of a scope are cut once
    state = state.withColumn("_words", F.when(left, tx.words_only(F.col("_strict"))))
    whole = F.array(tx.normalize_layout(F.col("scope"), True), F.col("_words"), F.lower("_words"))
    forms = lambda f: F.array(tx.normalize_layout(f["text"], True), tx.words_only(f["e"]), tx.words_only(f["e"], True))
    parts = F.zip_with("_fields", "_exact", lambda f, n: F.when(n.isNull(), forms(f)))
    state = state.withColumn("_looser", _first_held(F.when(left, whole), F.when(left, parts)))
    numbers = F.transform("_fields", lambda f, k: F.coalesce(F.get("_exact", k), F.get("_looser", k) + 1))
    judged = state.select("chapter_id", F.explode(F.arrays_zip(F.col("_fields"), numbers.alias("_n"))).alias("f"))
    judged = checkpoint(judged.select("chapter_id", "f._fields.path", "f._fields.kind", "f._fields.e", F.get(F.array(*map(F.lit, STATUSES[:4])), F.col("f._n")).alias("status")))
    last = F.when(F.col("kind") == "footnote", STATUSES[4]).otherwise(STATUSES[5])
    return judged.select("path", "chapter_id", "kind", F.upper(F.sha2("e", 256)).alias("sha256"), F.length("e").alias("characters"), F.coalesce("status", last).alias("status"), F.col("e").alias("expected"))


def histogram(compared: DataFrame) -> DataFrame:
    """``(status, n, needs_review)``: all but the two exact statuses ask for a review."""
    counts = compared.groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("needs_review", ~F.col("status").isin(*STATUSES[:2]))


def verdict(compared: DataFrame) -> DataFrame:
    """``(fields, exact, reviews, exit_code)``: one row over all fields; the code is 1 if any asks for a review."""
    counts = histogram(compared).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fields"), F.coalesce(F.sum(F.when(F.col("needs_review"), F.col("n"))), F.lit(0)).alias("reviews"))
    return counts.select("fields", (F.col("fields") - F.col("reviews")).alias("exact"), "reviews", (F.col("reviews") > 0).cast("int").alias("exit_code"))


def _grams(tokens: Column) -> Column:
    """The hash of every stretch of ANCHOR tokens, in order."""
    last = F.size(tokens) - ANCHOR
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(tokens, i + 1, ANCHOR)))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<long>"))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chapter_id, b, gram)``: where those grams of a scope stand that its fields have."""
    for batch in batches:
        for k in range(batch.num_rows):
            grams, own = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            at = np.flatnonzero(np.isin(grams, own))
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(at), pa.int32())), pa.array(at, pa.int32()), pa.array(grams[at], pa.int64())], ["chapter_id", "b", "gram"])


def locate(fields: DataFrame, scopes: DataFrame, tokens: Column | str = "b") -> DataFrame:
    """``(path, chapter_id, start, stop)``: the stretch of scope tokens that stands for each field of ``(path, chapter_id, a)``.
    ``tokens`` are those of a scope, worked out only behind the shuffle.

    Stretches of three tokens that occur once in a field are its anchors, matched with those of its chapter's scope by an
    equi-join; a scope meets the grams of its fields first, and only the places of those go into that join. Where an anchor near the field's beginning lies before one near its end, the stretch reaches from one to
    the other; else it is as long as the field and lies on the diagonal that most anchors agree on. A field without any
    match gets the scope's beginning.
    """
    keyed = fields.select("path", "chapter_id", F.size("a").alias("n"), F.posexplode(_grams(F.col("a"))).alias("at", "gram"))
    once = keyed.groupBy("path", "chapter_id", "n", "gram").agg(F.count("*").alias("c"), F.min("at").alias("a")).where("c = 1").drop("c")
    asked = once.groupBy("chapter_id").agg(F.collect_set("gram").alias("_own"))
    met = scopes.join(asked, "chapter_id").withColumn("_b", F.col(tokens) if isinstance(tokens, str) else tokens).select("chapter_id", "_own", F.get(F.transform(F.array("_b"), _grams), F.lit(0)).alias("_grams"))
    kind = scopes.schema["chapter_id"].dataType.simpleString()
    own = met.select("chapter_id", "_grams", "_own").mapInArrow(_wanted, f"chapter_id {kind}, b int, gram long")
    slack = F.greatest(F.lit(20), F.expr("n div 5"))
    anchor = F.struct("a", "b")
    matched = once.join(own, ["chapter_id", "gram"]).groupBy("path", "chapter_id", "n", (F.col("b") - F.col("a")).alias("diagonal"))
    by_diagonal = matched.agg(F.count("*").alias("votes"), F.min(F.when(F.col("a") <= slack, anchor)).alias("head"), F.max(F.when(F.col("a") + ANCHOR >= F.col("n") - slack, anchor)).alias("tail"))
    found = by_diagonal.groupBy("path", "chapter_id", "n").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).alias("diagonal"))
    both = F.coalesce(F.col("head.b") <= F.col("tail.b"), F.lit(False))
    start = F.greatest(F.lit(0), F.when(both, F.col("head.b") - F.col("head.a")).otherwise(F.col("diagonal")))
    stop = F.when(both, F.col("tail.b") - F.col("tail.a")).otherwise(F.greatest(F.lit(0), F.col("diagonal"))) + F.col("n")
    return found.select("path", "chapter_id", start.alias("start"), stop.alias("stop"))


def _longest_rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each gap's pairs, sorted by gap and left place, a longest run whose right places rise too (the leftmost by its piles)."""

    def rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        tops: list[int] = []
        piles: list[int] = []  # the pair on top of each pile
        before = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            before[k] = piles[at - 1] if at else -1
            tops[at : at + 1] = [j]
            piles[at : at + 1] = [k]
        out, k = [], piles[-1] if piles else -1
        while k >= 0:
            out.append(pairs[k])
            k = before[k]
        return out

    gap, pairs = None, []
    for batch in batches:
        out = []
        for key, n, i, j in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (key, n) != gap:
                out += [(gap[0], *p) for p in rise(pairs)] if gap else []
                gap, pairs = (key, n), []
            pairs.append((i, j))
        yield _placed(out)
    yield _placed([(gap[0], *p) for p in rise(pairs)] if gap else [])


def _placed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("key", "i", "j"), r, strict=True)) for r in rows], schema=pa.schema([("key", pa.string()), ("i", pa.int32()), ("j", pa.int32())]))


def align(pairs: DataFrame) -> DataFrame:
    """``(key, a, b)``, two lists of tokens each, to ``(key, side, n, token, matched, gap)``: a patience alignment.

    Tokens that stand once on both sides are anchors; a longest run of anchors that rise on both sides is matched, and each
    gap between two matches is aligned again by itself. In a gap without such tokens, the first of a token on one side pairs
    with the first on the other, the second with the second. Ends when no gap has a common token. ``gap`` is the number of
    matches before a token on its side, so tokens of one gap stand against each other. key must be unique and a string.

    All pairs advance together: a round is a join of equal tokens inside each gap and one pass over its pairs in order.
    """
    side = lambda c: pairs.select("key", F.lit(c).alias("side"), F.posexplode(c).alias("n", "token"))
    state = checkpoint(side("a").union(side("b")).withColumn("matched", F.lit(False)))
    before = Window.partitionBy("key", "side").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lambda df: df.withColumn("gap", F.coalesce(F.sum(F.col("matched").cast("int")).over(before), F.lit(0)))
    same = Window.partitionBy("key", "side", "gap", "token")
    while True:
        open_ = numbered(state).where("not matched").withColumns({"rank": F.row_number().over(same.orderBy("n")), "c": F.count("*").over(same)})
        left, right = (open_.where(F.col("side") == c).select("key", "gap", "token", "rank", F.col("n").alias(p), F.col("c").alias(f"c{p}")) for c, p in (("a", "i"), ("b", "j")))
        met = left.join(right, ["key", "gap", "token", "rank"]).withColumn("once", (F.col("ci") == 1) & (F.col("cj") == 1))
        anchors = met.withColumn("_any", F.max("once").over(Window.partitionBy("key", "gap"))).where("once or not _any")
        found = checkpoint(anchors.select("key", "gap", "i", "j").repartition("key", "gap").sortWithinPartitions("key", "gap", "i").mapInArrow(_longest_rise, "key string, i int, j int"))
        if found.isEmpty():
            return numbered(state)
        hits = found.select("key", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("i").alias("n")), F.struct(F.lit("b").alias("side"), F.col("j").alias("n")))).alias("h")).select("key", "h.side", "h.n", F.lit(True).alias("_hit"))
        state = checkpoint(state.join(hits, ["key", "side", "n"], "left").select("key", "side", "n", "token", (F.col("matched") | F.coalesce("_hit", F.lit(False))).alias("matched")))


def changes(aligned: DataFrame) -> DataFrame:
    """``(key, gap, operation, expected, actual)``: replace, delete or insert for each gap with tokens left; the sides' tokens in order."""
    left = aligned.where("not matched").groupBy("key", "gap")
    tokens = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("n", "token")))), lambda t: t["token"])
    gaps = left.agg(tokens("a").alias("expected"), tokens("b").alias("actual"))
    kind = F.when(F.size("actual") == 0, "delete").when(F.size("expected") == 0, "insert").otherwise("replace")
    return gaps.select("key", "gap", kind.alias("operation"), "expected", "actual")


def differences(compared: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(path, chapter_id, similarity, expected_excerpt, actual_excerpt, operation_count, operations)`` of the fields that no
    exact test passed, against their chapter's scope.

    The stretch of the scope that stands for a field comes from joined anchors (see locate), and the two are aligned by
    patience (see align). Similarity is twice the matched tokens over the tokens of both. Where either side has no token, it
    is 0 and the excerpts are of the texts.
    """
    left = compared.where(~F.col("status").isin(*STATUSES[:2])).select("path", "chapter_id", "expected", tx.tokens(F.col("expected")).alias("a"))
    layout = tx.normalize_layout(F.col("scope"))
    placed = left.join(locate(left, scopes.select("chapter_id", "scope"), tx.tokens(layout)), ["path", "chapter_id"], "left")
    # a scope travels as its text and once for a block of its fields, and its tokens are cut behind the shuffle
    blocks = left.groupBy("chapter_id").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    placed = placed.join(blocks, "chapter_id").withColumn("_block", F.pmod(F.xxhash64("path"), F.col("_blocks")))
    grouped = placed.groupBy("chapter_id", "_block").agg(F.collect_list(F.struct("path", "expected", "a", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", F.size("a")).alias("stop"))).alias("_fields"))
    whole = grouped.join(scopes.select("chapter_id", "scope"), "chapter_id", "left").select("chapter_id", "_fields", layout.alias("_scope"))

    def windows(b: Column) -> Column:
        return F.transform("_fields", lambda f: F.struct(f["path"].alias("path"), f["expected"].alias("expected"), f["a"].alias("a"), F.slice(b, f["start"] + 1, F.greatest(F.lit(0), f["stop"] - f["start"])).alias("w")))

    cut = F.get(F.transform(F.array(tx.tokens(F.col("_scope"))), windows), F.lit(0))  # by a variable, so that tokens are cut once
    rows = whole.select("chapter_id", F.left("_scope", F.lit(PLAIN)).alias("_begin"), F.inline(cut))
    rows = rows.select("path", "chapter_id", "expected", "a", "w", ((F.size("a") == 0) | (F.size("w") == 0)).alias("_none"), "_begin")
    rows = checkpoint(rows.withColumn("key", F.to_json(F.struct("path", "chapter_id"))))
    aligned = align(rows.where("not _none").select("key", "a", F.col("w").alias("b")))
    matched = aligned.where("side = 'a'").groupBy("key").agg(F.count_if("matched").alias("_matched"))
    cut = lambda c: F.left(F.array_join(c, " "), F.lit(OPERATION)).alias(c)
    listed = changes(aligned).select("key", "gap", "operation", cut("expected"), cut("actual")).groupBy("key").agg(F.count("*").cast("int").alias("_n"), F.array_sort(F.collect_list(F.struct("gap", "operation", "expected", "actual"))).alias("_all"))
    joined = rows.join(matched, "key", "left").join(listed, "key", "left")
    kept = F.transform(F.slice("_all", 1, OPERATIONS), lambda c: F.struct(c["operation"].alias("operation"), c["expected"].alias("expected"), c["actual"].alias("actual")))
    empty = F.array().cast("array<struct<operation: string, expected: string, actual: string>>")
    excerpt = lambda tokens, whole: F.when(F.col("_none"), F.left(F.coalesce(whole, F.lit("")), F.lit(PLAIN))).otherwise(F.left(F.array_join(F.slice(tokens, 1, FIRST), " "), F.lit(EXCERPT)))
    return joined.select(
        "path",
        "chapter_id",
        F.when(F.col("_none"), 0.0).otherwise(F.round(2.0 * F.col("_matched") / (F.size("a") + F.size("w")), 6)).alias("similarity"),
        excerpt("a", F.col("expected")).alias("expected_excerpt"),
        excerpt("w", F.col("_begin")).alias("actual_excerpt"),
        F.coalesce("_n", F.lit(0)).alias("operation_count"),
        F.coalesce(kept, empty).alias("operations"),
    )


def missing_chunks(pairs: DataFrame, least: int = 20) -> DataFrame:
    """``(key, expected, actual)`` to ``(key, chunk)``: stretches of more than ``least`` words of expected that actual lacks."""
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-zA-Z0-9]+", " ")), " "), lambda w: w != "")
    aligned = align(pairs.select(F.col("key").cast("string").alias("key"), words("expected").alias("a"), words("actual").alias("b")))
    gone = changes(aligned).where(F.size("expected") > least)
    return gone.select(F.col("key").cast("long").alias("key"), F.array_join("expected", " ").alias("chunk"))
