"""Glossaries: terms with derived forms, links in texts, definition lines, and drift between two versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.sources.staging import checkpoint, release

#: Words of ASCII letters, digits and ``_``, and any other sign for itself.
PIECE = "[A-Za-z0-9_]+|[^A-Za-z0-9_]"
WORD_SIGN = re.compile("[A-Za-z0-9_]")
#: Python objects are made of so many texts, and kept for so many places, at a time.
TEXTS, PLACES = 16, 500
#: Words whose runs are counted at a time, unless one text has more, and rows handed on at a time.
WORDS, ROWS = 100_000, 20_000
_PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("node", pa.string()), ("at", pa.int32()), ("stop", pa.int32()), ("key", pa.string()), ("rest", pa.string())])


def clean_term(term: Column) -> Column:
    return tx.trim(F.regexp_replace(tx.trim(term), r"[:;,\-]+$", ""))


def glossary_map(terms: DataFrame) -> DataFrame:
    """``(pos, term, definition)`` to ``(key, definition, is_exact)``.

    Terms of 2 to 99 signs count, lower-cased; each also offers its plural, or its singular if it ends in s. The last
    exact entry of a key wins, and where there is none the first derived one. One shuffle on the key.
    """
    kept = terms.withColumn("term", clean_term(F.col("term"))).where(F.length("term").between(2, 99)).withColumn("key", F.lower("term"))
    other = F.when(F.endswith("key", F.lit("s")), F.when(F.length("key") > 2, F.expr("left(key, length(key) - 1)"))).otherwise(F.concat("key", F.lit("s")))
    form = lambda key, exact: F.struct(key.alias("key"), F.lit(exact).alias("is_exact"), F.col("pos").alias("pos"), F.col("definition").alias("definition"))
    both = kept.select(F.inline(F.array(form(F.col("key"), True), form(other, False))))
    # exact before derived; among exact the last, among derived the first
    best = F.struct("is_exact", F.when(F.col("is_exact"), F.col("pos")).otherwise(-F.col("pos")).alias("place"))
    won = both.where("key is not null").groupBy("key").agg(F.max_by(F.struct("definition", "is_exact"), best).alias("w"))
    return won.select("key", "w.definition", "w.is_exact")


def _counted(longest: int):
    """Runs of 1 to ``longest`` words of each text, joined by blanks, with their counts in it; about WORDS words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pc.cumulative_sum(pc.coalesce(pc.list_value_length(batch.column(1)), 0)).to_numpy()
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                words = batch.column(1).slice(at, stop - at)
                text, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
                for n in range(1, longest + 1):
                    last = len(words) - n + 1
                    if last <= 0:
                        break
                    whole = pa.array(text[:last] == text[n - 1 :])
                    key = words if n == 1 else pc.binary_join_element_wise(*(words.slice(i, last) for i in range(n)), " ")
                    runs = pa.table({"text": text[:last], "key": key}).filter(whole)
                    for part in runs.group_by(["text", "key"], use_threads=False).aggregate([([], "count_all")]).to_batches(max_chunksize=ROWS):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.add(part.column("text"), at)), part.column("key"), part.column("count_all")], ["doc_id", "key", "hits"])
                at = stop

    return run


def _hits(docs: DataFrame, glossary: DataFrame, longest: int) -> DataFrame:
    """``(doc_id, key, hits)`` of the runs of 1 to ``longest`` words that are keys of the glossary.

    Runs are counted text by text without a shuffle. Most that are no keys are dropped before the one shuffle by a table of
    2^24 bits with one at each key's hash: broadcast, it has at most 262,144 rows, however many keys there are. What passes is
    joined with the keys. Only where a doc_id stands in several rows their counts are summed.
    """
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("words"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = glossary.select("key").where("key is not null").distinct()
    bit = F.xxhash64("key").bitwiseAND((1 << 24) - 1)
    bits = keys.groupBy(F.shiftright(bit, 6).alias("_slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))")).alias("_bits"))
    found = words.mapInArrow(_counted(longest), f"doc_id {kind}, key string, hits long").withColumn("_slot", F.shiftright(bit, 6))
    likely = found.join(F.broadcast(bits), "_slot").where(F.getbit("_bits", F.xxhash64("key").bitwiseAND(63).cast("int")) == 1)
    # keys are distinct; a semi-join would be pushed down before the bits
    kept = likely.select("doc_id", "key", "hits").join(keys.hint("shuffle_hash"), "key").select("doc_id", "key", "hits")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept if again.isEmpty() else kept.groupBy("doc_id", "key").agg(F.sum("hits").alias("hits"))


def term_hits(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(doc_id, key, hits)``: how often each one-word key stands in each text, by a join on the word.

    The form for glossaries of any size: words are counted inside each text. link_terms marks them in the text.
    """
    return _hits(docs, glossary, 1)


def definition_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` to ``(doc_id, term, definition)``.

    A line ``Term: definition`` whose term has fewer than 80 signs and starts upper-case begins an entry; the lines up to
    the next one continue it. A window over each document's own lines, then one group for each entry.
    """
    lines = lines.withColumn("line", tx.trim(F.col("line"))).where("line != ''")
    begins = F.col("line").rlike(r"^[A-Z][^:]{0,78}:")
    numbered = lines.withColumn("begins", begins).withColumn("entry", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))).where("entry > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"])
    joined = numbered.groupBy("doc_id", "entry").agg(F.array_join(parts, " ").alias("whole"))
    return joined.select("doc_id", F.substring_index("whole", ":", 1).alias("term"), tx.trim(F.expr("substring(whole, locate(':', whole) + 1)")).alias("definition"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(key, left_definition, right_definition, status)`` of two ``(key, definition)`` tables.

    missing and extra keys, equal definitions, else PARAPHRASED, TRUNCATED or MINOR DIFF by the left length in percent of
    the right (below 70, below 95; half to even). Empty right definitions count as 0 percent.
    """
    both = left.withColumnRenamed("definition", "left_definition").join(right.withColumnRenamed("definition", "right_definition"), "key", "full")
    a, b = F.col("left_definition"), F.col("right_definition")
    ratio = F.when(F.length(b) > 0, F.bround(100.0 * F.length(a) / F.length(b))).otherwise(0)
    status = F.when(b.isNull(), "extra").when(a.isNull(), "missing").when(a == b, "equal").when(ratio < 70, "PARAPHRASED").when(ratio < 95, "TRUNCATED").otherwise("MINOR DIFF")
    return both.withColumn("status", status)


def phrase_hits(docs: DataFrame, glossary: DataFrame, longest: int = 4) -> DataFrame:
    """``(doc_id, key, hits)``: how often each key of up to ``longest`` words, joined by single blanks, stands in each text.

    Every run of so many words is a candidate, counted inside its text before the join on the key; overlapping occurrences count.
    """
    return _hits(docs, glossary, longest)


def term_trie(glossary: DataFrame) -> DataFrame:
    """``(key, ...)`` to the edges ``(depth, node, piece, child, key, open)`` of a trie over the pieces of the keys.

    A node is the digest of its path, so equal beginnings meet without any numbering; each (node, piece) has one child.
    key is null unless a key ends at the child; open tells whether longer keys pass it. Keys are taken in lower case.
    """
    keys = glossary.select(F.lower("key").alias("key")).where("key != ''").distinct()
    cut = keys.select("key", F.regexp_extract_all("key", F.lit(PIECE), F.lit(0)).alias("p"))
    path = lambda n: F.md5(F.array_join(F.slice("p", 1, n), "").cast("binary"))
    steps = cut.select("key", F.size("p").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda d: F.struct(d.alias("depth"), path(d - 1).alias("node"), F.get("p", d - 1).alias("piece"), path(d).alias("child")))).alias("e"))
    edges = steps.groupBy("e.depth", "e.node", "e.piece", "e.child")
    return edges.agg(F.max(F.when(F.col("e.depth") == F.col("n"), F.col("key"))).alias("key"), F.max(F.col("n") > F.col("e.depth")).alias("open"))


def _slices(batches: Iterator[pa.RecordBatch], size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def _follow(deepest: int):
    """For each place of a text that may begin a term: its node, where its first piece ends, and the text behind that: as many pieces
    as the deepest term has, and one sign more."""
    tag, piece = re.compile("<[^>]*>|<[^>]*$|[^<]+"), re.compile(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for doc_id, text, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                roots = {f["piece"]: f for f in firsts}
                rows = []
                for part in tag.finditer(text):
                    if part[0].startswith("<"):
                        continue
                    cut = [m.span() for m in piece.finditer(text, *part.span())]
                    # a boundary lies between two pieces, or a piece and the part's edge, of which one only is a word
                    word = [False, *(bool(WORD_SIGN.match(text, a)) for a, _ in cut), False]
                    low = [text[a:b].lower() for a, b in cut]
                    for n, (a, b) in enumerate(cut):
                        root = roots.get(low[n])
                        if root is None or word[n] == word[n + 1]:
                            continue
                        rest = text[b : min(cut[min(n + deepest, len(cut)) - 1][1] + 1, part.end())] if root["open"] else ""
                        hit = root["key"] is not None and word[n + 1] != word[n + 2]
                        if hit or rest:
                            rows.append({"doc_id": doc_id, "start": a, "node": root["child"] if rest else None, "at": b, "stop": b if hit else None, "key": root["key"] if hit else None, "rest": rest})
                        if len(rows) >= PLACES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PLACES)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PLACES)

    return run


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of matches sorted by text and start, those that begin where the one kept before has ended or later."""
    row, end = None, 0
    for batch in batches:
        kept = []
        for k, (own, start, stop) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            if own != row:
                row, end = own, 0
            if start >= end:
                kept.append(k)
                end = stop
        yield batch.take(pa.array(kept, pa.int64()))


def term_spans(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(doc_id, text)`` and a glossary of any size to ``(doc_id, start, stop, key)``: the terms to link in each text.

    Terms match in any case, outside tags, between word boundaries (of ASCII words). From left to right the longest term at
    a place wins, and the search goes on behind it. Positions are code points, stop exclusive. doc_id must be a unique long;
    null texts have no spans.

    The keys form a trie. The different pieces of each text join its first level; places that may begin a term then carry
    the text behind them, as long as the deepest term, and join one level after the other by its next piece. A place's node
    has one child at most for a piece, so the candidates only get fewer, and each keeps its longest term alone. A level
    holds the places that are settled too, so the one before is deleted. The greedy choice reads a text's matches in their
    order and remembers one end.
    """
    trie = checkpoint(term_trie(glossary))
    deepest = trie.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    own = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = own.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PIECE), F.lit(0)))).alias("piece"))
    firsts = pieces.join(trie.where("depth = 1").select("piece", "child", "key", "open"), "piece").groupBy("doc_id").agg(F.collect_list(F.struct("piece", "child", "key", "open")).alias("firsts"))
    level = checkpoint(own.join(firsts, "doc_id").mapInArrow(_follow(deepest), "doc_id long, start int, node string, at int, stop int, key string, rest string"))
    for depth in range(2, deepest + 1):
        if level.where("rest != ''").isEmpty():
            break
        edges = trie.where(F.col("depth") == depth).select("node", F.col("piece").alias("_piece"), "child", F.col("key").alias("_key"), F.col("open").alias("_open"))
        # settled places go on in the same join, each with a node of its own that no edge has, so that they meet in no one task
        node = F.when(F.col("rest") != "", F.col("node")).otherwise(F.concat_ws("-", F.lit("settled"), "doc_id", "start"))
        # the pieces of a text are the longest runs, so behind a word there is always a boundary, behind another sign only before a word
        found = level.withColumns({"node": node, "_next": F.regexp_extract("rest", PIECE, 0)}).withColumns({"_piece": F.lower("_next"), "_behind": F.expr("substring(rest, length(_next) + 1)")})
        found = found.join(edges, ["node", "_piece"], "left").withColumn("_end", F.col("at") + F.length("_next"))
        longer = F.col("_key").isNotNull() & (F.col("_next").rlike("^[A-Za-z0-9_]") | F.col("_behind").rlike("^[A-Za-z0-9_]"))
        rest = F.when(F.coalesce("_open", F.lit(False)), F.col("_behind")).otherwise("")
        moved = found.select("doc_id", "start", F.when(rest != "", F.col("child")).alias("node"), F.col("_end").alias("at"), F.when(longer, F.col("_end")).otherwise(F.col("stop")).alias("stop"), F.when(longer, F.col("_key")).otherwise(F.col("key")).alias("key"), rest.alias("rest"))
        before, level = level, checkpoint(moved.where("key is not null or rest != ''"))
        release(before)
    found = level.where("key is not null").select("doc_id", "start", "stop", "key")
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_select, found.schema)


def _with_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out = []
        for whole, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for s in own or ():
                parts += [whole[at : s["start"]], f'<span data-term="{s["key"].replace("&", "&amp;").replace(chr(34), "&quot;")}">', whole[s["start"] : s["stop"]], "</span>"]
                at = s["stop"]
            out.append(whole if whole is None else "".join(parts) + whole[at:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "linked"])


def link_glossary(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(doc_id, linked)``: each text with its terms in ``<span data-term="key">`` (see term_spans)."""
    spans = term_spans(texts, glossary).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "key"))).alias("spans"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.col("text").cast("string")).join(spans, "doc_id", "left").mapInArrow(_with_links, f"doc_id {kind}, linked string")
