"""Spelling variants: words within one edit of each other, found with forward and backward minimal acyclic automata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import checkpoint, release, stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a word's form if it occurs at least so many times as often.
RATIO = 10
#: One of so many (document, run) pairs loses a letter.
DROP = 31
#: Words that share a half and go into one automaton; larger groups are divided by a further half of what is left.
GROUP = 20_000
#: Words of the groups that share an automaton.
BLOCK = 20_000
#: Different words that a task counts before it hands them on.
FLUSH = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _words(text: str | None, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """The long enough words of a text with their counts, after the seeded deletions."""
    head = f"{'' if doc_id is None else doc_id}:".encode()
    start = zlib.crc32(head)
    for run, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: words of all texts that occur ``least_count`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _words(text, doc_id):
                    seen[word] += n
                if len(seen) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted different words; each word has the number of words before it.

    ``arcs[state]`` has, for each letter, the next state and how many words precede those that go that way.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        register: dict[tuple, int] = {}
        size: list[int] = []

        def close(node: list) -> int:
            """The registered state equal to ``node``, whose arcs already lead to registered states."""
            key = (node[0], tuple(node[1]))
            if (state := register.get(key)) is None:
                state = register[key] = len(self.arcs)
                arcs, before = {}, int(node[0])
                for letter, to in node[1]:
                    arcs[letter] = (to, before)
                    before += size[to]
                self.arcs.append(arcs)
                self.final.append(node[0])
                size.append(before)
            return state

        path: list[list] = [[False, []]]  # open states along the last word
        last = ""
        for word in words:
            k = 0
            while k < len(last) and k < len(word) and word[k] == last[k]:
                k += 1
            for i in range(len(last), k, -1):
                path[i - 1][1].append((last[i - 1], close(path.pop())))
            path += [[False, []] for _ in word[k:]]
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], close(path.pop())))
        self.root = close(path[0])

    def one_error(self, word: str, start: int, stop: int) -> set[int]:
        """Numbers of the words that differ from ``word`` by one inserted, deleted or replaced letter in [start, stop).

        All before ``start`` and from ``stop`` on is matched exactly. Letters put in before ``start`` or at ``stop`` count.
        """
        arcs, state, number = self.arcs, self.root, 0
        found: set[int] = set()
        n = len(word)

        def rest(state: int, number: int, i: int) -> None:
            while i < n:
                step = arcs[state].get(word[i])
                if step is None:
                    return
                state, before = step
                number += before
                i += 1
            if self.final[state]:
                found.add(number)

        for i in range(start):
            step = arcs[state].get(word[i])
            if step is None:
                return found
            state, before = step
            number += before
        for i in range(start, stop + 1):
            if i < stop:
                rest(state, number, i + 1)
            for letter, (to, before) in arcs[state].items():
                rest(to, number + before, i)
                if i < stop and letter != word[i]:
                    rest(to, number + before, i + 1)
            if i == stop:
                break
            step = arcs[state].get(word[i])
            if step is None:
                break
            state, before = step
            number += before
        return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words in each group, rows sorted by group: whole groups are gathered into blocks, each with an automaton or two."""
    columns = ["word", "near", "near_n"]

    def block(groups: list[tuple[int, int, list[str], dict[str, int]]]) -> Iterator[pa.RecordBatch]:
        # a group whose known part reaches the front is matched forward, one that has only an ending backward
        for forward in (True, False):
            own = [g for g in groups if (g[0] > 0) == forward]
            if not own:
                continue
            counts: dict[str, int] = {}
            for *_, targets in own:
                counts.update(targets)
            turned = {w if forward else w[::-1]: w for w in counts}
            names = sorted(turned)
            automaton = Automaton(names)
            out: list[tuple[str, str, int]] = []
            for start, stop, queries, _ in own:
                for word in queries:
                    hits = automaton.one_error(word, start, stop) if forward else automaton.one_error(word[::-1], len(word) - stop, len(word) - start)
                    out += [(word, near, counts[near]) for near in (turned[names[k]] for k in hits)]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], columns)

    groups: list = []
    held, key = 0, None
    for batch in batches:
        for k, start, stop, word, n, asks in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if k != key:
                if held >= BLOCK:
                    yield from block(groups)
                    groups, held = [], 0
                groups.append((start, stop, [], {}))
                key = k
            groups[-1][3][word] = n
            if asks:
                groups[-1][2].append(word)
            held += 1
    if groups:
        yield from block(groups)


def _keys(words: DataFrame) -> DataFrame:
    """Every word under each stretch [start, stop) of a length in which the one error may lie, with what lies around it.

    A word of the length itself asks; words of one letter more or less only answer.
    """
    around = F.concat_ws("\u0001", F.col("length").cast("string"), F.col("start").cast("string"), F.col("stop").cast("string"), F.expr("substring(word, 1, start)"), F.expr("substring(word, char_length(word) - (length - stop) + 1, length - stop)"))
    return words.withColumn("key", around).withColumn("asks", F.char_length("word") == F.col("length"))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, near, near_n)``: for each word of ``words(word, n)`` all others that are one edit away, each pair once a direction.

    One error leaves one half of a word whole. A word of length L asks among all words that begin with its first half, where
    the second holds the error, and among those that end with its second half. Groups of more than ``group`` words are
    divided: of the stretch that holds the error, again one half is whole, and a longer part of the word is known. Each
    division halves the stretch, down to single letters, where a group has few words more than the alphabet has letters.
    """
    size = F.char_length("word")
    lengths = words.where(size > 0).select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("length")).where("length > 0")
    halves = lambda df: df.withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_mid", F.floor((F.col("start") + F.col("stop")) / 2).cast("int"))
    narrow = lambda df: halves(df).select("word", "n", "length", F.when(F.col("_half") == 1, F.col("_mid")).otherwise(F.col("start")).alias("start"), F.when(F.col("_half") == 1, F.col("stop")).otherwise(F.col("_mid")).alias("stop"))
    # an empty stretch still takes an inserted letter; the stretch beside it has that too
    level = narrow(lengths.withColumns({"start": F.lit(0), "stop": F.col("length")}))
    found, staged = None, []
    while True:
        keyed = _keys(level.where("start < stop"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("asks").alias("asked")).where("asked and size > 1").drop("asked")
        members = stage(keyed.join(sizes, "key"), "spelling-members")
        staged.append(members)
        final = (F.col("size") <= group) | (F.col("stop") - F.col("start") <= 1)
        dealt = members.where(final).repartition("key").sortWithinPartitions("key", "word")
        pairs = dealt.select("key", "start", "stop", "word", "n", "asks").mapInArrow(_search, "word string, near string, near_n long")
        found = pairs if found is None else found.union(pairs)
        larger = members.where(~final)
        if larger.isEmpty():
            break
        level = narrow(larger)
    out = stage(found.groupBy("word", "near").agg(F.max("near_n").alias("near_n")), "spelling-pairs")
    release(*staged)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` to ``(word, root)``: the end of each chain of forms, by doubling steps. Chains can't turn in circles."""
    jumps = checkpoint(forms.select("word", F.col("form").alias("to")))
    while True:
        further = jumps.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        moved = checkpoint(jumps.join(further, "to", "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        jumps = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return jumps.withColumnRenamed("to", "root")


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every word of ``docs`` that is long and frequent enough.

    A word is a maximal run of letters A to Z and U+00C0 to U+00FF, A to Z lower-cased, of which one of ``DROP`` (document,
    run) pairs loses a letter, by a hash. A word's form is its near word of largest n, the smallest of ties, if that
    occurs ``ratio`` times as often as the word or more; root follows the forms to the last. Null texts have no words; a
    null doc_id hashes as the empty string; repeated rows count again. Other columns are not used. An empty table gives an
    empty one.
    """
    words = stage(word_counts(docs), "spelling-words")
    pairs = near_words(words, group)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    formed = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
