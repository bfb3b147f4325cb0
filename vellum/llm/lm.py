"""Language-model scores: smoothed n-grams as states of a weighted backoff automaton with failure arcs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage

#: Words of an n-gram.
ORDER = 2
#: Weight of the lower order beside the counts of a context (a Dirichlet prior), for n-grams of 2 words, 3 words and more.
STRENGTH = (400.0, 20.0)
#: Bytes of text of a chunk. A longer document is cut into pieces, each with the words before it as its lead.
CHUNK = 1 << 22
#: Keys of one slice of the counts.
SLICE = 2_000_000
END, BEGIN = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = "chunk long, rows array<bigint>, ids array<bigint>, held array<boolean>, leads array<int>, ended array<boolean>, blob binary, raw_size long, train_tokens long"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, so that the high, mostly empty ones compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def chunks(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The words of some documents a row, one line for each document or piece of one, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top = TaskContext.get().partitionId() << 33
        state = {"row": top, "chunk": top}
        lines: list[tuple[int, int | None, bool, int, bool, bytes]] = []
        size = tokens = 0

        def row() -> pa.RecordBatch:
            nonlocal lines, size, tokens
            rows, ids, held, leads, ended, texts = (list(x) for x in zip(*lines, strict=True))
            raw = b"\n".join(texts)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_())
            columns = [pa.array([x], pa.list_(k)) for x, k in zip((rows, ids, held, leads, ended), kinds, strict=True)]
            blob = pa.compress(raw, codec="zstd", asbytes=True)
            out = pa.RecordBatch.from_arrays([pa.array([state["chunk"]], pa.int64()), *columns, pa.array([blob], pa.binary()), pa.array([len(raw)], pa.int64()), pa.array([tokens], pa.int64())], ["chunk", "rows", "ids", "held", "leads", "ended", "blob", "raw_size", "train_tokens"])
            state["chunk"] += 1
            lines, size, tokens = [], 0, 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "replace").lower().split()
                held, at, step = is_held_out(doc_id), 0, len(words)
                if sum(map(len, words)) + len(words) > CHUNK:
                    step = max(1, CHUNK * len(words) // (sum(map(len, words)) + len(words)))
                while True:
                    lead = min(at, order - 1)
                    last = at + step >= len(words)
                    lines.append((state["row"], doc_id, held, lead, last, b" ".join(words[at - lead : at + step])))
                    size += len(lines[-1][-1]) + 1
                    tokens += 0 if held else min(step, len(words) - at) + last
                    if size >= CHUNK:
                        yield row()
                    at += step
                    if last:
                        break
                state["row"] += 1
        if lines:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _CHUNK)


@dataclass
class Grams:
    """The n-grams of a chunk. ``words`` holds its tokens line by line, each line after BEGIN or its lead."""

    words: np.ndarray
    scored: np.ndarray
    line: np.ndarray
    number: list[np.ndarray]  # which n-gram ends at each token, by order; -1 for none
    distinct: list[np.ndarray]  # sorted keys of each order
    example: list[np.ndarray]  # a token at which each of them ends
    counts: list[np.ndarray]  # how often each occurs in the lines that are learned from

    @classmethod
    def of(cls, blob: bytes, raw_size: int, leads: list[int], ended: list[bool], held: list[bool], order: int) -> Grams:
        texts = pa.decompress(blob, decompressed_size=raw_size, codec="zstd", asbytes=True).split(b"\n") if raw_size else [b""] * len(leads)
        found: list[bytes] = [b"\n", b"\r"]  # END and BEGIN; no word is white space
        sizes, unscored = [], []
        for text, lead, last in zip(texts, leads, ended, strict=True):
            before = len(found)
            if not lead:
                found.append(b"\r")
            if text:
                found += text.split(b" ")
            if last:
                found.append(b"\n")
            sizes.append(len(found) - before)
            unscored.append(lead or 1)
        known = {word: k for k, word in enumerate(dict.fromkeys(found))}
        words, counts = np.fromiter(map(known.__getitem__, found), np.int64, len(found))[2:], np.array(sizes, np.int64)
        line = np.repeat(np.arange(len(sizes)), counts)
        places = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        key = own = hashes[words]
        out = cls(words, places >= np.array(unscored)[line], line, [], [], [], [])
        learned = out.scored & ~np.array(held, bool)[line]
        for n in range(order):
            if n:
                key = np.concatenate((key[:1], key[:-1])) * _MIX + own
                key ^= key >> np.uint64(29)
                key *= _TURN
                key ^= key >> np.uint64(32)
            valid = np.flatnonzero((places >= n) & (words != BEGIN))
            keys = key[valid]
            by_key = np.argsort(keys)
            keys, at = keys[by_key], valid[by_key]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            number = np.full(len(words), -1)
            number[at] = np.cumsum(new) - 1
            out.number.append(number)
            out.distinct.append(keys[starts])
            out.example.append(at[starts])
            out.counts.append(np.add.reduceat(learned[at].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64))
        return out


def _requests(order: int, slices: int):
    """Each chunk's distinct n-grams and their counts in it, divided by ranges of their keys."""

    schema = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = Grams.of(r["blob"], r["raw_size"], r["leads"], r["ended"], r["held"], order)
                own = [((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32) for keys in grams.distinct]
                # only the slices that the chunk has keys of, however many there are
                there = np.unique(np.concatenate([x[np.flatnonzero(np.diff(x, prepend=np.uint64(slices)))] for x in own]))
                cuts = [(np.searchsorted(x, there).tolist(), np.searchsorted(x, there, "right").tolist()) for x in own]
                rows = []
                for k, number in enumerate(there.tolist()):
                    parts = [slice(low[k], high[k]) for low, high in cuts]
                    steps = [np.diff(keys[p], prepend=np.uint64(0)) for keys, p in zip(grams.distinct, parts, strict=True)]
                    counts = [c[p] for c, p in zip(grams.counts, parts, strict=True)]
                    rows.append({"slice": number, "chunk": r["chunk"], "sizes": [p.stop - p.start for p in parts], "keys": _pack(np.concatenate(steps)), "counts": _pack(np.concatenate(counts))})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _replies(order: int):
    """All chunks' counts of the keys of a slice, sent back to each chunk in the order of its own keys.

    A row without a chunk says how many different words the slice knows.
    """
    schema = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("sizes", pa.list_(pa.int32())), ("counts", pa.binary()), ("known", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = np.array(table["sizes"].to_pylist(), np.int64).reshape(table.num_rows, order)
        ends = np.cumsum(sizes, axis=1)
        keys, counts = ([_unpack(x) for x in table[c].to_pylist()] for c in ("keys", "counts"))
        totals: list[list[np.ndarray]] = [[] for _ in keys]
        known = 0
        for n in range(order):
            parts = [slice(e[n] - s[n], e[n]) for e, s in zip(ends, sizes, strict=True)]
            own = np.concatenate([np.cumsum(k[p], dtype=np.uint64) for k, p in zip(keys, parts, strict=True)])
            _, at = np.unique(own, return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([c[p] for c, p in zip(counts, parts, strict=True)]).astype(float))
            if n == 0:
                known = int((sums > 0).sum())
            place = 0
            for k, s in enumerate(sizes[:, n].tolist()):
                totals[k].append(sums[at[place : place + s]])
                place += s
        rows = [{"chunk": c, "slice": key[0].as_py(), "sizes": s, "counts": _pack(np.concatenate(t)), "known": None} for c, s, t in zip(table["chunk"].to_pylist(), sizes.tolist(), totals, strict=True)]
        return pa.Table.from_pylist([*rows, {"chunk": None, "slice": key[0].as_py(), "sizes": [], "counts": b"", "known": known}], schema=schema)

    return run


class Automaton:
    """States are the contexts known from the corpus: the empty one, the beginning of a text, and runs of words.

    Where a text has come to, a state is told by the length of its context, and its arc for the next word by the n-gram of
    the context and that word. Of each n-gram that is known there is an arc, with a log10 probability (``logs``) and the
    length of the context it leads to (``after``); the empty state has one for every word. Where a state has no arc for a
    word, its failure arc leads to its context without the first word, at the cost of ``back``.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, known: int, strength: tuple[float, ...]):
        order = len(counts)
        ends = grams.number[0][np.flatnonzero(grams.words == END)[:1]]
        #: every text that is learned from has one end, and so one beginning
        begun = float(counts[0][ends[0]]) if len(ends) else 0.0
        prior = lambda n: strength[min(n, len(strength)) - 1]  # noqa: E731  of n-grams of n + 1 words
        weight = lambda times, n: np.log10(prior(n) / (times + prior(n)))
        self.grams, self.order = grams, order
        self.base = (counts[0] + 0.5) / (total + 0.5 * (known + 1))
        self.begin = 1 if begun and order > 1 else 0
        self.back_begin = float(weight(begun, 1)) if order > 1 else 0.0
        self.known, self.logs, self.after, self.back = [], [], [], []
        lower = self.base
        for n in range(order):
            at = grams.example[n]
            chance = self.base
            if n:
                is_begin = grams.words[at - 1] == BEGIN
                times = np.where(is_begin, begun if n == 1 else 0.0, counts[n - 1][np.where(is_begin, 0, grams.number[n - 1][at - 1])])
                chance = (counts[n] + prior(n) * lower[grams.number[n - 1][at]]) / (times + prior(n))
            is_state = (counts[n] > 0) & (grams.words[at] != END)
            self.known.append(np.ones(len(at), bool) if n == 0 else counts[n] > 0)
            self.logs.append(np.log10(chance))
            self.after.append(np.where(is_state, min(n + 1, order - 1), 0))
            self.back.append(weight(counts[n], n + 1))
            lower = chance

    def score(self, start: int, stop: int, lead: int) -> float:
        """Walk from left to right over the tokens [start, stop), adding up what comes after the lead, or after BEGIN."""
        first = start + (0 if lead else 1)
        own, before = slice(first, stop), slice(max(first - 1, 0), stop - 1)
        arcs, backs = [], [[]]
        for n in range(self.order):
            number = self.grams.number[n][own]
            there = (number >= 0) & self.known[n][number]
            arcs.append(list(zip(np.where(there, self.logs[n][number], np.nan).tolist(), np.where(there, self.after[n][number], -1).tolist(), strict=True)))
            if n < self.order - 1:
                context = self.grams.number[n][before] if first else np.concatenate(([-1], self.grams.number[n][before]))
                backs.append(np.where(context >= 0, self.back[n][context], self.back_begin).tolist())
        total, length = 0.0, 0 if lead else self.begin
        for k in range(stop - first):
            log, after = arcs[length][k]
            while after < 0:
                total += backs[length][k]
                length -= 1
                log, after = arcs[length][k]
            length = after
            total += log
            if k == lead - 1:
                total = 0.0
        return total


def _score(order: int, total: int, known: int, strength: tuple[float, ...]):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(text: pa.Table, replies: pa.Table) -> pa.Table:
        r = text.to_pylist()[0]
        grams = Grams.of(r["blob"], r["raw_size"], r["leads"], r["ended"], r["held"], order)
        parts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for x in replies.sort_by("slice").to_pylist():
            own, place = _unpack(x["counts"]), 0
            for n, s in enumerate(x["sizes"]):
                parts[n].append(own[place : place + s])
                place += s
        counts = [np.concatenate(p).astype(np.int64) for p in parts]
        automaton = Automaton(grams, counts, total, known, strength)
        each = grams.number[0]
        lines, scored = len(r["rows"]), grams.scored
        sums = lambda x: np.bincount(grams.line[scored], weights=x[scored], minlength=lines)
        base = sums(np.log10(automaton.base)[each])
        sizes = np.bincount(grams.line, minlength=lines)
        scores, place = [], 0
        for size, lead in zip(sizes.tolist(), r["leads"], strict=True):
            scores.append(automaton.score(place, place + size, lead))
            place += size
        columns = (r["rows"], r["ids"], r["held"], sums(np.ones(len(each))).astype(np.int64), sums((counts[0] > 0)[each]).astype(np.int64), base, scores)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score_documents(docs: DataFrame, order: int = ORDER, strength: tuple[float, ...] = STRENGTH) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Tokens are the words of the whole text, A to Z lower-cased, and one end. The model is learned from the rows that aren't
    held out: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), h' being h without its first word, down to the smoothed share of
    the single word, which base_score adds up. As m p(w | h') / (c(h) + m) is a failure arc's weight times the lower order,
    the model is a backoff automaton, and a text's score is what one walk from left to right adds up.

    Counts cover the whole corpus and are never held in one place. Documents are gathered into chunks of ``CHUNK`` bytes;
    each sends its distinct n-grams, with their counts in it, to slices of the range of 64-bit keys, which follow the number
    of tokens; a slice sums them over all chunks and answers each. From the answers a chunk builds the part of the automaton
    that its own texts can reach, and walks it. A word that half the corpus holds reaches its slice once from each chunk.

    Null and empty texts consist of their end. A null doc_id hashes as the empty string; repeated rows count and are scored
    each for itself. Other columns are not used. An empty table gives an empty one.
    """
    pieces = stage(chunks(docs, order), "lm-chunks")
    size = pieces.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("raw_size"), F.lit(0))).first()
    slices = max(1, math.ceil(size[1] / 6 * order / SLICE))
    asked = pieces.select("chunk", "blob", "raw_size", "leads", "ended", "held").mapInArrow(_requests(order, slices), "slice int, chunk long, sizes array<int>, keys binary, counts binary")
    answered = asked.groupBy("slice").applyInArrow(_replies(order), "chunk long, slice int, sizes array<int>, counts binary, known long")
    replies = stage(answered, "lm-counts")
    known = replies.where("chunk is null").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    texts = pieces.drop("train_tokens").groupBy("chunk")
    scored = texts.cogroup(replies.where("chunk is not null").select("chunk", "slice", "sizes", "counts").groupBy("chunk"))
    parts = scored.applyInArrow(_score(order, size[0], known, strength), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = {c: F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")}
    out = stage(parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums.values()), "lm-scores")
    release(pieces, replies)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size[0]).cast("long").alias("train_tokens"), "base_score", "score")
