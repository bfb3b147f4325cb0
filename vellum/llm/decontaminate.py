"""Benchmark passages in documents: q-gram lemma filtering over diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Length of the counted q-grams, and the edit budget as a share of a passage's length.
Q = 8
EDITS = 0.1
#: Length of the q-grams that a region must share as well, before it is aligned.
FINE = 4
#: So many characters of benchmark text are held in a task at once; more are taken block by block.
BLOCK = 4_000_000
BITS = 20
CHUNK = 1 << 18
#: So many pairs of equal q-grams are held at once while bands are counted.
PAIRS = 1 << 20


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each of the q-grams; q is a power of two, and each step joins the hashes of two neighbouring halves."""
    h = codes.astype(np.uint64)
    size = 1
    while size < q:
        h = (h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]) * np.uint64(0xC2B2AE3D27D4EB4F) if len(h) > size else h[:0]
        h ^= h >> np.uint64(32)
        size *= 2
    return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """All q-grams of one block of passages, with where they occur, and what each passage needs to be a hit."""

    q: int
    ids: list[int]
    texts: list[str]
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    maybe: np.ndarray
    short: list[int]
    fine: list[np.ndarray]


def build_index(items: list[tuple[int, str | None]], q: int = Q, edits: float = EDITS) -> Index:
    """A passage of m characters may take floor(edits * m) edits, fewer where the lemma would then ask for no q-gram at
    all: two texts within e edits share at least m + 1 - q - q * e q-grams. One shorter than q must occur verbatim."""
    texts = [normalise(t) for _, t in items]
    length = np.array([len(t) for t in texts], np.int64)
    budget = np.maximum(0, np.minimum((length * edits).astype(np.int64), (length - q) // q))
    hashes = [_hashes(_codes(t), q) for t in texts]
    item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
    every = np.concatenate(hashes or [np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    keys, first, count = np.unique(every[order], return_index=True, return_counts=True)
    maybe = np.zeros(1 << BITS, bool)
    maybe[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    short = [i for i, t in enumerate(texts) if 0 < len(t) < q]
    return Index(q, [i for i, _ in items], texts, keys, first, count, item[order], offset[order], length, budget, np.maximum(1, length + 1 - q - q * budget), maybe, short, [_hashes(_codes(t), FINE) for t in texts])


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits, and the end in ``text``, of the pattern against any substring, over the diagonals low..high only."""
    far, width = 1 << 20, high - low + 1
    lanes = np.arange(width)
    inner = range(max(0, -low), len(text) - high + 1)
    padded = np.full(len(pattern) + high - min(low, 0) + 1, 0xFFFFFFFF, np.uint32)
    shift = -min(low, 0)
    padded[shift : shift + len(text)] = text[: len(padded) - shift]
    outside = lambda i: ((lanes + low + i) < 0) | ((lanes + low + i) > len(text))
    row = np.where(outside(0), far, 0)
    for i in range(1, len(pattern) + 1):
        at = low + i - 1 + shift
        take = row + (padded[at : at + width] != pattern[i - 1])
        take[:-1] = np.minimum(take[:-1], row[1:] + 1)
        row = np.minimum.accumulate(take - lanes) + lanes
        if i not in inner:
            row[outside(i)] = far
    best = int(row.argmin())
    return int(row[best]), best + low + len(pattern)


def _bands(index: Index, spot: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(item, band, hits)``: pairs of equal q-grams per passage and band of diagonals. Two bands overlap at each diagonal, so
    hits whose diagonals differ by the budget at most share one.

    A text that repeats a q-gram which a passage repeats too has as many pairs as the product, so they are formed and
    counted PAIRS at a time, and a q-gram of more places than that in parts of them. What is kept grows with the bands only.
    """
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def count(spots: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = index.item[place], np.repeat(spots, n) - index.offset[place]
        band = diagonal // (index.budget[item] + 1)
        key, hits = np.unique(item * (1 << 40) + band + (1 << 39), return_counts=True)
        keys.append(key)
        sums.append(hits)
        if len(keys) > 16:
            merge()

    def merge() -> None:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        hits = np.zeros(len(key), np.int64)
        np.add.at(hits, at, np.concatenate(sums))
        keys[:], sums[:] = [key], [hits]

    n, first = index.count[gram], index.first[gram]
    for start in range(0, int(n.max()), PAIRS):
        more = n > start
        own, begin, size = spot[more], first[more] + start, np.minimum(n[more] - start, PAIRS)
        total = np.cumsum(size)
        for low in range(0, int(total[-1]), PAIRS):
            part = slice(int(np.searchsorted(total, low, "right")), int(np.searchsorted(total, low + PAIRS, "right")))
            if part.start < part.stop:
                count(own[part], begin[part], size[part])
    merge()
    # a diagonal of band b counts for b and for b - 1
    key, hits = np.concatenate([keys[0], keys[0] - 1]), np.concatenate([sums[0], sums[0]])
    keys[:], sums[:] = [key], [hits]
    merge()
    return keys[0] >> 40, (keys[0] & ((1 << 40) - 1)) - (1 << 39), sums[0]


def search(index: Index, text: str | None) -> list[tuple[int, int, int]]:
    """``(item number, end, edits)`` of each passage that occurs in the whole text, at its best place."""
    text = normalise(text)
    best: dict[int, tuple[int, int]] = {i: (0, at + len(index.texts[i])) for i in index.short if (at := text.find(index.texts[i])) >= 0}
    codes = _codes(text)
    spots, grams = [], []
    for start in range(0, max(0, len(codes) - index.q + 1), CHUNK):
        h = _hashes(codes[start : start + CHUNK + index.q - 1], index.q)
        at = np.flatnonzero(index.maybe[(h >> np.uint64(64 - BITS)).view(np.int64)])
        if len(at) and len(index.keys):
            found = np.minimum(np.searchsorted(index.keys, h[at]), len(index.keys) - 1)
            same = index.keys[found] == h[at]
            spots.append(at[same] + start)
            grams.append(found[same])
    if not spots or not sum(map(len, spots)):
        return [(i, end, d) for i, (d, end) in best.items()]
    item, band, hits = _bands(index, np.concatenate(spots), np.concatenate(grams))
    enough = hits >= index.least[item]
    for i, b in zip(item[enough].tolist(), band[enough].tolist(), strict=True):
        e, m = int(index.budget[i]), int(index.length[i])
        if i in best and best[i][0] == 0:
            continue
        low, high = b * (e + 1) - e, b * (e + 1) + 2 * (e + 1) + e
        start = max(0, low)
        if (at := text.find(index.texts[i], start, high + m)) >= 0:
            best[i] = (0, at + m)
        elif e:
            region = codes[start : high + m + e]
            if np.isin(index.fine[i], _hashes(region, FINE)).sum() < m + 1 - FINE - FINE * e:
                continue
            edits, end = align(_codes(index.texts[i]), region, low - start, high - start)
            if edits <= e and (i not in best or edits < best[i][0]):
                best[i] = (edits, start + end)
    return [(i, end, d) for i, (d, end) in best.items()]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The passages in blocks of bounded size; the driver holds one block at a time."""
    items, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        if items and held + len(row[1] or "") > block:
            yield items
            items, held = [], 0
        items.append((row[0], row[1]))
        held += len(row[1] or "")
    if items:
        yield items


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, end, edits)``: one row per row of ``docs`` and passage that occurs in it.

    A passage occurs where some substring of the whole text is within its edit budget, both in lower case with white
    space runs as one space; ``end`` and ``edits`` are those of its best such place, ``end`` counting characters of that
    form. Null and empty texts and passages are never hits; repeated rows each give their own rows. The passages are the
    stated query set: blocks of them, of at most ``block`` characters, pass the driver and are broadcast one after the other,
    each against all documents, so memory doesn't grow with their number. Other columns are not used; empty tables give an
    empty result.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema, parts = "doc_id long, item_id long, end long, edits int", []
    for items in _blocks(benchmark, block):
        shared = sc.broadcast(build_index(items, q, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(doc, index.ids[i], end, d) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, end, d in search(index, text)]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "end", "edits"])

        # the hits are written, so that one block is held at a time wherever the job runs
        parts.append(stage(texts.mapInArrow(run, schema), "passage-hits"))
        shared.unpersist()
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(search(shared.value, t)) for t in texts], dtype="bool")

    return hit


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, in which no passage occurs (see find_passages). Rows of null and empty texts stay, as
    does every row where there is no passage; repeated rows go or stay alike, each by its own text."""
    sc = docs.sparkSession.sparkContext
    for place, items in enumerate(_blocks(benchmark, block)):
        if place:
            docs = stage(docs, "passage-free")
        docs = docs.where(~_hit(sc.broadcast(build_index(items, q, edits)))(F.col("text").cast("string")))
    return docs
