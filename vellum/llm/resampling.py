"""Importance resampling of documents towards a target distribution, over hashed word n-grams."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

BUCKETS = 10_000
ORDERS = 3
SEED = 42
#: Documents of fewer words take no part in the draw.
LEAST_WORDS = 20
#: So many hundredths of them are drawn.
SHARE = 5
#: Features of one row of the packed stream; a longer document has a row for itself.
ROW = 1 << 20
#: Words of a text that are hashed at once.
SLICE = 1 << 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STREAM = "ids array<bigint>, offsets array<bigint>, words array<bigint>, stream binary"


def _buckets(text: str | None) -> tuple[int, list[np.ndarray]]:
    """The number of words of a text and the buckets of its runs of 1 to 3 words, packed as uint16.

    A run's CRC continues that of the run without its last word, so no run is joined into a string.
    """
    words = _WORD.findall((text or "").encode("utf-8", "replace").lower())
    crc, parts = zlib.crc32, []
    for k in range(0, len(words), SLICE):
        one = words[k : k + SLICE + ORDERS - 1]
        own = min(SLICE, len(words) - k)
        runs = [crc(w) for w in one]
        parts.append(np.array(runs[:own], np.uint32))
        tails = [b" " + w for w in one]
        for n in range(1, ORDERS):
            runs = [crc(w, c) for c, w in zip(runs, tails[n:], strict=False)]
            parts.append(np.array(runs[:own], np.uint32))
    return len(words), [(p % BUCKETS).astype("<u2") for p in parts]


def packed(docs: DataFrame) -> DataFrame:
    """Rows of packed bucket streams: the ids of some documents, where each one's features begin, their words, the uint16s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, words, parts, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            stream = np.concatenate(parts).tobytes() if parts else b""
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([ids], kind), pa.array([offsets], kind), pa.array([words], kind), pa.array([stream], pa.binary())], ["ids", "offsets", "words", "stream"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, own = _buckets(text)
                ids.append(doc_id)
                offsets.append(size)
                words.append(n)
                parts += own
                size += sum(map(len, own))
                if size >= ROW or len(ids) >= ROW:
                    yield row()
                    ids, offsets, words, parts, size = [], [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STREAM)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's stream sorted and run-length encoded: (bucket, n)."""
    for batch in batches:
        for raw in batch.column(0):
            own = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            lengths = np.diff(np.concatenate((starts, [len(own)]))) if len(own) else starts
            yield pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array(lengths.astype(np.int64))], ["bucket", "n"])


def bucket_counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all streams: runs are merged by a sum, and one row for each bucket reaches the driver."""
    found = streams.select("stream").mapInArrow(_run_lengths, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the document's id alone."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(table: np.ndarray):
    """Gather the gains of each stream and sum them between the documents' offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, starts, words = batch.column(0)[k].as_py(), np.array(batch.column(1)[k].as_py(), np.int64), batch.column(2)[k].values
                stream = np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")
                sizes = np.diff(np.concatenate((starts, [len(stream)])))
                weights = np.zeros(len(starts), np.int64)
                full = sizes > 0  # reduceat would give an empty document its neighbour's first gain
                if full.any():
                    weights[full] = np.add.reduceat(table[stream], starts[full])
                scores = weights + np.array([_noise(i) for i in ids], np.int64)
                for a in range(0, len(ids), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(sizes[part]), pa.array(weights[part]), pa.array(scores[part]), words[part]], ["doc_id", "n_features", "weight", "score", "words"])

    return run


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``; rank numbers the drawn ones from 1.

    Words are runs of digits, letters a to z (A to Z lower-cased) and anything beyond ASCII. Each document's features are
    hashed once into a packed stream in the shared folder. Streams are sorted and run-length encoded row by row, the runs
    of all rows merged by a Spark sum into at most ``BUCKETS`` counts, and the gains, a table of the same size, go back to
    gather and sum them between the documents' offsets.

    The draw is the ``share`` hundredths of highest score among the documents of ``least_words`` words or more. Scores are
    dealt out by range, so a row's rank is its place in its range plus the rows of the ranges before; only the number of
    rows of each range is gathered. Null texts have no words, no features and weight 0. A null doc_id has the noise of the
    empty string and ranks behind others of its score. Rows that repeat a doc_id are each drawn or not by their own text.
    Other columns are not used; without a target all t are 0; an empty table gives an empty one.
    """
    streams = stage(packed(docs), "resampling-streams")
    table = gains(bucket_counts(streams), bucket_counts(packed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))))
    scored = stage(streams.mapInArrow(_weigh(table), "doc_id long, n_features long, weight long, score long, words long"), "resampling-scores")
    enough = F.col("words") >= least_words
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    dealt = scored.where(enough).drop("words").repartitionByRange(*order).sortWithinPartitions(*order)
    # the id's high bits name the range, its low 33 bits the place in it
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "resampling-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ranges = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    ranges = ranges.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + place + 1
    # as many rows as the range exchange has partitions: a bound that the tables don't set
    ranked = placed.withColumn("_part", part).join(F.broadcast(ranges), "_part").withColumn("rank", F.when(rank <= F.floor(F.col("_all") * share / 100), rank))
    few = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked.select(*columns).union(few.select(*columns))
