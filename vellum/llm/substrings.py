"""Exact removal of repeated passages by bucket-pointer refinement over sampled suffixes.

A suffix array of the whole corpus, refined by bucket pointers, would order every byte position. Here only positions
that can begin a comparison are kept: in every window of ``length`` bytes the q-gram of least hash is its anchor, which
equal windows share. The anchors fall into initial q-gram buckets, and buckets with one member are done. Each of the
others is refined: its members are sorted apart by the bytes at later and earlier offsets, for blocks of windows that get
finer from step to step. What a step leaves together gets a new bucket pointer, the least member of the new bucket, and
the next step compares only members of one pointer. Bytes are compared by 128-bit BLAKE2 digests of them, which no two
different strings of a corpus share in practice. Buckets are aggregated, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage

LENGTH = 400
Q = 128
#: Numbers of windows that are compared at once, from step to step.
BLOCKS = (64, 16, 4, 1)
CHUNK = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _A + right) * _B
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of each of the q-grams; q is a power of two."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < q:
        h = _join(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    return h


def _digest(data, salt: bytes = b"") -> bytes:
    """128 bits that stand for the bytes (and the salt)."""
    return hashlib.blake2b(data, digest_size=16, key=salt).digest()


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    n = len(key) - w + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, q: int = Q) -> Iterator[tuple[np.ndarray, ...]]:
    """``(bucket, anchor, first, last, name)`` of the anchors of a text: the windows first..last have that anchor, the
    bucket is its q-gram, and the name identifies all bytes of those windows. Among equal q-grams the leftmost counts."""
    codes = np.frombuffer(data, np.uint8)
    low = np.uint64((1 << 20) - 1)
    for start in range(0, max(0, len(codes) - length + 1), CHUNK):
        part = codes[start : start + CHUNK + length - 1]
        grams = gram_hashes(part, q)
        least = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        name = [
            _digest(part[f : l + length], bytes(f"{a - f}:{l - f}", "ascii"))
            for f, l, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)
        ]
        yield grams[anchor], anchor + start, first + start, last + start, name


def _check(length: int, q: int) -> None:
    if q & (q - 1) or not 0 < q <= length:
        raise ValueError(f"q-grams of {q} bytes don't suit strings of {length}")


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _buckets_only(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[0] for data in _bytes(batch.column(0).to_pylist()) for x in anchors(data, length, q)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["bucket"])

    return run


def _anchors(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, data in enumerate(_bytes(batch.column(2).to_pylist())):
                for x in anchors(data, length, q):
                    found.append(x)
                    rows.append(np.full(len(x[0]), i))
            if not found:
                continue
            bucket, anchor, first, last = (np.concatenate([x[i] for x in found]) for i in range(4))
            name = pa.array([n for x in found for n in x[4]], pa.binary())
            of = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(bucket.view(np.int64)), name, pa.array(anchor.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                ["doc_id", "digest", "bucket", "name", "anchor", "first", "last"],
            )

    return run


def _contexts(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each listed anchor that its windows can reach, and how many of them lie before it."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, digest, text, listed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in listed:
                left = min(length - q, x["anchor"])
                for column, value in zip(out, (doc, digest, x["bucket"], x["anchor"], left, data[x["anchor"] - left : x["anchor"] + length]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for i in range(0, len(out[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "digest", "bucket", "anchor", "left", "context"])


def _compare(size: int, length: int, q: int):
    """Digests of the blocks of ``size`` windows at each context: of all bytes that any of them covers (span) and of those
    that every one covers (core). Window o begins o bytes before the anchor. Blocks that reach beyond the text are marked
    as open, without digests; those wholly outside it go."""
    most = length - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for rid, left, text, blocks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                low, high = max(0, length - (len(text) - left)), left
                for block in blocks:
                    x = block["x"]
                    y = min(x + size - 1, most)
                    if x > high or y < low:
                        continue
                    open_ = x < low or y > high
                    span = core = None
                    if not open_:
                        span, core = _digest(text[left - y : left - x + length]), _digest(text[left - x : left - y + length])
                    for column, value in zip(out, (rid, block["pointer"], x, y, span, core, open_), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
            for k in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000], kind) for c, kind in zip(out, kinds, strict=True)], ["rid", "pointer", "x", "y", "span", "core", "open"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``(doc_id, digest, begin, end)``: byte ranges, possibly overlapping, that cover exactly the bytes of strings of
    ``length`` bytes that also start anywhere else. digest is xxhash64 of the text; with doc_id it names the row, and
    rows equal in both count as different places that repeat each other.

    What is joined to many rows of one bucket is written first, so that both sides of the join are plain shuffles of
    tables and adaptive execution can split the partition of a very common bucket."""
    _check(length, q)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    often = texts.select("text").mapInArrow(_buckets_only(length, q), "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    often = stage(often, "substring-often")
    schema = "doc_id long, digest long, bucket long, name binary, anchor int, first int, last int"
    shared = stage(texts.select("doc_id", "digest", "text").mapInArrow(_anchors(length, q), schema).join(often, "bucket"), "substring-anchors")

    release(often)
    classes = stage(shared.groupBy("bucket", "name").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "digest", "anchor")]), "substring-classes")
    equal = classes.where("n > 1").select("bucket", "name")
    found = shared.join(equal, ["bucket", "name"]).select("doc_id", "digest", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    found = stage(found, "substring-found")
    release(shared)

    mixed = stage(classes.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "substring-mixed")
    listed = classes.join(mixed, "bucket").groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(F.collect_list(F.struct("bucket", "anchor")).alias("listed"))
    near = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")))
    # of rows that are equal in doc_id and text, one stands for all
    context = near.select("doc_id", "digest", "text", "listed").mapInArrow(lambda b: _contexts(b, length, q), "doc_id long, digest long, bucket long, anchor int, left int, context binary")
    context = stage(context.dropDuplicates(["doc_id", "digest", "anchor"]).withColumn("rid", F.monotonically_increasing_id()), "substring-contexts")
    release(classes, mixed)

    most = length - q
    first_blocks = F.transform(F.lit(list(range(0, most + 1, BLOCKS[0]))), lambda x: F.struct(x.alias("x"), F.col("bucket").alias("pointer")))
    blocks = context.select("rid", "left", "context", first_blocks.alias("blocks"))
    place = context.select("rid", "doc_id", "digest", "anchor")
    parts = [found]
    for size, finer in zip(BLOCKS, (*BLOCKS[1:], 0), strict=True):
        rows = stage(blocks.mapInArrow(_compare(size, length, q), "rid long, pointer long, x int, y int, span binary, core binary, open boolean"), "substring-blocks")
        whole = rows.where("not open")
        spans = stage(whole.groupBy("pointer", "x", "core", "span").agg(F.count("*").alias("n"), F.min("rid").alias("rid")), "substring-block-classes")
        same = whole.join(spans.where("n > 1").select("pointer", "x", "core", "span"), ["pointer", "x", "core", "span"])
        same = same.select("rid", "x", "y").join(place, "rid").select("doc_id", "digest", (F.col("anchor") - F.col("y")).alias("begin"), (F.col("anchor") - F.col("x") + length).alias("end"))
        parts.append(stage(same, "substring-same"))
        if not finer:
            release(rows, spans, context)
            break
        # a block goes on where cores agree and spans don't; one member stands for each span, and the least one of all
        # that agree in the core is their new pointer. Where another block at the same place is open, it may match any of
        # them, so all of that place go on under the pointer they have.
        open_at = stage(rows.where("open").select("pointer", "x").distinct(), "substring-open")
        unlike = spans.groupBy("pointer", "x", "core").agg(F.count("*").alias("m"), F.min("rid").alias("next")).where("m > 1").drop("m")
        pointers = stage(unlike, "substring-pointers")
        refined = spans.join(pointers, ["pointer", "x", "core"]).join(open_at, ["pointer", "x"], "left_anti").select("rid", "x", F.col("next").alias("pointer"))
        kept = spans.join(open_at, ["pointer", "x"]).select("rid", "x", "pointer")
        down = refined.union(kept).union(rows.where("open").select("rid", "x", "pointer"))
        children = F.transform(F.sequence(F.lit(0), F.lit(size - finer), F.lit(finer)), lambda k: F.struct((F.col("x") + k).cast("int").alias("x"), F.col("pointer").alias("pointer")))
        children = stage(down.distinct().withColumn("b", F.explode(children)).where(F.col("b.x") <= most).select("rid", "b"), "substring-children")
        release(rows, spans, open_at, pointers)
        blocks = context.join(children.groupBy("rid").agg(F.collect_list("b").alias("blocks")), "rid").select("rid", "left", "context", "blocks")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, begins, ends in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
            data, merged = text.encode("utf-8", "surrogatepass"), []
            for begin, end in sorted(zip(begins or (), ends or (), strict=True)):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            kept, at = [], 0
            for begin, end in merged:
                kept.append(data[at:begin])
                at = end
            kept = b"".join([*kept, data[at:]])
            for column, value in zip(out, (len(data), len(data) - len(kept), merged, kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array([hashlib.sha256(k).hexdigest() for k in out[3]], pa.string()), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256, kept)`` for every row of ``docs``.

    Every byte is removed that lies in a string of ``length`` bytes which starts at any other place too, in the same or
    another text; spans lists the maximal removed runs as [begin, end) and kept holds the other bytes. Matches don't
    cross documents and are judged on the input. Null and empty texts have no bytes. Of rows that repeat a text, all
    lose it if it has ``length`` bytes; a null doc_id is a row like any other. Other columns are not used. An empty table
    gives an empty one.
    """
    spans = repeated_spans(docs, length, q).groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", F.col("ranges.begin").alias("begins"), F.col("ranges.end").alias("ends")).mapInArrow(_remove, schema)
