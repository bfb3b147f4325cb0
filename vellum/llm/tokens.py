"""Token ids in training order: packed sequences, a keyed permutation of their slots, and fixed-stride shards.

The documents are put in order of doc_id and text hash by range partitions, so the stream of ids, the sequences cut out of
it and the shards are the same however the input is split.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import release, shared_dir, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text into pieces before merging: contractions, letters, digits, other signs, white space. A fixed value of byte-level vocabularies.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that ends each document and fills the last sequence of a task; free in the vocabularies used.
END = 50256
LENGTH = 1024
PER_SHARD = 1024
KEY = 20_240_601
ROUNDS = 6
#: At most so many tasks write shards, each a range of them.
TASKS = 50_000
#: A text is encoded in pieces of about so many characters, cut before a space.
CUT = 200_000
#: Level of zstd for the ids on disk and in the shuffle.
LEVEL = 6
#: White space of Unicode in a run that is encoded apart from the pattern.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def load(vocabulary: str) -> bytes:
    """The vocabulary file as the driver reads it; its bytes (about a megabyte) go to the executors with the job."""
    with open(vocabulary, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=2)
def encoder(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _store(place: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")


def _encode_parts(code, text: str) -> Iterator[np.ndarray]:
    start = 0
    while start < len(text):
        end = start + CUT
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        yield np.array(code.encode_ordinary(text[start:end]), np.uint16)
        start = end


def encode(ranks_file: bytes, text: str | None) -> np.ndarray:
    """The token ids of a whole text, of any length.

    A very long text is cut before spaces that follow a non-space, where pieces begin anyway. White space of ``LONG_SPACE``
    signs and more, which the pattern can't be run on, is cut by what the pattern says of it: all of it is one piece but for
    its last sign, which goes on with the word behind it; at the end of the text all of it is.
    """
    text, start, out = text or "", 0, []
    code = encoder(ranks_file)
    for run in LONG_SPACE.finditer(text):
        out += _encode_parts(code, text[start : run.start()])
        start = run.end() - (1 if run.end() < len(text) else 0)
        out.append(np.array(code._encode_single_piece(text[run.start() : start]), np.uint16))
    out += _encode_parts(code, text[start:])
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def feistel(index: np.ndarray, total: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..total-1: a balanced Feistel network on the next even number of bits; a value that
    falls outside walks on along its cycle until it is inside, which takes fewer than four steps on average."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") | 1) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + np.uint64(1)) * k
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + k
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(total))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _encode_range(shared, end_id: int):
    """Each text of a task to its ids and the place of the first of them among all ids of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                docs, texts = (batch.column(i).slice(low, 256) for i in (0, 1))
                ids = [np.append(encode(shared.value, t), np.uint16(end_id)) for t in texts.to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                places = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), task, np.int32)), pa.array(places), pa.array(sizes), docs, pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["task", "place", "size", "doc_id", "tokens"])

    return run


def stream(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END) -> tuple[DataFrame, DataFrame]:
    """The staged table behind it, and ``(at, size, doc_id, tokens)``: the ids of each row, ended by ``end_id``, and their place
    in the stream of all ids.

    The stream is in order of doc_id (null first), then of the text's hash; rows equal in both are the same ids. Range
    partitions are encoded in that order, each with places of its own, and the partitions' sizes, one row for each, give
    where it begins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    encoded = stage(ordered.select("doc_id", "text").mapInArrow(_encode_range(shared, end_id), "task int, place long, size long, doc_id long, tokens binary"), "stream", LEVEL)
    sums = encoded.groupBy("task").agg(F.sum("size").alias("n"))
    before = sums.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    # one row of two numbers for each task that encoded, whatever the number of documents
    return encoded, encoded.join(F.broadcast(before), "task").select((F.col("before") + F.col("place")).alias("at"), "size", "doc_id", "tokens")


def _cut(total: int, length: int, per_shard: int, key: int):
    """Rows of the stream to pieces of sequences, each with the slot of its sequence, packed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            at, size = (batch.column(i).to_numpy() for i in (0, 1))
            first, last = at // length, (at + size - 1) // length
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            begin, end = np.maximum(index * length, at[row]), np.minimum((index + 1) * length, at[row] + size[row])
            slot = feistel(index, total, key)
            for low in range(0, len(row), 4096):
                own = slice(low, low + 4096)
                pieces, held, view = [], -1, memoryview(b"")
                for r, b, e in zip(row[own].tolist(), (begin - at[row])[own].tolist(), (end - at[row])[own].tolist(), strict=True):
                    if r != held:
                        held, view = r, memoryview(batch.column(3)[r].as_py())
                    pieces.append(pack.compress(view[2 * b : 2 * e]))
                yield pa.RecordBatch.from_arrays([pa.array(slot[own] // per_shard), pa.array(slot[own]), pa.array((begin - index * length)[own].astype(np.int32)), batch.column(2).take(pa.array(row[own])), pa.array(pieces, pa.binary())], ["shard", "slot", "start", "doc_id", "tokens"])

    return run


MANIFEST = "shard long, first_slot long, records int, stride int, path string, sha256 string, doc_ids array<long>, parts array<struct<slot: long, doc_id: long, start: int, size: int>>"


def _write(folder: str, length: int, per_shard: int, end_id: int):
    """One file for each shard, from its pieces in order of slot and start.

    A file is written under a name of its own attempt and then moved, so a task that is run again replaces it whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, rows = None, []

        def close() -> pa.RecordBatch:
            first = shard * per_shard
            slots = sorted({r[0] for r in rows})
            name = f"{base}/shard-{shard:08d}.bin"
            payload = _padded(rows, length, end_id)
            if slots != list(range(first, first + len(slots))) or len(payload) != 2 * length * len(slots):
                raise RuntimeError(f"shard {shard} has a gap or a repeated slot")
            with store.open_output_stream(f"{name}.{attempt}") as out:
                out.write(payload)
            store.move(f"{name}.{attempt}", name)
            parts = [{"slot": s, "doc_id": d, "start": b, "size": len(t) // 2} for s, b, d, t in rows]
            ids = sorted({d for _, _, d, _ in rows if d is not None})
            values = (shard, first, len(slots), 2 * length, f"{folder}/shard-{shard:08d}.bin", hashlib.sha256(payload).hexdigest(), ids, parts)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("slot", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "first_slot", "records", "stride", "path", "sha256", "doc_ids", "parts"])

        for batch in batches:
            for own, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != shard:
                    if rows:
                        yield close()
                    shard, rows = own, []
                rows.append([*row[:3], unpack.decompress(row[3])])
        if rows:
            yield close()

    return run


def _padded(rows: list[list], length: int, end_id: int) -> bytes:
    """The pieces one after the other; the sequence that the stream ends in is filled up with ``end_id``."""
    out, used = [], 0
    for place, (slot, start, _, piece) in enumerate(rows):
        if start != used:
            raise RuntimeError(f"slot {slot} has a gap")
        out.append(piece)
        used += len(piece) // 2
        if place + 1 == len(rows) or rows[place + 1][0] != slot:
            out.append(np.full(length - used, end_id, "<u2").tobytes())
            used = 0
    return b"".join(out)


def training_order(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END) -> DataFrame:
    """Write the shards of the training order under ``folder`` and return their manifest, one row for each:
    ``(shard, first_slot, records, stride, path, sha256, doc_ids, parts)``.

    The stream of ids is cut into sequences of ``length``; each gets the slot that the keyed permutation gives its index.
    Shard s holds the slots from s * per_shard on, as ``records`` records of ``stride`` bytes (little-endian 16-bit ids) one
    after the other, so slot k is at byte (k - first_slot) * stride and reading resumes at any slot. parts names the
    stretches of documents (slot, doc_id, start and size in ids), doc_ids the documents. Shards are dealt by their number,
    each as its own bounded group. ``folder`` is a path or URI that every executor reaches, by default a new one in the
    shared folder. The manifest is staged, so the files are written once.

    Null and empty texts are a single end id; rows that repeat a doc_id are each packed; null doc_ids stay null. Other
    columns of ``docs`` are not used. The same rows give the same shards however they are split. An empty table gives none.
    """
    spark = docs.sparkSession
    encoded, table = stream(docs, vocabulary, end_id)
    ids = table.agg(F.max(F.col("at") + F.col("size"))).first()[0]
    if not ids:
        return spark.createDataFrame([], MANIFEST)
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    total = -(-ids // length)
    shards = -(-total // per_shard)
    pieces = table.mapInArrow(_cut(total, length, per_shard, key), "shard long, slot long, start int, doc_id long, tokens binary")
    # one partition for each range of shards: the partition id is given, so no sampling and no clashes of hashes
    each = -(-shards // TASKS)
    dealt = pieces.repartitionById(-(-shards // each), F.expr(f"int(shard div {each})")).sortWithinPartitions("shard", "slot", "start")
    written = stage(dealt.mapInArrow(_write(folder, length, per_shard, end_id), MANIFEST), "shard-manifest")
    release(encoded)
    return written


def read_slots(path: str, first_slot: int, stride: int, start: int, stop: int) -> np.ndarray:
    """The ids of slots start..stop-1 of one shard file, by one seek; ``path`` is as the manifest names it."""
    store, place = _store(path)
    with store.open_input_file(place) as file:
        return np.frombuffer(file.read_at((stop - start) * stride, (start - first_slot) * stride), "<u2").reshape(-1, stride // 2)
