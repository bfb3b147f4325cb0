"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .components import connected_components
from .staging import reads, release, stage

WIDTH = 4
RADIUS = 4
SEED = 42
#: Buckets of up to so many different fingerprints are compared in place; larger ones go by shared neighbours.
BUCKET = 256


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned number; 0 for a text without words.

    Words are runs of anything but ASCII white space, after A-Z are lower-cased. A text of fewer than ``width`` words
    is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, n, step):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[k : min(k + step, n)].tolist(), last[k : k + step].tolist(), strict=True)], np.uint64)
        set_bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; fp holds the 64 bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 bit masks such that any two words within ``radius`` bits agree on all bits of some mask.

    Bit i gets a non-zero vector of radius+1 binary digits, and mask v holds the bits whose vector has an odd inner
    product with v. ``radius`` differing bits span less than the whole space, so some v is orthogonal to all of them.
    """
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(((code & v).bit_count() & 1) << i for i, code in enumerate(codes)) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(radius: int):
    """Links inside each bucket: every member to the smallest member of its group within the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            two = ends[sizes == 2]
            a, b = flat[two - 2], flat[two - 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            left, right = [a[near]], [b[near]]
            for end, size in zip(ends[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = np.sort(flat[end - size : end])
                near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
                label = np.arange(size)
                while True:
                    lower = np.where(near, label[None, :], size).min(1)
                    lower = lower[lower]
                    if (lower == label).all():
                        break
                    label = lower
                left.append(own[label != np.arange(size)])
                right.append(own[label[label != np.arange(size)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], ["a", "b"])

    return run


def _neighbours(masks: list[int], radius: int):
    """For each member of a large bucket, every word within radius/2 bits of it that agrees with it on the mask."""
    half = (radius + 1) // 2
    flips = []
    for mask in masks:
        free = [np.uint64(1 << i) for i in range(64) if not mask >> i & 1]
        layer = {0}
        seen = {0}
        for _ in range(half):
            layer = {x ^ int(bit) for x in layer for bit in free} - seen
            seen |= layer
        flips.append(np.array(sorted(seen), np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), strict=True):
                around = (flips[table] ^ np.int64(fp).view(np.uint64)).view(np.int64)
                n = len(around)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, table, np.int32)), pa.array(around), pa.array(np.full(n, fp, np.int64))], ["t", "near", "fp"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` links that connect the fingerprints of ``distinct.fp`` exactly as all pairs within ``radius`` bits do.

    Every fingerprint enters one bucket per covering mask. A bucket of at most ``bucket`` different fingerprints is
    compared in place. A larger one isn't compared pair by pair: its members are dealt out again by the words within
    half the radius of them. Members that meet at such a word are within the radius of each other, and any two that
    are meet at one, so the links stay exact and grow in proportion to the members. The sizes of all buckets are joined by
    merging, as a broadcast of them would have to fit the driver.
    """
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(keyed.join(sizes.hint("merge"), ["t", "key"]), "simhash-buckets")
    small = members.where(F.col("size") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = small.mapInArrow(_compare(radius), "a long, b long")
    if radius % 2:
        raise ValueError("an even radius is needed to split large buckets by shared neighbours")
    spread = members.where(F.col("size") > bucket).repartition("t", "key", "fp").select("t", "fp").mapInArrow(_neighbours(masks, radius), "t int, near long, fp long")
    least = spread.groupBy("t", "near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread.join(least.hint("merge"), ["t", "near"]).where("fp != b").select(F.col("fp").alias("a"), "b")
    every = stage(found.union(met).distinct(), "simhash-links")
    release(members)
    return every


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, itself included.
    Equal fingerprints are linked, those of texts without words (all bits zero) like any other. Null texts count as
    empty. Rows that repeat a doc_id are each judged by their own text; a null doc_id never becomes a component_id
    unless its whole component has none. Other columns of ``docs`` are not used. An empty table gives an empty one.
    """
    marked = stage(fingerprints(docs, width), "simhash-fp")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = links(distinct, radius)
    labels = connected_components(found)
    release(found)
    placed = distinct.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = placed.join(least.hint("merge"), "component").select("fp", "component_id")
    return reads(marked.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id"), marked, labels)


def deduplicate(docs: DataFrame, width: int = minhash.WIDTH) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each near-duplicate group only the document of smallest doc_id.

    Near duplicates are texts whose sets of ``width``-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints come
    first: each text is held against the first of its SimHash group, by that exact test. As 64 bits don't bring most such
    texts close enough, MinHash bands then seek what is left (see minhash). doc_id is the key: rows that repeat one stay or
    go together. Rows without a doc_id stay, as they can't be told apart.
    """
    grouped = near_duplicates(docs)
    near = grouped.where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    near = stage(near, "simhash-near")
    release(grouped)
    found = minhash.groups(docs, width, near)
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("doc_id is not null and doc_id != least").select(F.col("doc_id").alias("_gone"))
    gone = stage(gone, "near-duplicates")
    release(near, found)
    return reads(docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti"), gone)


def hex64(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
