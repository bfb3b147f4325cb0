"""Near-duplicate groups by the Jaccard similarity of word shingles: MinHash candidates, each checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import reads, release, stage

WIDTH = 5
#: Two texts are near duplicates from this Jaccard similarity on, as a fraction so that the test is one of whole numbers.
SIMILARITY = (4, 5)
#: A pair of similarity s misses all bands with probability (1 - s^ROWS)^BANDS: 0.0004 at 0.8, below 1e-7 at 0.9.
BANDS, ROWS = 20, 5
SEED = 42
#: Rounds in which a bucket is held against one of its members, before the rest is compared pair by pair.
PIVOTS = 2
#: A task compares at most two tiles of about so many hashes (or one text that has more) with each other.
TILE = 1 << 20
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's shingles, with the words of ``simhash.fingerprint``.

    A text of fewer than ``width`` words is one shingle; one without words is the shingle of no word.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band: texts share it if their least hashes under all functions of the band are equal."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * _FACTORS + _TERMS).min(0))
    return [xxhash.xxh64_intdigest(band.tobytes(), t) for t, band in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def marks(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, set_id, n, keys)`` for every row of ``docs``: its set of shingles by hash and size, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, width)
                ids.append(set_id(own))
                sizes.append(len(own))
                keys += bands(own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(_signed(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(ids)), pa.array(sizes, pa.int64()), lists], ["doc_id", "set_id", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, set_id long, n long, keys array<long>")


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(set_id, hashes)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for k in range(0, len(texts), 64):
                own = [shingles(t, width) for t in texts[k : k + 64].to_pylist()]
                lists = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(_signed([set_id(x) for x in own])), lists], ["set_id", "hashes"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "set_id long, hashes array<long>")


def _similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach SIMILARITY: with i common of n and m shingles, i / (n + m - i) >= p / q."""
    p, q = SIMILARITY
    left, right = (known.select(F.col("set_id").alias(c), F.col("hashes").alias(f"_{c}")) for c in ("a", "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where((p + q) * common >= p * (F.size("_a") + F.size("_b"))).select("a", "b")


def common(lists: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    size = len(lists)
    row = np.repeat(np.arange(size), [len(x) for x in lists])
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((size, size), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    step = min(max(256, (1 << 22) // size), max(columns, 1))
    for low in range(0, columns, step):
        part = slice(*np.searchsorted(column, (low, low + step)))
        x = np.zeros((size, step), np.float32)
        x[row[part], column[part] - low] = 1
        out += x @ x.T
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each pair of tiles: every set to the first one of its group."""
    p, q = SIMILARITY
    for batch in batches:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, second, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = members.values
            ids, tile = own.field("set_id").to_numpy(), own.field("tile").to_numpy()
            flat, ends = own.field("hashes").flatten().to_numpy(), np.cumsum(pc.list_value_length(own.field("hashes")).to_numpy())
            lists = np.split(flat, ends[:-1])
            n = np.array([len(x) for x in lists])
            near = (p + q) * common(lists) >= p * (n[:, None] + n[None, :])
            if first != second:
                near &= tile[:, None] != tile[None, :]
            label = np.arange(len(n))
            while True:
                lower = np.minimum(label, np.where(near, label[None, :], len(n)).min(1))
                lower = lower[lower]
                if (lower == label).all():
                    break
                label = lower
            rows = np.flatnonzero(label != np.arange(len(n)))
            left.append(ids[rows])
            right.append(ids[label[rows]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _sizes_allow(n: str, m: str) -> F.Column:
    p, q = SIMILARITY
    return q * F.least(n, m) >= p * F.greatest(n, m)


def groups(docs: DataFrame, width: int = WIDTH, candidates: DataFrame | None = None) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``; component_id is the smallest doc_id reachable over near duplicates.

    Texts of equal sets of shingles count as one. The others are candidates if they share a bucket, which is a band's
    key. In rounds, all members of a bucket are held against one of them: first the most central one, which lies in the
    largest buckets and so has the least changes of its own, then others picked by hash. Members that are in the pivot's
    component already are left out, and buckets of one component are done. Buckets that still lie apart after PIVOTS rounds are
    compared whole, tile by tile inside tasks, and only links leave a task, one for each member. So every candidate pair is
    either compared exactly or in one component. The work of that last step grows with the square of a bucket whose members
    are near the threshold to each other; rows and memory don't.

    Null and empty texts have the set of no word and are near duplicates of each other. Rows that repeat a doc_id are judged
    by their own texts; a null doc_id becomes a component_id only where its component has no other. An empty table gives
    an empty one; other columns are not used. ``candidates``, pairs ``(a, b)`` of doc_ids that another method found, are
    compared before the buckets, by the same exact test. Staged tables are deleted as soon as no later step reads them, and
    release() deletes the two that the result reads.
    """
    marked = stage(marks(docs, width), "minhash-marks")
    distinct = marked.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    keyed = distinct.select("set_id", "n", F.explode("keys").alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "minhash-sizes")
    members = stage(keyed.join(sizes, "key"), "minhash-buckets")
    release(sizes)
    central = members.groupBy("set_id").agg(F.sum("size").alias("central"))
    wanted = members.select("set_id")
    given = None
    if candidates is not None:
        side = lambda doc, name: marked.select(F.col("doc_id").alias(doc), F.col("set_id").alias(name), F.col("n").alias(f"_{name}"))
        met = candidates.join(side("a", "s"), "a").join(side("b", "t"), "b").where((F.col("s") != F.col("t")) & _sizes_allow("_s", "_t"))
        given = stage(met.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct(), "minhash-given")
        wanted = wanted.union(given.select("a")).union(given.select("b"))
    wanted = wanted.distinct()
    first = marked.groupBy("set_id").agg(F.min("doc_id").alias("_first")).join(wanted, "set_id").select("_first").distinct()
    known = stage(sets(docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi"), width), "minhash-sets")
    opened = stage(members.join(central, "set_id").select("key", "set_id", "n", "central", F.col("set_id").alias("component")), "minhash-open")
    release(members)
    links, made = None, []
    if given is not None:
        links = stage(_similar(given, known).distinct(), "minhash-links")
        made.append(links)
        start, before = connected_components(links), opened
        opened = stage(opened.drop("component").join(start, opened["set_id"] == start["node"], "left").withColumn("component", F.coalesce("component", "set_id")).drop("node"), "minhash-open")
        release(given, start, before)
    for turn in range(PIVOTS):
        rank = F.struct((-F.col("central") if turn == 0 else F.lit(0).cast("long")).alias("c"), F.xxhash64(F.lit(turn), "set_id", "key").alias("h"), F.col("set_id").alias("pivot"), F.col("n").alias("_pn"), F.col("component").alias("_pc"))
        pivots = stage(opened.groupBy("key").agg(F.min(rank).alias("p")).select("key", "p.pivot", "p._pn", "p._pc"), "minhash-pivots")
        near = opened.join(pivots, "key").where((F.col("component") != F.col("_pc")) & _sizes_allow("n", "_pn"))
        found = stage(_similar(near.select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")).distinct(), known).distinct(), "minhash-links")
        made.append(found)
        links = found if links is None else links.union(found)
        labels, before = connected_components(links), opened
        placed = opened.drop("component").join(labels, opened["set_id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "set_id")).drop("node")
        open_buckets = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        open_buckets = stage(open_buckets, "minhash-open-buckets")
        opened = stage(placed.join(open_buckets, "key").select("key", "set_id", "n", "central", "component"), "minhash-open")
        release(pivots, labels, open_buckets, before)
    tiles = stage(opened.groupBy("key").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles")), "minhash-tiles")
    own = opened.join(tiles, "key").withColumn("tile", F.pmod(F.hash("set_id"), F.col("tiles"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = own.select("key", "set_id", "tile", F.least("tile", "with").alias("first"), F.greatest("tile", "with").alias("second"))
    held = own.join(known, "set_id").groupBy("key", "first", "second").agg(F.collect_list(F.struct("set_id", "tile", "hashes")).alias("members"))
    rest = stage(held.select("first", "second", "members").mapInArrow(_compare, "a long, b long").distinct(), "minhash-rest")
    release(opened, tiles, known)
    labels = connected_components(links.union(rest))
    release(rest, *made)
    by_set = marked.groupBy("set_id").agg(F.min("doc_id").alias("first_id")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = by_set.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = marked.select("doc_id", "set_id").join(by_set.join(least, "component").select("set_id", "component_id"), "set_id")
    return reads(placed.select("doc_id", "component_id"), marked, labels)
