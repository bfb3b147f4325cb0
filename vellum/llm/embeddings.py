"""Near-duplicate embeddings by lattice hashing: random projections decoded to E8 points, verified by cosine."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .minhash import common
from .staging import release, stage

COSINE = 0.9
#: Each vector also enters so many lattice cells next to its own in each table.
PROBES = 2
#: Width of a cell in units of a unit vector's projection.
WIDTH = 1.5
#: With these, two vectors at the threshold share a cell of one block with this probability, and a block deals unrelated
#: vectors as if over so many cells.
MEET, CELLS = 0.48, 900
#: Share of the pairs at the threshold that may miss each other in all tables; hardly any above 0.92 do.
MISS = 0.02
#: The number of blocks is such that a cell holds no more unrelated vectors than this on average. Sending a vector to the
#: 117 more cells that a second block asks for takes longer than comparing it with some thousands.
CROWD = 1024
SEED = 11
#: A cell of more vectors is compared tile by tile, each in a task of its own.
TILE = 1024


def _d8(x: np.ndarray) -> np.ndarray:
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(1) % 2)
    gap = x[odd] - out[odd]
    at = np.abs(gap).argmax(1)
    out[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1, -1)
    return out


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice to each row: the better of the nearest in D8 and in D8 shifted by a half."""
    even, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - even) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], even, half)


@functools.cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring points."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs, strict=True):
        row[i], row[j] = a, b
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate([whole, np.array(halves)])


def blocks_for(vectors: int) -> int:
    """How many lattice blocks make up a key: cells grow in number with the vectors, so that they don't grow in size."""
    return max(1, math.ceil(math.log(max(vectors, 1) / CROWD, CELLS)))


def tables_for(blocks: int) -> int:
    """How many tables find all but MISS of the pairs at the threshold: 6, 15 or 34 for 1, 2 or 3 blocks."""
    return math.ceil(math.log(MISS) / math.log(1 - MEET**blocks))


def cells(unit: np.ndarray, tables: int, probes: int = PROBES, width: float = WIDTH, seed: int = SEED, blocks: int = 1) -> np.ndarray:
    """Keys of the lattice cells of each unit vector, one row each. Each of a table's blocks projects to 8 dimensions and has
    the vector's own lattice point and the next nearest ones; a key joins one point of every block."""
    steps, out = minimal_vectors(), []
    for table in range(tables):
        rng = np.random.default_rng((seed, table, unit.shape[1]))
        key = np.full((len(unit), 1), table + 1, np.uint64)
        for _ in range(blocks):
            x = unit @ rng.normal(size=(unit.shape[1], 8)) / width + rng.uniform(0, 2, 8)
            own = decode_e8(x)
            nearest = np.argpartition(-((x - own) @ steps.T), probes - 1, axis=1)[:, :probes]
            points = np.concatenate([own[:, None], own[:, None] + steps[nearest]], axis=1)
            points = np.tile(np.rint(2 * points).astype(np.int64).view(np.uint64), (1, key.shape[1], 1))
            key = np.repeat(key, probes + 1, axis=1)
            for i in range(8):
                key = (key ^ points[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
        out.append(key.view(np.int64))
    return np.concatenate(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(tables: int, probes: int, width: float, seed: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = batch.take(pa.array(at))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                keys = cells(_unit(x), tables, probes, width, seed, blocks)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(at), size, np.int32)), lists], ["rid", "dim", "keys"])

    return run


def _label(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric relation reaches."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


#: What sorted members of cells are grouped by, and all they carry.
_CELL = ("t", "cell", "dim", "first", "second")
_MEMBER = (*_CELL, "rid", "copies", "tile", "vector")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows as batches of whole cells, with the places where one ends."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = [rows.column(i).to_numpy() for i in range(len(_CELL))]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if batch is None:
            yield rows, np.append(ends, rows.num_rows)
            return
        if len(ends):  # the last cell may go on in the next batch
            yield rows.slice(0, ends[-1]), ends
            rows = rows.slice(ends[-1])
        held = [rows]


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of the unit vectors one after the other, and where each vector begins and ends."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(ends)
    for size in np.unique(sizes).tolist():
        at = ends[:-1][sizes == size, None] + np.arange(size)
        flat[at] = _unit(flat[at])
    return flat, ends


def _verify(cosine: float, probes: int, width: float, seed: int, blocks: int):
    """Links inside each cell or pair of tiles: for each vector how many links it gains, and one vector of its group.

    Rows come sorted by cell. A pair that meets in several cells is counted in the first: the one of lowest table, and of
    lowest key in it. The keys are worked out again for the vectors that have a link, which are few, rather than sent along.
    """
    per_table = (probes + 1) ** blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, stops in _whole_cells(batches):
            flat, ends = _units(rows.column(8))
            tables, keys, _, firsts, seconds, rids, all_copies, tiles = (rows.column(i).to_numpy() for i in range(8))
            out: list[list[np.ndarray]] = [[], [], []]
            for start, stop in itertools.pairwise((0, *stops.tolist())):
                size = stop - start
                x = flat[ends[start] : ends[stop]].reshape(size, -1)
                near = x @ x.T >= cosine
                if np.count_nonzero(near) == size:  # each with itself
                    continue
                table, cell, rid, copies = int(tables[start]), keys[start], rids[start:stop], all_copies[start:stop]
                np.fill_diagonal(near, False)
                if firsts[start] != seconds[start]:
                    tile = tiles[start:stop]
                    near &= tile[:, None] != tile[None, :]
                a, b = np.nonzero(np.triu(near))
                if not len(a):
                    continue
                label = _label(near)
                linked, place = np.unique(np.concatenate((a, b)), return_inverse=True)
                own = cells(x[linked], table + 1, probes, width, seed, blocks).reshape(len(linked), table + 1, per_table)
                before = [np.append(k[:table], k[table][k[table] < cell]) for k in own]
                met = common(before)[place[: len(a)], place[len(a) :]] > 0
                a, b = a[~met], b[~met]
                gained = np.bincount(a, copies[b], size) + np.bincount(b, copies[a], size)
                kept = np.flatnonzero((label != np.arange(size)) | (gained > 0))
                for column, value in zip(out, (rid[kept], rid[label[kept]], gained[kept].astype(np.int64)), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["rid", "other", "gained"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, probes: int = PROBES, width: float = WIDTH, seed: int = SEED, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``embeddings``.

    n_links counts the other rows whose vector has a cosine of at least ``cosine`` and shares a cell in some table;
    component_id is the smallest vec_id reachable over links and kept marks the row that has it. Equal vectors are
    compared once and counted as often as they occur. A vector that is null, empty or zero, or has a null or non-finite
    component, has no link and is its own component; vectors of other lengths aren't compared with each other. Rows that
    repeat a vec_id are vectors of their own. Other columns, labels among them, are not used.

    Only counts and one member for each link group leave a cell, never its pairs. A cell of more than ``tile`` vectors is
    dealt out as pairs of tiles, so that no task holds more than two tiles. Keys are of ``blocks`` lattice points, by default
    as many as the number of different vectors asks for, and the tables are as many as that takes for the same recall: the
    pairs compared for each vector then stay bounded however many vectors there are, while its cells become more. Members
    reach a task sorted by cell and one cell after the other, so it holds a batch of rows and one cell.
    """
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    fit = F.size("vector") > 0
    fit &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    distinct = rows.where("fit").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = stage(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors")

    blocks = blocks or blocks_for(distinct.count())
    per_table = (probes + 1) ** blocks
    keyed = stage(distinct.select("rid", "vector").mapInArrow(_keys(tables_for(blocks), probes, width, seed, blocks), "rid long, dim int, keys array<long>"), "vector-keys")
    placed = keyed.select("rid", "dim", F.posexplode("keys").alias("place", "cell")).withColumn("t", F.expr(f"place div {per_table}").cast("int"))
    sizes = placed.groupBy("t", "dim", "cell").agg(F.count("*").alias("n")).where("n > 1")
    busy = placed.join(sizes.hint("merge"), ["t", "dim", "cell"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    own = busy.withColumn("tile", F.pmod(F.hash("rid"), F.col("tiles"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = own.select("rid", "t", "cell", "dim", "tile", F.least("tile", "with").alias("first"), F.greatest("tile", "with").alias("second"))
    members = own.join(distinct.select("rid", "copies", "vector").hint("merge"), "rid").select(*_MEMBER)
    members = members.repartition(*_CELL).sortWithinPartitions(*_CELL)
    found = members.mapInArrow(_verify(cosine, probes, width, seed, blocks), "rid long, other long, gained long")
    found = stage(found, "vector-links")
    release(keyed)

    counts = found.groupBy("rid").agg(F.sum("gained").alias("gained"))
    labels = connected_components(found.where("rid != other").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    grouped = distinct.join(counts.hint("merge"), "rid", "left").join(labels.withColumnRenamed("node", "rid").hint("merge"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = grouped.join(least.hint("merge"), "component").select("vector", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("fit").join(known.hint("merge"), "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
