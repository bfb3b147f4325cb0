"""SimHash groups, embedding groups and components against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import twins
from pyspark.sql import functions as F

from vellum.llm import components, embeddings, minhash, simhash, staging


def texts(n=120):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.choice((1, 3, 4, 30, 200)))) for _ in range(n)]
    for i in range(0, n, 4):
        out[i + 1] = out[i].replace(out[i].split()[0], rng.choice(words), 1)
    return [*out, None, "", " \t\n", "Ä Ö ß 💬 one two", out[5].upper(), out[5]]


def check_groups(got, docs):
    fps = {i: twins.fingerprint(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    group = twins.components(sorted(fps), links)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", group[i]) for i in fps}


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash_equals_all_pairs(spark, monkeypatch, bucket):
    docs = list(enumerate(texts(), 100))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit("x"), "component": F.lit(1), "t": F.lit(2)})
    monkeypatch.setattr(simhash.links, "__defaults__", (4, bucket))
    got = simhash.near_duplicates(table).select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id").collect()
    check_groups(got, docs)


def test_covering_masks_meet_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(4), random.Random(1)
    assert len(masks) == 31
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)


def test_simhash_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(3, "same words here now"), (3, "same words here now"), (None, "same words here now"), (9, None), (8, "")]
    table = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, _gone string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(table).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (8, 8), (9, 8)]
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 3, 8]


def test_deduplicate_drops_planted_near_copies(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    docs, planted = [], []
    for i in range(300):
        own = rng.choices(words, k=rng.randint(80, 400))
        near = list(own)
        for at in rng.sample(range(len(own)), max(1, len(own) // rng.choice((45, 60, 100)))):
            near[at] = "changed"
        docs += [(i, " ".join(own)), (1000 + i, " ".join(near))]
        a, b = (set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (own, near))
        if 5 * len(a & b) >= 4 * len(a | b):
            planted.append(1000 + i)
    assert 150 < len(planted) < 300
    # near copies of one text, each with its own changes, fill large buckets; not all are alike to each other
    base = rng.choices(words, k=200)
    for i in range(150):
        docs.append((2000 + i, " ".join(w if rng.random() > 0.012 else rng.choice(words) for w in base)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(table).collect()}
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = twins.components(sorted(sets), links)
    assert {i for i in sets if group[i] == i} <= kept
    gone = [i for i in planted if i not in kept]
    assert len(gone) >= 0.99 * len(planted)
    assert sum(i >= 2000 for i in kept) <= sum(i >= 2000 and group[i] == i for i in sets) + 1


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    links = [*chain, *[(1000, 1000 + i) for i in range(1, 200)], (5, 5), (7000, 6999), *[(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]]
    rng.shuffle(links)
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components.connected_components(table).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    group = twins.components(sorted(nodes), [x for x in links if x[0] != x[1]])
    assert got == {n: c for n, c in group.items() if n != c}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 64))
    near = base[:40] + rng.normal(size=(40, 64)) * 0.25
    return np.concatenate([base, near, base[:10], base[:5] * 3]).astype(np.float32)


@pytest.mark.parametrize("tile,blocks", [(1024, None), (8, None), (8, 2)])
def test_embeddings_against_all_pairs(spark, tile, blocks):
    rows = {i: v.tolist() for i, v in enumerate(vectors(), 10)}
    rows |= {500: None, 501: [], 502: [0.0] * 64, 503: [1.0, None], 504: [float("nan")] * 64, 505: [float("inf")] + [0.0] * 63, 506: [1.0, 0.0], 507: [2.0, 0.0], 508: [1.0, 0.0, 0.0]}
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows.items()], "vec_id long, embedding array<float>, label int, rid int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table, tile=tile, blocks=blocks).collect()}
    assert got.keys() == rows.keys()
    links = twins.cosine_links(rows)
    degree = {k: sum(k in x for x in links) for k in rows}
    found = sum(r["n_links"] for r in got.values()) / 2
    assert all(got[k]["n_links"] <= degree[k] for k in rows)
    assert found >= 0.97 * len(links)
    group = twins.components(sorted(rows), links)
    assert all(group[r["component_id"]] == group[k] and r["kept"] == (r["component_id"] == k) for k, r in got.items())
    assert sum(group[k] == got[k]["component_id"] for k in rows) >= 0.97 * len(rows)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (500, 501, 502, 503, 504, 505, 508))
    assert got[507]["component_id"] == 506


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_embeddings_recall_at_the_threshold_through_the_operator(spark, wide, blocks):
    """The table itself holds no pair from 0.9 on (its largest cosine is 0.60 on 2,000 vectors), so partners are planted: each
    of 300 vectors gets one at a cosine between 0.90 and 0.92, where a lattice misses most."""
    rng = np.random.default_rng(19)
    own = {r[0]: np.array(r[1], float) for r in spark.read.parquet(f"{wide}/embeddings.parquet").select("vec_id", "embedding").collect()}
    rows, base = {k: v.tolist() for k, v in own.items()}, max(own) + 1
    for n, k in enumerate(sorted(own)[:300]):
        x = own[k] / np.linalg.norm(own[k])
        away = rng.normal(size=len(x))
        away -= (away @ x) * x
        c = rng.uniform(0.9001, 0.92)
        rows[base + n] = (3 * (c * x + np.sqrt(1 - c * c) * away / np.linalg.norm(away))).tolist()
    links = twins.cosine_links(rows)
    assert len(links) >= 300
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table, blocks=blocks).collect()}
    degree = {k: sum(k in x for x in links) for k in rows}
    assert all(got[k] <= degree[k] for k in rows)
    assert sum(got.values()) / 2 >= 0.9 * len(links), (blocks, sum(got.values()) / 2, len(links))


def _shared(a, b):
    return (a[:, :, None] == b[:, None, :]).any((1, 2))


def test_recall_at_the_threshold_holds_with_more_blocks_and_unrelated_pairs_get_fewer():
    rng = np.random.default_rng(8)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 1000, 64)))
    away = y - (x * y).sum(1, keepdims=True) * x
    at = 0.9 * x + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1, keepdims=True)
    apart = []
    for blocks in (1, 2):
        own, near, other = (embeddings.cells(v, embeddings.tables_for(blocks), blocks=blocks) for v in (x, at, y))
        assert _shared(own, near).mean() >= 0.95
        apart.append(np.mean([_shared(own, np.roll(other, k, 0)).mean() for k in range(5)]))
    assert apart[1] < apart[0] / 10


def test_blocks_follow_the_number_of_vectors():
    assert [embeddings.blocks_for(n) for n in (0, 1, 50_000, 1_000_000, 200_000_000, 10**10)] == [1, 1, 1, 2, 2, 3]
    assert [embeddings.tables_for(b) for b in (1, 2, 3)] == [6, 15, 34]


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    own = embeddings.decode_e8(x)
    steps = embeddings.minimal_vectors()
    assert len(steps) == 240
    best = ((x - own) ** 2).sum(1)
    assert (best[:, None] <= ((x[:, None] - own[:, None] - steps[None]) ** 2).sum(2) + 1e-9).all()


def test_empty_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_deduplicate_holds_fingerprint_groups_against_each_other(spark, monkeypatch):
    """A pair at 0.8 that shares no MinHash band: only the groups by fingerprints lead to it."""
    rng = random.Random(5)
    while True:
        own = [f"w{rng.randrange(10**6)}" for _ in range(13)]
        one, two = " ".join(own), " ".join([*own[:-1], "changed"])
        if not set(minhash.bands(minhash.shingles(one))) & set(minhash.bands(minhash.shingles(two))):
            break
    table = spark.createDataFrame([(1, one), (2, two), (3, "by itself")], "doc_id long, text string")
    grouped = lambda docs: spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 7, 1)], "doc_id long, fp long, component_id long")
    monkeypatch.setattr(simhash, "near_duplicates", grouped)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(table).collect()) == [1, 3]


@pytest.fixture
def no_broadcast(spark):
    """Any broadcast of a table fails, as one does that the driver can't hold."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash_groups_pass_no_table_through_the_driver(spark, monkeypatch, no_broadcast, bucket):
    docs = list(enumerate(texts(), 100))
    monkeypatch.setattr(simhash.links, "__defaults__", (4, bucket))
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    check_groups(got.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id").collect(), docs)


def test_components_keep_one_round_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vellum.llm.staging.shared_dir", lambda _: str(tmp_path))
    labels = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").repartition(7))
    assert len(list(tmp_path.iterdir())) == 1
    assert labels.count() == 50
    staging.release(labels)
    assert not list(tmp_path.iterdir())


def test_one_block_serves_the_vectors_of_six_gigabytes():
    assert embeddings.blocks_for(615_384) == 1


def test_cells_are_read_whole_from_batches_of_any_size():
    """Members come as sorted rows, so a task holds one cell, not a batch of gathered cells."""
    x = vectors()[np.arange(120).reshape(3, 40)[[0, 2, 1]].T.ravel()][:100]  # each of the first vectors by its partner
    cell = np.iinfo(np.int64).min + np.sort(np.arange(100) % 40 // 13)  # no key is lower, so no pair has met before
    columns = [np.zeros(100, np.int32), cell, np.full(100, 64, np.int32), *2 * [np.zeros(100, np.int32)], np.arange(100), np.ones(100, np.int64), np.zeros(100, np.int32)]
    rows = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(x.tolist(), pa.list_(pa.float32()))], list(embeddings._MEMBER))
    run = embeddings._verify(0.9, 2, 1.5, 11, 1)
    found = []
    for size in (100, 7, 1):
        out = pa.Table.from_batches(run(rows.slice(k, size) for k in range(0, 100, size)))
        found.append(sorted(zip(*(c.to_pylist() for c in out.columns), strict=True)))
    assert found[0] == found[1] == found[2]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & (cell[:, None] == cell[None, :]) & ~np.eye(100, dtype=bool)
    assert near.any() and {r for r, _, _ in found[0]} == set(np.flatnonzero(near.any(1)).tolist())


def test_deduplicate_deletes_what_its_steps_have_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vellum.llm.staging.shared_dir", lambda _: str(tmp_path))
    own = " ".join(f"w{i}" for i in range(60))
    table = spark.createDataFrame([(1, own), (2, own + " more"), (3, "by itself")], "doc_id long, text string")
    kept = simhash.deduplicate(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["near-duplicates"]
    staging.release(kept)
    assert not list(tmp_path.iterdir())
