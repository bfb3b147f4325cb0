"""Repeated strings, benchmark passages, mixing and training order against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import twins
from pyspark.sql import functions as F

from vellum.llm import decontaminate, mixing, substrings, tokens


def repeated_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeä", k=rng.randint(1, 6)))
    passage = lambda n: " ".join(word() for _ in range(n))
    common, other = passage(150), passage(160)
    out = [passage(rng.randint(1, 300)) for _ in range(25)]
    out += [f"{passage(20)} {common} {passage(rng.randint(0, 40))}" for _ in range(6)]
    out += [common, common, f"x{common}", common[: len(common) - 40] + other + common[5:], other * 2, "a" * 900, "ab" * 500, "ä" * 450, "b" * 399, "b" * 399, "c" * 400, "c" * 400]
    out += [f"{common[:300]}{other[:200]}", f"{common[100:]}{other[100:]}", None, None, ""]
    return out


@pytest.mark.parametrize("length", [400, 410])
def test_repeats_equal_all_strings(spark, length):
    texts = repeated_texts()
    docs = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, bucket int, digest string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["spans"], r["kept_sha256"]) for r in substrings.remove_repeats(table, length).collect()}
    assert got == dict(enumerate(twins.repeats(texts, length)))


def test_repeats_of_rows_with_one_key(spark):
    text = "".join(random.Random(1).choices("abcdefg ", k=500))
    table = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "q"), (2, text[:399])], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeats(table).collect())
    assert got == [(0, 0), (0, 500), (1, 500), (1, 500), (2, 0)]
    once = spark.createDataFrame([(1, text), (2, text[:399])], "doc_id long, text string")
    assert substrings.remove_repeats(once).agg(F.sum("n_removed")).first()[0] == 0
    assert substrings.remove_repeats(table.where("false")).count() == 0


def test_repeats_on_the_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = table.orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["spans"], r["kept_sha256"]) for r in substrings.remove_repeats(table).collect()}
    assert got == dict(zip([r[0] for r in rows], twins.repeats([r[1] for r in rows], 400), strict=True))


def benchmark_and_texts():
    rng = random.Random(4)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    items = [(i, sentence(rng.randint(12, 40))) for i in range(12)] + [(50, "short q"), (51, ""), (52, None), (53, items_text := sentence(20)), (54, items_text)]

    def damaged(text, share):
        chars = list(text)
        for _ in range(int(len(chars) * share)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice(([], ["z"], [chars[at], "y"]))
        return "".join(chars)

    docs = []
    for i, (_, text) in enumerate(items[:12]):
        for share in (0, 0.03, 0.06, 0.09, 0.13, 0.3):
            docs.append((len(docs), f"{sentence(i * 3)} {damaged(text, share)} {sentence(10)}"))
    docs += [(len(docs), items[0][1].upper().replace(" ", " \n")), (len(docs) + 1, None), (len(docs) + 2, ""), (len(docs) + 3, "a short q here"), (len(docs) + 4, items_text), (len(docs) + 5, sentence(500) + items[3][1] + sentence(500) + items[3][1])]
    return items, docs


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_passages_equal_alignment_of_every_pair(spark, block):
    items, docs = benchmark_and_texts()
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find_passages(table, bench, block=block).collect()}
    expected = {}
    for i, passage in items:
        passage = decontaminate.normalise(passage)
        if not passage:
            continue
        budget = max(0, min(int(len(passage) * 0.1), (len(passage) - 8) // 8))
        for d, text in docs:
            least = twins.edits(passage, decontaminate.normalise(text))
            if least <= budget:
                expected[d, i] = least
    assert got == expected
    clean = {d for d, _ in docs} - {d for d, _ in expected}
    kept = decontaminate.drop_contaminated(table, bench, block=block)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == clean


def test_no_passages(spark):
    table = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(table, bench).count() == 0
    assert decontaminate.drop_contaminated(table, bench).count() == 1
    assert decontaminate.find_passages(table.where("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def mixable():
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 1, 5, 40)))), rng.choice(("a", "a", "a", "b", "c", "d", None)), 7, "x") for i in range(400)]
    return [*rows, (900, None, "a", None, None), (None, "one two", "b", 1, "y"), (3, rows[3][1], rows[3][2], 7, "x"), (901, "", "only empty", 1, "y"), (902, "  \t", "nbsp", 1, "y")]


def test_targets_and_taken_words(spark):
    rows = mixable()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _words string").repartition(6)
    got = mixing.taken(table).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(table.repartition(3)).collect()))
    by_source: dict = {}
    for (i, text, source, *_), size in ((r, len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows):
        by_source.setdefault(source, []).append((i, size))
    sizes = {s: sum(n for _, n in v) for s, v in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = twins.water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken: dict = {}
    source_of = {(r[0], len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[2] for r in rows}
    for r in got:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source]) and r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_the_mix_has_the_words_that_the_plan_takes(spark):
    rows = [r for r in mixable() if r[0] != 3]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _words string").withColumns({"_doc": F.lit(1), "_size": F.lit(2), "copies": F.lit(3), "size": F.lit("s"), "a.b": F.lit(4)})
    out = mixing.mix(table)
    assert out.columns == table.columns
    words: dict = {}
    for r in out.withColumn("n", mixing.word_count(F.col("text"))).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n"]
        assert r["size"] == "s" and r["_doc"] == 1
    assert {d: n for d, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in mixing.taken(table).collect() if r["taken"]}
    assert mixing.mix(table.where("false")).count() == 0


def test_slices_follow_the_rows_and_do_not_change_the_mix(spark, monkeypatch):
    assert [mixing.slice_digits(n) for n in (0, 1, 65_536 * 16, 65_536 * 16 + 1, 10**12)] == [1, 1, 1, 2, 6]
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    coarse = sorted(map(str, mixing.taken(table).collect()))
    monkeypatch.setattr(mixing, "slice_digits", lambda rows: 3)
    assert sorted(map(str, mixing.taken(table).collect())) == coarse


def test_feistel_is_a_permutation():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        out = tokens.feistel(np.arange(total), total, 7)
        assert sorted(out.tolist()) == list(range(total))
    assert tokens.feistel(np.arange(1000), 1000, 7).tolist() != tokens.feistel(np.arange(1000), 1000, 8).tolist()


def test_training_order_round_trip(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(("alpha", "beta  gamma", "Ünï", "💬", "x1", "don't", "\n\n"), k=rng.choice((0, 1, 20, 400))))) for i in range(60)]
    docs += [(70, None), (71, "a" * 5000 + " b" * 3000), (72, "dup"), (72, "dup"), (None, "no id")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(5)
    manifest = tokens.training_order(table, f"{tmp_path}/out", length=64, per_shard=10).orderBy("shard").collect()
    assert [m["first_slot"] for m in manifest] == [10 * i for i in range(len(manifest))] and all(m["records"] == 10 for m in manifest[:-1])
    again = tokens.training_order(table.repartition(2).coalesce(1), f"{tmp_path}/again", length=64, per_shard=10).orderBy("shard").collect()
    assert [(m["sha256"], m["parts"]) for m in again] == [(m["sha256"], m["parts"]) for m in manifest]
    assert [m["sha256"] for m in tokens.training_order(table, f"{tmp_path}/key", length=64, per_shard=10, key=5).orderBy("shard").collect()] != [m["sha256"] for m in manifest]
    stretches = []
    for m in manifest:
        ids = tokens.read_slots(m["path"], m["first_slot"], m["stride"], m["first_slot"], m["first_slot"] + m["records"])
        assert hashlib.sha256(ids.astype("<u2").tobytes()).hexdigest() == m["sha256"]
        assert (tokens.read_slots(m["path"], m["first_slot"], m["stride"], m["first_slot"] + 1, m["first_slot"] + 2) == ids[1:2]).all()
        assert m["doc_ids"] == sorted({p["doc_id"] for p in m["parts"]} - {None})
        stretches += [(p["doc_id"], ids[p["slot"] - m["first_slot"]][p["start"] : p["start"] + p["size"]].tolist()) for p in m["parts"]]
    code = tokens.encoder(tokens.load(tokens.VOCABULARY))
    got: dict = {}
    for doc, ids in stretches:
        got.setdefault(doc, []).extend(ids)
    assert sum(map(len, got.values())) == sum(len(code.encode_ordinary(t or "")) + 1 for _, t in docs)
    for doc, text in docs:
        expected = [*code.encode_ordinary(text or ""), tokens.END]
        assert sorted(got[doc]) == sorted(expected * (2 if doc == 72 else 1))
        # a document of one stretch is whole and in order
        if len([1 for d, _ in stretches if d == doc]) == 1:
            assert got[doc] == expected
    assert tokens.training_order(table.where("false")).count() == 0


def test_runs_of_a_million_signs_are_encoded(spark):
    vocabulary = tokens.load(tokens.VOCABULARY)
    code = tokens.encoder(vocabulary)
    for space in (" ", "\n", "\t ", "\u00a0", " \r\n"):
        for text in (f"ab{space * 15_000}cd 1", f"{space * 15_000}", f"x.{space * 15_000}", f"{space * 12_000}!y{space * 12_000}é"):
            assert tokens.encode(vocabulary, text).tolist() == code.encode_ordinary(text), text[:5]
    runs = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "-" * 1_000_000, "7" * 1_000_000, "a" + " " * 1_000_000 + "b"]
    for text in runs:
        assert code.decode(tokens.encode(vocabulary, text).tolist()) == text
    manifest = tokens.training_order(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()
    assert sum(m["records"] for m in manifest) >= 6 and {d for m in manifest for d in m["doc_ids"]} == set(range(6))


def test_cut_texts_are_encoded_as_whole_ones(monkeypatch):
    text = "Some words, and 12 numbers;  double  blanks\n\nand lines " * 40
    whole = tokens.encoder(tokens.load(tokens.VOCABULARY)).encode_ordinary(text)
    monkeypatch.setattr(tokens, "CUT", 50)
    assert tokens.encode(tokens.load(tokens.VOCABULARY), text).tolist() == whole


def test_passages_in_very_long_runs_of_one_sign(spark):
    rng = random.Random(3)
    words = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))
    bench = spark.createDataFrame([(1, "-" * 60), (2, words), (3, "-" * 40 + words)], "item_id long, text string")
    docs = [(1, "-" * 1_000_000), (2, "x" * 500_000 + words + "y" * 500_000), (3, "- " * 100_000), (4, "-" * 30_000 + words)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(table, bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 1), (4, 2), (4, 3)}


def test_pairs_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    items, docs = benchmark_and_texts()
    items = [(i, t) for i, t in items if t]
    index = decontaminate.build_index(items)
    parts = [sorted(decontaminate.search(index, t)) for _, t in docs]
    monkeypatch.undo()
    assert parts == [sorted(decontaminate.search(index, t)) for _, t in docs]


def test_the_order_of_the_table_doesnt_depend_on_its_split(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    one, other = (tokens.training_order(table.repartition(n)).select("shard", "sha256").orderBy("shard").collect() for n in (2, 7))
    assert one == other and one
