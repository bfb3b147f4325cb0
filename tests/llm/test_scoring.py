"""Importance resampling, language-model scores and spelling variants against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from vellum.llm import lm, queries, resampling, spelling

LETTERS = str.maketrans({c: c + 32 for c in range(65, 91)})


def odd_documents():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "straße", "ÉCOLE", "x1", "don't", "a-b", "naïve", "the", "THE", "of", "Kelvin", "日本語"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t\n", "one", texts[0], texts[0], texts[1] + " " + texts[2], " ".join(rng.choices(words, k=30_000)), "y" * 1_000_000, "z " * 200_000, " " * 1_000_000]
    rows = [(i, t, "a", i, 0.5) for i, t in enumerate(texts)] + [(None, texts[3], "a", 1, 0.0), (5, texts[4], "b", 2, 1.0), (5, texts[5], None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, rank string, n_near long, score double"


def plain_resampling(rows, target, least=20, share=5):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    cut = [features(t) for _, t in rows]
    s, t = (collections.Counter(itertools.chain.from_iterable(x)) for x in ((f for _, f in cut), (features(x)[1] for x in target)))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000.0) / ((s[b] + 1.0) * (T + 10_000.0)))) for b in s}
    out = []
    for (i, _), (words, own) in zip(rows, cut, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_a_plain_version(spark):
    rows = odd_documents()
    target = ["the alpha of gamma", None, "", "Beta école x1 naïve " * 30]
    got = resampling.resample(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    expected = plain_resampling([r[:2] for r in rows], target)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == expected
    assert sum(r[4] is not None for r in expected) >= 3
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(empty, empty.select("doc_id", "text")).count() == 0


def test_resampling_on_the_table(spark, small):
    docs = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in queries.table(spark, small, "benchmark").select("text").collect()]
    got = queries.op11_resampling(spark, small)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resampling(docs, target)


def test_documents_longer_than_a_slice_of_words(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(50))
    whole = [x for p in resampling._buckets(text)[1] for x in p.tolist()]
    monkeypatch.setattr(resampling, "SLICE", 8)
    assert sorted(whole) == sorted(x for p in resampling._buckets(text)[1] for x in p.tolist())


def plain_lm(rows, order, strength):
    """Counts in dictionaries and the recursive definition of the probabilities."""
    cut = [((t or "").translate(LETTERS), zlib.crc32(str("" if i is None else i).encode()) % 5 == 1) for i, t in rows]
    texts = [([*re.findall(r"[^\x20\x09-\x0D]+", t), None], held) for t, held in cut]
    counts = collections.Counter()
    for words, held in texts:
        line = [0, *words]
        for n in range(1, order + 1):
            for i in range(1, len(line)):
                if i - n + 1 >= 0 and not held:
                    counts[tuple(line[i - n + 1 : i + 1])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    known = sum(len(g) == 1 for g in counts)
    counts[(0,)] = counts[(None,)]

    def chance(context, word):
        if not context:
            return (counts[(word,)] + 0.5) / (total + 0.5 * (known + 1))
        m = strength[min(len(context), len(strength)) - 1]
        return (counts[(*context, word)] + m * chance(context[1:], word)) / (counts[context] + m)

    out = []
    for (i, _), (words, held) in zip(rows, texts, strict=True):
        line = [0, *words]
        score = sum(math.log10(chance(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        base = sum(math.log10(chance((), w)) for w in words)
        out.append((i, held, len(words), sum(counts[(w,)] > 0 for w in words), total, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "chunk"), [(2, 1 << 22), (2, 3000), (3, 3000), (1, 5000), (4, 1 << 22)])
def test_lm_scores_equal_a_plain_version(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "SLICE", 200)
    rows = [r for r in odd_documents() if not r[1] or len(r[1]) < 100_000] if chunk == 3000 else odd_documents()
    got = lm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), order, (7.0, 3.0))
    expected = plain_lm([r[:2] for r in rows], order, (7.0, 3.0))
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_lm_of_no_rows_and_of_none_to_learn_from(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm.score_documents(spark.createDataFrame([(i, "a b", "", 0, 0.0) for i in held], SCHEMA)).collect()
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["score"]) for r in got} == {(True, 0, 0, 0.0)}


def test_lm_beats_single_words_on_held_out_texts(spark, wide):
    got = queries.op12_lm_scoring(spark, wide).where("held_out").selectExpr("sum(base_score) base", "sum(score) score", "sum(n_tokens) n").first()
    assert got["score"] / got["n"] > got["base"] / got["n"] + 0.05, got


def plain_words(rows):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LETTERS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def variant_rows():
    rng = random.Random(13)
    stems = ["alphabet", "Geschwindigkeit", "aaaaaaa", "abababab", "élèvement", "abcdefg", "mississippi", "Übermaß"]
    rows = []
    for i in range(60):
        words = []
        for stem in stems:
            words += [stem] * rng.choice((1, 5, 40))
            at = rng.randrange(len(stem))
            words += [stem[:at] + rng.choice("abz") * rng.choice((0, 1)) + stem[at + rng.choice((0, 1)) :]] * rng.choice((1, 2))
        rows.append((i, rng.choice((" ", ", ", "_", "1")).join(words), "x", 1, 0.0))
    return rows + [(None, "alphabet alphabets ALPHABETS", "x", 1, 0.0), (3, None, "", 0, 0.0), (4, "", "", 0, 0.0), (4, "x" * 100_000 + " " + "x" * 100_001, "", 0, 0.0), (6, "abcdefg" * 3, "", 0, 0.0)]


@pytest.mark.parametrize("group", [20_000, 5, 1])
def test_variants_equal_a_plain_version(spark, group):
    rows = variant_rows()
    words = plain_words([r[:2] for r in rows])
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(4), group=group).select("word", "n", "n_near", "form", "form_n", "root")
    expected = plain_variants(words)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert len(expected) > 60 and sum(r[3] is not None for r in expected) > 20
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_variants_on_the_table(spark, small):
    docs = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    got = queries.op13_spelling(spark, small).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == plain_variants(plain_words(docs))


def test_automata_number_their_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(60)})
    automaton = spelling.Automaton(words)
    assert len(automaton.arcs) < len({w[:i] for w in words for i in range(len(w) + 1)})
    for word in {"".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)}:
        assert {words[k] for k in automaton.one_error(word, 0, len(word))} == {v for v in words if one_edit(word, v)}
