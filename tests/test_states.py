"""Broken JSON, layouts with sizes, expansion states and sums along an order against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import activity, graph, integrity
from vellum.operators.ordered import sums_before


def test_every_broken_document_says_where(spark):
    rows = [
        ('{"x": [1, {"y": "]"}, [2, [3]], "a\\"b" ]}', [(7, 8), (10, 20), (22, 30), (32, 38)], None),
        ('{"x": []}', [], None),
        (' {"z": {"x": [9]}, "x": [ null , true ] } ', [(26, 30), (33, 37)], None),
        ('{"\\u0078": [1]}', [(12, 13)], None),
        ('{"x": ["' + "[" * 5 + '"]}', [(7, 14)], None),
        ('{"x": [' + "[" * 20_000 + "]" * 20_000 + "]}", [(7, 40_007)], None),
        ("", None, ("object expected", 0)),
        (None, None, ("object expected", 0)),
        ("  [1]", None, ("object expected", 2)),
        ('{"x": 1}', None, ("array expected", 6)),
        ('{"y": [1]}', None, ("no such property", 10)),
        ('{"x": [1, 2', None, ("brackets without end", 6)),
        ('{"x": [1, 2}', None, ("wrong closing bracket", 11)),
        ('{"x": [1 2]}', None, ("comma or ] expected", 9)),
        ('{"x": [1, ]}', None, ("value expected", 10)),
        ('{"x" [1]}', None, ("colon expected", 5)),
        ('{"x": ["a]}', None, ("string without end", 7)),
        ('{"x": [1], }', None, ("value expected", 11)),
        ('{"x": [1] "y": 2}', None, ("comma or } expected", 10)),
        ('{"x": [1]} more', None, ("end expected", 11)),
        ("{x: [1]}", None, ("name expected", 1)),
        ('{"x": [1], "y": {"z": [}]}', None, ("wrong closing bracket", 23)),
    ]
    got = {}
    for r in integrity.array_slices(spark.createDataFrame([(i, t, "k") for i, (t, *_) in enumerate(rows)], "key int, raw string, pos string"), "x").collect():
        got.setdefault(r["key"], []).append(r)
    for i, (text, spans, problem) in enumerate(rows):
        if problem:
            assert [(r["problem"], r["problem_at"], r["pos"]) for r in got[i]] == [(*problem, None)], text
        else:
            own = sorted(got.get(i, []), key=lambda r: r["pos"])
            assert [(r["begin"], r["end"], r["element"]) for r in own] == [(a, b, text[a:b]) for a, b in spans], text


def plain_layout(nodes, edges, node, seen=()):
    """The recursive definition: width, height, boxes and labels as (way, node, place, depth, x, y, w, h, cyclic)."""
    high = lambda text, box, font: max(1, -(-len(text or "") // max(1, int(box / (font * 0.58))))) * (font + 4)
    if node not in nodes or node in seen:
        return 0, 0, [("", node, None, 0, None, None, None, None, True)] if node in seen else []
    kind, text = nodes[node]
    w = 240 if kind == "result" else 280
    h = max(50, (16 + high(text, 212, 10) if kind == "result" else high(text, 252, 11)) + 28)
    below = sorted(e for e in edges if e[0] == node)
    if kind == "result" or not below:
        return w, h, [("", node, None, 0, 0.0, 0.0, w, h, False)]
    labels = [max(24, high(label, 134, 10) + 10) for *_, label in below]
    children = [plain_layout(nodes, edges, dst, (*seen, node)) for _, _, dst, _ in below]
    row = sum(c[0] for c in children) + 36 * (len(children) - 1)
    width, top = max(w, row), h + 20 + 16 + max(labels)
    out, x = [("", node, None, 0, (width - w) / 2, 0.0, w, h, False)], (width - row) / 2
    for (_, place, dst, _), label, (cw, _, parts) in zip(below, labels, children, strict=True):
        out.append((str(place), dst, place, 0, x + cw / 2 - 75, float(h + 28), 150, label, False))
        for way, n, p, d, px, py, pw, ph, cyclic in parts:
            out.append((f"{place}.{way}" if way else str(place), n, p, d + 1, px if px is None else px + x, py if py is None else py + top, pw, ph, cyclic))
        x += cw + 36
    return width, top + max(c[1] for c in children), out


def test_sized_layout_equals_the_recursion(spark):
    rng = random.Random(4)
    nodes = {f"n{i}": (rng.choice(("question", "question", "result")), "x" * rng.choice((0, 5, 60, 400))) for i in range(60)}
    nodes |= {"r0": ("question", "root"), "r1": ("question", None), "r2": ("result", "alone")}
    edges = [(f"n{i}", p, f"n{rng.randint(i + 2, i + 14)}", "o" * rng.choice((0, 10, 90))) for i in range(40) for p in range(rng.randint(0, 3))]
    edges += [("r0", 0, "n1", "a"), ("r0", 1, "n2", "b" * 50), ("r0", 2, "n1", "again"), ("r1", 0, "n3", None), ("r1", 1, "r1", "to itself"), ("n3", 9, "r1", "back"), ("r2", 0, "n1", "never")]
    got = graph.sized_layout(spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, kind string, text string"), spark.createDataFrame(edges, "src string, place int, dst string, label string"), spark.createDataFrame([("r0",), ("r1",), ("r2",)], "node string"))
    found = {root: [] for root in ("r0", "r1", "r2")}
    for r in got.collect():
        found[r["root"]].append((r["at"], r["node"], r["place"], r["depth"], r["x"], r["y"], r["w"], r["h"], r["cyclic"]))
    for root, rows in found.items():
        assert sorted(rows, key=str) == sorted([tuple(float(x) if i in (6, 7) and x is not None else x for i, x in enumerate(row)) for row in plain_layout(nodes, edges, root)[2]], key=str)
    assert any(r[-1] for r in found["r1"]) and len(found["r0"]) > 12 and len(found["r2"]) == 1


def test_expansion_equals_a_fold(spark):
    rng = random.Random(9)
    rows = [(u, t, rng.choice(("toggle", "toggle", "show", "search", "clear", "look")), rng.choice(("a", "b", "c", None))) for u in range(60) for t in range(rng.randint(0, 25))]
    state = {}
    for u, _, kind, item in rows:
        now, before = state.get(u, (set(), None))
        if kind == "clear":
            now, before = (now if before is None else before), None
        elif kind == "search" and before is None:
            before = set(now)
        if item is not None and kind in ("toggle", "show", "search"):
            now = now ^ {item} if kind == "toggle" else now | {item}
        state[u] = now, before
    got = activity.expanded_groups(spark.createDataFrame(rows, "user int, t int, kind string, item string").repartition(5), "user", "kind", "item", "t")
    assert {tuple(r) for r in got.collect()} == {(u, i) for u, (now, _) in state.items() for i in now}


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_along_a_global_order(spark, parts):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 13).alias("v"), F.hash("id").alias("o")).repartition(parts)
    got = sums_before(rows, [F.col("o"), F.col("id")], F.col("v"), "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r["o"], r["id"])):
        assert r["before"] == total
        total += r["v"]
