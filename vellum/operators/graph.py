"""Decision graphs: reachability, paths, leaf counts and layout over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import times as tm
from vellum.operators.ordered import sums_before
from vellum.sources.staging import checkpoint

MAX_DEPTH = 64
#: Between boxes, from a box to the rail below it, and around labels.
NODE_GAP, DROP, LABEL_GAP = 36, 20, 8


def depths(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(node, depth)``: the least number of ``(src, dst)`` edges from any of ``roots.node``.

    Breadth first: every step joins only the newest nodes and leaves out those that were seen, so a cycle ends by itself.
    More steps than ``max_depth`` are an error, not a cut.
    """
    seen = checkpoint(roots.select("node", F.lit(0).alias("depth")).distinct())
    newest = seen
    for depth in range(1, max_depth + 1):
        found = newest.join(edges, newest["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        newest = checkpoint(found.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if newest.isEmpty():
            return seen
        seen = seen.union(newest)
    raise RuntimeError(f"the graph is deeper than {max_depth}")


def paths(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(node, path, cyclic)``: every walk from a root, as the list of its nodes, to each node it visits.

    A walk that comes back to a node of its own is marked as cyclic and ends there. Meant for trees and nearly so: the
    number of walks is the result's size.
    """
    newest = checkpoint(roots.select("node", F.array("node").alias("path"), F.lit(False).alias("cyclic")))
    out = newest
    for _ in range(max_depth):
        step = newest.where("not cyclic").join(edges, F.col("node") == F.col("src"))
        newest = checkpoint(step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cyclic")))
        if newest.isEmpty():
            return out
        out = out.union(newest)
    raise RuntimeError(f"the graph is deeper than {max_depth}")


def leaf_counts(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(node, leaves)`` of a tree: the number of leaves below each node, 1 for a leaf.

    From the deepest level up: each level sums what its children have, so every edge is joined once.
    """
    level = depths(edges, roots, max_depth)
    deepest = level.agg(F.max("depth")).first()[0]
    if deepest is None:
        return level.select("node", F.lit(0).cast("long").alias("leaves"))
    below, out = None, None
    for depth in range(deepest, -1, -1):
        own = level.where(F.col("depth") == depth).select("node")
        if below is not None:
            sums = edges.join(below, edges["dst"] == below["node"]).groupBy(F.col("src").alias("node")).agg(F.sum("leaves").alias("sum"))
            own = own.join(sums, "node", "left").select("node", F.coalesce("sum", F.lit(1)).cast("long").alias("leaves"))
        else:
            own = own.select("node", F.lit(1).cast("long").alias("leaves"))
        below = checkpoint(own)
        out = below if out is None else out.union(below)
    return out


def layout(edges: DataFrame, roots: DataFrame, width: float = 1.0, gap: float = 0.5, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(node, depth, span, x)`` of a tree: each node over the middle of its subtree, children side by side in the order of their id.

    ``span`` is the width of the subtree: its leaves side by side, roots beside each other. Offsets go down level by level
    with one window for each parent's children. sized_layout measures the nodes.
    """
    leaves = leaf_counts(edges, roots, max_depth).withColumn("span", F.col("leaves") * width + (F.col("leaves") - 1) * gap)
    level = depths(edges, roots, max_depth)
    sized = checkpoint(leaves.join(level, "node"))
    tops = sums_before(sized.where("depth = 0"), [F.col("node")], F.col("span") + gap, "left")
    newest = checkpoint(tops.select("node", "depth", "span", "left"))
    out, depth = newest, 0
    while not newest.isEmpty():
        depth += 1
        children = edges.join(newest.select(F.col("node").alias("src"), F.col("left").alias("from")), "src").join(sized.where(F.col("depth") == depth), edges["dst"] == sized["node"])
        before = Window.partitionBy("src").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        newest = checkpoint(children.withColumn("left", F.col("from") + F.coalesce(F.sum(F.col("span") + gap).over(before), F.lit(0.0))).select("node", "depth", "span", "left"))
        out = out.union(newest)
    return out.select("node", "depth", "span", (F.col("left") + F.col("span") / 2).alias("x"))


def _text_height(text: Column, box: int, font: int) -> Column:
    return tm.text_height(F.length(F.coalesce(text, F.lit(""))), box, font)


def sized_layout(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``nodes(node, kind, text)`` and ``edges(src, place, dst, label)`` to ``(root, at, node, place, depth, x, y, w, h, cyclic)``.

    Boxes of all trees, each from its own root at 0. A box's height follows its text; a subtree is as wide as its root or
    its children side by side, and children stand in the middle below their parent, in the order of ``place``, under the
    labels of their options. Labels are rows too, with the ``place`` of their option; boxes have none. A node that two
    options lead to stands twice: ``at`` is the way to a row, the places of its options. A child without a row in ``nodes``
    takes no room and gets no box, but its label stands; so does one that is among its own ancestors, which is reported as
    ``cyclic``, without coordinates. Results (kind ``result``) have no children.

    Three passes level by level: down for the ways, up for the sizes, each a sum over a level's children, and down again
    for the offsets. A parent's own children are ordered in one task.
    """
    box = F.when(F.col("kind") == "result", 240).otherwise(280)
    high = F.when(F.col("kind") == "result", 16 + _text_height(F.col("text"), 240 - 28, 10)).otherwise(_text_height(F.col("text"), 280 - 28, 11)) + 28
    sizes = nodes.select("node", (F.col("kind") != "result").alias("open"), box.cast("double").alias("w"), F.greatest(high, F.lit(50)).cast("double").alias("h"))
    options = edges.select("src", "place", "dst", F.greatest(_text_height(F.col("label"), 150 - 16, 10) + 10, F.lit(24)).cast("double").alias("label_h"))
    known = lambda df: checkpoint(df.join(sizes, "node", "left").withColumn("cyclic", F.array_contains(F.slice("path", 1, F.size("path") - 1), F.col("node"))))
    levels = [known(roots.select(F.col("node").alias("root"), F.lit("").alias("at"), F.lit(None).cast("string").alias("up"), "node", F.lit(0).alias("place"), F.lit(0.0).alias("label_h"), F.array("node").alias("path")))]
    while True:
        above = levels[-1].where("open and not cyclic").select("root", F.col("at").alias("up"), F.col("node").alias("src"), "path")
        down = known(above.join(options, "src").select("root", F.concat_ws(".", F.when(F.col("up") != "", F.col("up")), F.col("place").cast("string")).alias("at"), "up", F.col("dst").alias("node"), "place", "label_h", F.concat("path", F.array("dst")).alias("path")))
        if down.isEmpty():
            break
        if len(levels) > max_depth:
            raise RuntimeError(f"a tree is deeper than {max_depth}")
        levels.append(down)
    # up: the size of each subtree
    below, measured = None, []
    for level in reversed(levels):
        drawn = F.col("w").isNotNull() & ~F.col("cyclic")
        own = level.drop("path", "open").withColumn("drawn", drawn)
        if below is not None:
            sums = below.groupBy("root", F.col("up").alias("at")).agg((F.sum("tree_w") + (F.count("*") - 1) * NODE_GAP).alias("row_w"), F.max("tree_h").alias("row_h"), F.max("label_h").alias("most"))
            own = own.join(sums, ["root", "at"], "left")
        else:
            own = own.withColumns({"row_w": F.lit(None).cast("double"), "row_h": F.lit(None).cast("double"), "most": F.lit(None).cast("double")})
        row_y = F.col("h") + DROP + 2 * LABEL_GAP + F.col("most")
        own = own.withColumns({"tree_w": F.when(~F.col("drawn"), 0.0).otherwise(F.greatest("w", "row_w")), "row_y": row_y})
        below = checkpoint(own.withColumn("tree_h", F.when(~F.col("drawn"), 0.0).otherwise(F.coalesce(F.col("row_y") + F.col("row_h"), "h"))))
        measured.append(below)
    # down: where each subtree begins
    measured.reverse()
    before = Window.partitionBy("root", "up").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpoint(measured[0].withColumns({"left": F.lit(0.0), "top": F.lit(0.0), "label_y": F.lit(None).cast("double")}))
    every = [placed]
    for level in measured[1:]:
        above = placed.select("root", F.col("at").alias("up"), (F.col("left") + (F.col("tree_w") - F.col("row_w")) / 2).alias("_from"), (F.col("top") + F.col("row_y")).alias("top"), (F.col("top") + F.col("h") + DROP + LABEL_GAP).alias("label_y"))
        moved = level.join(above, ["root", "up"]).withColumn("left", F.col("_from") + F.coalesce(F.sum(F.col("tree_w") + NODE_GAP).over(before), F.lit(0.0)))
        placed = checkpoint(moved.select(*every[0].columns))
        every.append(placed)
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    depth = F.when(F.col("at") == "", 0).otherwise(F.size(F.split("at", r"\.")))
    none = F.lit(None).cast("double")
    boxes = out.where("drawn or cyclic").select("root", "at", "node", F.lit(None).cast("int").alias("place"), depth.alias("depth"), *[F.when(F.col("drawn"), v).otherwise(none).alias(c) for c, v in (("x", F.col("left") + (F.col("tree_w") - F.col("w")) / 2), ("y", F.col("top")), ("w", F.col("w")), ("h", F.col("h")))], "cyclic")
    labels = out.where("up is not null").select("root", "at", "node", F.col("place").cast("int"), (depth - 1).alias("depth"), (F.col("left") + F.col("tree_w") / 2 - 75).alias("x"), F.col("label_y").alias("y"), F.lit(150.0).alias("w"), F.col("label_h").alias("h"), F.lit(False).alias("cyclic"))
    return boxes.union(labels)


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes that no root leads to."""
    return nodes.join(depths(edges, roots, max_depth), "node", "left_anti").select("node")


def walk(choices: DataFrame) -> DataFrame:
    """``(walk_id, step, action, node)`` to ``(walk_id, path)``: choose appends, back drops the last node, reset all but the first.

    The log of one walk is folded in the order of its steps.
    """
    log = choices.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("step", "action", "node"))).alias("log"))
    fold = """aggregate(log, cast(array() as array<string>), (p, s) -> case s.action
        when 'choose' then concat(p, array(s.node)) when 'back' then slice(p, 1, greatest(1, size(p) - 1)) when 'reset' then slice(p, 1, 1) else p end)"""
    return log.select("walk_id", F.expr(fold).alias("path"))


def on_path(path: Column, node: Column) -> Column:
    """Whether an option's node lies on the chosen path."""
    return F.coalesce(F.array_contains(path, node), F.lit(False))
