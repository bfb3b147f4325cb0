"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents of a source are ordered by hash; their sums are first taken over equal slices of the hash range, so many of
#: them that the largest source can't have more than about so many documents in one.
SLICE_ROWS = 65_536


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``source, source_size[, weight]`` to the same with ``target``.

    ``budget`` times all sizes is shared in proportion to the weights; a source takes ``max_epochs`` times its size at
    most, and what it can't take goes to the others by weight, until none is above. The fixpoint is found at once: in
    the order of cap per weight, the sources up to some place are full and the rest share what is left. One row for
    each source: that is all the global order sorts. Without a weight column, ``weights`` repeat over the sources by
    code point, null last. Targets can't exceed the caps' sum, should the budget do so. Empty sources get 0.
    """
    if weights:
        place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
        sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = sources.withColumn("cap", F.col("source_size") * float(max_epochs))
    sums = caps.select(
        "*",
        F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
        (F.sum("source_size").over(every) * float(budget)).alias("total"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_from")
    full = F.col("weight") * level >= F.col("cap")
    # once a source isn't full, all later ones share at that source's level
    marked = sums.withColumn("level", F.when(~full, level))
    level = F.first("level", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("target", F.coalesce(F.col("weight") * level, F.col("cap"))).select(*sources.columns, "target")


def slice_digits(rows: int, most: int = SLICE_ROWS) -> int:
    """Hexadecimal digits that cut so many rows into slices of ``most`` or fewer on average, one at least."""
    digits = 1
    while rows > most * 16**digits:
        digits += 1
    return digits


def plan(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, digest, source_size, target, copies, part)`` for every row of ``docs``.

    A source whose target is k and a fraction times its size takes each document k times, and once more as many as the
    fraction asks for, in the order of a seeded hash of doc_id and size: documents whose words fit go whole, and the one
    at the boundary gives its first ``part`` words. taken = copies * size + part, and a source's sum is its target to the
    nearest word.

    The running sums are taken in two levels, first over equal slices of each source's hash range and then inside the
    one slice that holds the boundary, so no task orders a whole source. The slices follow the number of rows; the order
    doesn't depend on them. Null texts have size 0; a null source is a source
    of its own; rows equal in doc_id and size tie: they share one hash, and one after another takes its part in the
    order of their other columns. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary")))
    rows = stage(rows, "mixing-sizes")
    rows = rows.withColumn("slice", F.substring("digest", 1, slice_digits(rows.count())))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"), F.count("*").alias("n"))
    sources = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), budget, max_epochs, weights)
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("extra", F.round("target").cast("long") - F.col("copies") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    levels = slices.join(sources, slices["source"].eqNullSafe(sources["source"])).select(slices["source"], "slice", "slice_size", "slice_before", "source_size", "target", "copies", "extra")
    keyed = rows.join(levels.withColumnRenamed("source", "_source").withColumnRenamed("slice", "_slice"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))).drop("_source", "_slice")
    left = F.col("extra") - F.col("slice_before")
    columns = ("doc_id", "source", "size", "digest", "source_size", "target", "copies")
    boundary = (left > 0) & (left < F.col("slice_size"))
    whole = keyed.where(~boundary).select(*columns, F.when(left > 0, F.col("size")).otherwise(0).alias("part"))
    inside = Window.partitionBy("source", "slice").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = keyed.where(boundary).withColumn("own_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.select(*columns, F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("own_before"))).alias("part"))
    return whole.union(cut)


def taken(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs`` (see plan)."""
    out = plan(docs, budget, max_epochs, weights, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as the plan says, the partial one cut after its
    ``part`` words (n_chars, if there, follows the cut). Rows that the plan takes nothing of go.

    doc_id is the key here: rows that repeat one are told apart by their source and size, and equal ones are all repeated
    alike.
    """
    decided = plan(docs, budget, max_epochs, weights, seed).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("_copies"), F.max("part").alias("_part"))
    decided = decided.where("_copies > 0 or _part > 0").withColumnsRenamed({"doc_id": "_doc", "source": "_of", "size": "_size"})
    # the caller's columns travel in one struct, so none of their names can clash
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), word_count(F.col("text").cast("string")).alias("_words"))
    joined = sized.join(decided, F.col("_id").eqNullSafe(F.col("_doc")) & F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_words") == F.col("_size")))
    whole = F.col("_copies") + F.when((F.col("_part") > 0) & (F.col("_part") == F.col("_size")), 1).otherwise(0)
    some = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    repeats = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(some, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = joined.select("_row", "_part", F.explode(repeats).alias("_n"))
    first = F.expr(r"array_join(slice(regexp_extract_all(_row.text, '[^\\x20\\x09-\\x0D]+', 0), 1, cast(_part as int)), ' ')")
    changed = {"text": F.when(F.col("_n"), first).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n"), F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
