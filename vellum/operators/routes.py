"""Addresses to routes: an ordered ladder of rules over three small lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx


def segments(path: Column) -> Column:
    """The non-empty decoded parts of a path; malformed codes become empty strings."""
    return F.transform(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != ""), tx.decode_component)


def hash_value(fragment: Column) -> Column:
    """What follows the ``#``, decoded."""
    return tx.decode_component(F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#", ""))


def parse_routes(urls: DataFrame, chapters: DataFrame, sections: DataFrame, trees: DataFrame) -> DataFrame:
    """``(path, fragment)`` and any other columns to the same with ``active_section, active_id, anchor, canonical_url``.

    ``chapters(id)``, ``sections(section_id, chapter_id)`` (the last owner of a repeated id counts: give ``pos`` to order
    them) and ``trees(id)`` are matched by equi-joins on the second path part and on the hash. Unknown addresses fall back to
    their hash and then to home.
    """
    rows = urls.withColumns({"_s": segments(F.col("path")), "_h": hash_value(F.col("fragment")), "_f": F.regexp_replace(F.coalesce("fragment", F.lit("")), "^#?", "#")})
    rows = rows.withColumns({"_a": F.coalesce(F.get("_s", F.lit(0)), F.lit("")), "_b": F.coalesce(F.get("_s", F.lit(1)), F.lit("")), "_n": F.size("_s")})
    order = "pos" if "pos" in sections.columns else "chapter_id"
    owners = sections.groupBy("section_id").agg(F.max_by("chapter_id", order).alias("_owner")).withColumnRenamed("section_id", "_section")
    known = lambda df, name: df.select(F.col("id").alias(name)).distinct()
    for table, name, on in ((chapters, "_c2", "_b"), (trees, "_t2", "_b"), (chapters, "_ch", "_h"), (trees, "_th", "_h")):
        side = known(table, name)
        rows = rows.join(side, rows[on] == side[name], "left")
    rows = rows.join(owners, rows["_h"] == owners["_section"], "left")
    enc = tx.encode_component
    a, b, h, n = F.col("_a"), F.col("_b"), F.col("_h"), F.col("_n")
    route = lambda section, key, url, anchor=None: F.struct(F.lit(section).alias("active_section"), (F.lit(key) if isinstance(key, str) else key).alias("active_id"), F.lit(anchor).cast("string").alias("anchor") if anchor is None else anchor.alias("anchor"), (F.lit(url) if isinstance(url, str) else url).alias("canonical_url"))
    nothing = F.lit(None).cast("struct<active_section: string, active_id: string, anchor: string, canonical_url: string>")
    to_chapter = lambda c: route("code", c, F.concat(F.lit("/code/"), enc(c)))
    to_section = route("code", F.col("_owner"), F.concat(F.lit("/code/"), enc(F.col("_owner")), F.lit("#"), enc(h)), h)
    by_hash = F.when(h == "", nothing).when(F.col("_ch").isNotNull(), to_chapter(h)).when(F.col("_owner").isNotNull(), to_section).otherwise(nothing)
    to_quiz = lambda use: route("quiz", "quiz", F.when(use & (F.col("_f") != "#quiz") & (F.length("_f") > 1), F.concat(F.lit("/quiz"), F.col("_f"))).otherwise("/quiz"))
    legacy = F.when(h == "", nothing).when(F.startswith(h, F.lit("quiz")), to_quiz(F.lit(True))).when(F.startswith(h, F.lit("tppt")), route("tppt", "tppt-home", "/tppt")).when(F.col("_th").isNotNull(), route("trees", h, F.concat(F.lit("/trees/"), enc(h)))).otherwise(by_hash)
    home = route(None, "home", "/")
    out = (
        F.when(n == 0, F.coalesce(legacy, home))
        .when((a == "code") & (n == 1), F.coalesce(by_hash, route("code", "home", "/code")))
        .when((a == "code") & (n == 2) & F.col("_c2").isNotNull(), F.when(F.col("_ch").isNull() & F.col("_owner").isNotNull() & (h != ""), to_section).otherwise(to_chapter(b)))
        .when((a == "trees") & (n == 1), route("trees", "trees-home", "/trees"))
        .when((a == "trees") & (n == 2) & F.col("_t2").isNotNull(), route("trees", b, F.concat(F.lit("/trees/"), enc(b))))
        .when((a == "quiz") & (n == 1), to_quiz(F.startswith(h, F.lit("quiz"))))
        .when((a == "tppt") & (n == 1), route("tppt", "tppt-home", "/tppt"))
        .otherwise(F.coalesce(legacy, home))
    )
    return rows.withColumn("_r", out).select(*urls.columns, "_r.*")
