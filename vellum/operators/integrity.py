"""Digests of rows and tables, split plans, and the proof that parts rebuild their source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.functions import text as tx
from vellum.sources.staging import checkpoint

SAFE_ID = "^[a-z0-9][a-z0-9-]*$"


def digest(value: Column) -> Column:
    return F.upper(F.sha2(value, 256))


def table_digest(rows: DataFrame, key: str, text: str, *groups: str) -> DataFrame:
    """``(*groups, n, digest)``: one digest per group over its rows, in levels, so no task hashes a whole group.

    Rows are digested, then the rows of each stretch of 4,096 integer keys in the order of key and digest, then 4,096
    stretches at a time, then those of a group: each digest is that of the ones below it, joined in order. Null keys are spread by
    their text.
    """
    level = rows.select(*groups, F.coalesce(F.col(key).cast("long"), -F.abs(F.xxhash64(text)).bitwiseAND((1 << 40) - 1) - 1).alias("_key"), F.lit(1).cast("long").alias("_n"), digest(F.concat(F.col(key).cast("string"), F.lit("\u0000"), F.coalesce(text, F.lit("")))).alias("_digest"))
    for up in (F.shiftright("_key", 12), F.shiftright("_key", 12), F.lit(0).cast("long")):
        below = F.array_sort(F.collect_list(F.struct("_key", "_digest")))
        level = level.groupBy(*groups, up.alias("_up")).agg(F.sum("_n").alias("_n"), digest(F.array_join(F.transform(below, lambda x: x["_digest"]), "")).alias("_digest")).withColumnRenamed("_up", "_key")
    return level.select(*groups, F.col("_n").alias("n"), F.col("_digest").alias("digest"))


def rebuild(parts: DataFrame, pos: str, text: str, *groups: str) -> DataFrame:
    """The parts of each group joined in order; meant for the parts of one document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    return parts.groupBy(*groups).agg(F.array_join(ordered, "").alias("text"))


def split_problems(plan: DataFrame) -> DataFrame:
    """``(id, problem)`` of ids that are unsafe as file names or occur more than once."""
    unsafe = plan.where(~F.coalesce(F.col("id").rlike(SAFE_ID), F.lit(False))).select("id", F.lit("unsafe id").alias("problem"))
    return unsafe.union(plan.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id")))


def manifest(files: DataFrame) -> DataFrame:
    """``(id, raw)`` files to their sizes and digests."""
    return files.select("id", F.octet_length("raw").cast("long").alias("raw_bytes"), digest(F.col("raw")).alias("raw_sha256"))


def verify(known: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, status)``: ok, changed, missing or unexpected, of files held against a manifest."""
    now = manifest(files).withColumnsRenamed({"raw_bytes": "_bytes", "raw_sha256": "_sha"})
    both = known.join(now, "id", "full")
    same = (F.col("raw_bytes") == F.col("_bytes")) & (F.col("raw_sha256") == F.col("_sha"))
    return both.select("id", F.when(F.col("_sha").isNull(), "missing").when(F.col("raw_sha256").isNull(), "unexpected").when(same, "ok").otherwise("changed").alias("status"))


def json_strings(documents: DataFrame) -> DataFrame:
    """``(key, raw)`` to ``(key, n, path, value)``: every string of a JSON document with its pointer, in document order.

    Works on any structure, so it is a small Python helper over Arrow batches; documents that are broken or nested too deeply
    for the decoder yield nothing.
    """

    def walk(value, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, str):
            yield path, value
        elif isinstance(value, list):
            for i, x in enumerate(value):
                yield from walk(x, f"{path}/{i}")
        elif isinstance(value, dict):
            for k, x in value.items():
                yield from walk(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, raw in zip(frame["key"], frame["raw"], strict=True):
                try:
                    parsed = json.loads(raw)
                    rows += [(key, n, path, value) for n, (path, value) in enumerate(list(walk(parsed, "")))]
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["key", "n", "path", "value"])

    return documents.select("key", "raw").mapInPandas(run, f"key {documents.schema['key'].dataType.simpleString()}, n int, path string, value string")


def strings_digest(documents: DataFrame) -> DataFrame:
    """``(key, raw)`` to ``(key, n, digest)``: one digest over all strings of a JSON document with their pointers, in order.

    It is taken of the JSON text of the list of pairs, so it doesn't depend on blanks or numbers of the document. Documents
    that are broken, or have no string, have no row.
    """
    pair = F.struct("n", F.array("path", "value").alias("p"))
    listed = json_strings(documents).groupBy("key").agg(F.array_sort(F.collect_list(pair)).alias("l"))
    return listed.select("key", F.size("l").cast("long").alias("n"), digest(F.to_json(F.transform("l", lambda x: x["p"]))).alias("digest"))


_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{}]', re.S)
_BLANKS = re.compile(r"\s*")
_SCALAR = re.compile(r"[^\s,\]}]+")


class _Broken(ValueError):
    """What is wrong with a JSON text, and at which sign."""


def _value_end(raw: str, at: int) -> int:
    """Where the value that begins at ``at`` ends; brackets are matched with a stack, so its depth doesn't matter."""
    first = raw[at : at + 1]
    if first not in ('"', "{", "["):
        if not (m := _SCALAR.match(raw, at)):
            raise _Broken("value expected", at)
        return m.end()
    stack = []
    for m in _MARK.finditer(raw, at):
        mark = m[0]
        if mark == '"':
            raise _Broken("string without end", m.start())
        if mark in ("{", "["):
            stack.append("}" if mark == "{" else "]")
        elif mark in ("}", "]"):
            if mark != stack.pop():
                raise _Broken("wrong closing bracket", m.start())
        if not stack:
            return m.end()
    raise _Broken("brackets without end", at)


def _elements(raw: str, prop: str) -> list[tuple[int, int]]:
    """Where the elements of the root's array ``prop`` begin and end. The whole text is read, so any break in it is found."""
    skip = lambda i: _BLANKS.match(raw, i).end()

    def items(at: int, close: str, one) -> int:
        """Read ``one`` after the other from behind an opening bracket; the place behind its closing one."""
        at = skip(at)
        while raw[at : at + 1] != close:
            at = skip(one(at))
            if raw[at : at + 1] == ",":
                at = skip(at + 1)
                if raw[at : at + 1] == close:
                    raise _Broken("value expected", at)
            elif raw[at : at + 1] != close:
                raise _Broken(f"comma or {close} expected", at)
        return at + 1

    found: list[tuple[int, int]] | None = None

    def element(at: int) -> int:
        found.append((at, _value_end(raw, at)))
        return found[-1][1]

    def member(at: int) -> int:
        nonlocal found
        if raw[at : at + 1] != '"':
            raise _Broken("name expected", at)
        end = _value_end(raw, at)
        name = raw[at + 1 : end - 1]
        at = skip(end)
        if raw[at : at + 1] != ":":
            raise _Broken("colon expected", at)
        at = skip(at + 1)
        if found is None and (json.loads(f'"{name}"', strict=False) if "\\" in name else name) == prop:
            if raw[at : at + 1] != "[":
                raise _Broken("array expected", at)
            found = []
            _value_end(raw, at)  # an array without end is reported where it begins
            return items(at + 1, "]", element)
        return _value_end(raw, at)

    at = skip(0)
    if raw[at : at + 1] != "{":
        raise _Broken("object expected", at)
    at = skip(items(at + 1, "}", member))
    if at != len(raw):
        raise _Broken("end expected", at)
    if found is None:
        raise _Broken("no such property", len(raw))
    return found


def array_slices(sources: DataFrame, prop: str) -> DataFrame:
    """``(key, raw)`` to ``(key, pos, begin, end, element, problem, problem_at)``: the elements of the root's array ``prop``,
    byte for byte as written.

    A document that is broken has no elements but one row that says what is wrong and at which sign, counted from 0; so has
    one without the property. Null texts count as empty. Spark's JSON functions write values anew, so the brackets are
    scanned here, text by text; numbers and names such as ``true`` are not looked into. Where the schema is known and the
    bytes don't matter, from_json is the better way.
    """
    schema = pa.schema([("key", to_arrow_type(sources.schema["key"].dataType)), ("pos", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("element", pa.string()), ("problem", pa.string()), ("problem_at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = raw or ""
                try:
                    rows = [{"key": key, "pos": n, "begin": a, "end": b, "element": raw[a:b]} for n, (a, b) in enumerate(_elements(raw, prop))]
                except _Broken as broken:
                    rows = [{"key": key, "problem": broken.args[0], "problem_at": broken.args[1]}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("key", "raw").mapInArrow(run, f"key {sources.schema['key'].dataType.simpleString()}, pos int, begin int, end int, element string, problem string, problem_at int")


def chapter_facts(files: DataFrame) -> DataFrame:
    """``(source, file, raw)`` to what a manifest states of each file: ``(source, file, id, raw_bytes, raw_sha256, string_count,
    string_sha256, sections, qas, section_ids, semantic_sha256, object, ended)``.

    A file is one JSON object and one line end, which isn't part of it; ``ended`` tells whether it is there. Broken JSON
    leaves what depends on it null.
    """
    read = files.withColumns({"ended": F.endswith("raw", F.lit("\n")), "object": F.regexp_replace("raw", r"\r?\n\z", "")})
    parsed = F.from_json("object", "id string, sections array<struct<title: string, qas: array<string>>>")
    read = read.withColumn("p", parsed).withColumn("key", F.to_json(F.struct("source", "file")))
    strings = strings_digest(read.select("key", F.col("object").alias("raw"))).select("key", F.col("n").alias("string_count"), F.col("digest").alias("string_sha256"))
    sections = F.coalesce("p.sections", F.array().cast("array<struct<title: string, qas: array<string>>>"))
    ids = F.transform(sections, lambda s, i: tx.section_slug(F.col("p.id"), s["title"], i))
    return read.join(strings, "key", "left").select(
        "source", "file", F.col("p.id").alias("id"), F.octet_length("object").cast("long").alias("raw_bytes"), digest(F.col("object")).alias("raw_sha256"), F.coalesce("string_count", F.lit(0)).cast("long").alias("string_count"), "string_sha256",
        F.size(sections).cast("long").alias("sections"), F.aggregate(sections, F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.size(s["qas"]), F.lit(0))).alias("qas"), F.to_json(ids).alias("section_ids"),
        digest(F.to_json(F.try_parse_json("object"))).alias("semantic_sha256"), "object", "ended",
    )


FACTS = {"id": "chapter id", "raw_bytes": "raw bytes", "raw_sha256": "raw digest", "string_count": "string count", "string_sha256": "string digest", "sections": "section count", "qas": "question count", "section_ids": "section routes"}
TOTALS = ("chapters", "sections", "qas", "strings")


def source_facts(facts: DataFrame, separators: DataFrame, suffix: str = "") -> DataFrame:
    """What a manifest states of each source: sizes and digests of its chapters joined in order, and its totals.

    ``separators(source, file, pos, separator)`` orders the files and gives what stands before each. A source is one file
    that was split, so its parts are gathered to be hashed.
    """
    parts = separators.join(facts, ["source", "file"])
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.lit("")).alias("x")))), lambda x: x["x"])
    whole = F.concat(F.array_join(in_order(F.concat("separator", "object")), ""), F.lit(suffix))
    joined = parts.groupBy("source").agg(whole.alias("_whole"), digest(F.array_join(in_order(F.col("semantic_sha256")), "")).alias("semantic_sha256"), F.count("*").alias("chapters"), F.sum("sections").alias("sections"), F.sum("qas").alias("qas"), F.sum("string_count").alias("strings"))
    return joined.select("source", F.octet_length("_whole").cast("long").alias("bytes"), digest(F.col("_whole")).alias("sha256"), "semantic_sha256", *TOTALS)


def verification(chapters: DataFrame, sources: DataFrame, order: DataFrame, files: DataFrame, version: int = 1, suffix: str = "") -> DataFrame:
    """``(source, check, subject, expected, actual, ok)``: every assertion that files still are what their manifest says.

    ``chapters(source, pos, file, separator, <FACTS>)`` and ``sources(source, version, bytes, sha256, semantic_sha256,
    <TOTALS>)`` are the manifest, ``order(source, pos, id)`` the order in use, ``files(source, file, raw)`` what is there. Of
    each source: the manifest's version, the order (a row for each place, joined in full, so a shift shows where it begins),
    the set of files (a row for each file on either side), bytes and digest of the joined source, the digest of its content
    and four totals. Of each file on both sides: its line end, the order's place and the eight FACTS. The subject is a file, a
    place or empty.
    """
    facts = checkpoint(chapter_facts(files))
    row = lambda check, subject, expected, actual: F.struct(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), F.col(expected).cast("string").alias("expected"), F.col(actual).cast("string").alias("actual"))
    stated = chapters.select("source", "file", "pos", *[F.col(c).alias(f"_{c}") for c in FACTS])
    both = stated.join(facts.drop("object", "semantic_sha256"), ["source", "file"], "full").withColumns({"_there": F.col("ended").isNotNull(), "_stated": F.col("pos").isNotNull(), "_yes": F.lit(True)})
    used = order.select(F.col("source").alias("_of"), F.col("pos").alias("place"), F.col("id").alias("used"))
    shared = both.where("_there and _stated").join(used, (F.col("source") == F.col("_of")) & (F.col("pos") == F.col("place")), "left")
    per_file = shared.select("source", F.inline(F.array(row("line end", "file", "_yes", "ended"), row("chapter order", "file", "used", "id"), *[row(name, "file", f"_{c}", c) for c, name in FACTS.items()])))
    sets = both.select("source", F.inline(F.array(row("file set", "file", "_stated", "_there"))))
    listed = chapters.select("source", "pos", F.col("id").alias("stated_id")).join(order, ["source", "pos"], "full").select("source", F.inline(F.array(row("order", "pos", "stated_id", "id"))))
    now = source_facts(facts, chapters.select("source", "file", "pos", "separator"), suffix).withColumnsRenamed({c: f"_{c}" for c in ("bytes", "sha256", "semantic_sha256", *TOTALS)})
    whole = sources.join(now, "source", "left").withColumns({"_none": F.lit(""), "_version": F.lit(version)})
    names = {"version": "version", "bytes": "source bytes", "sha256": "source digest", "semantic_sha256": "content digest", **{c: f"total {c}" for c in TOTALS}}
    per_source = whole.select("source", F.inline(F.array(*[row(name, "_none", c, f"_{c}") for c, name in names.items()])))
    every = per_file.union(sets).union(listed).union(per_source)
    return every.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))
