"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

SIZES = (3, 4, 5)
BITS = 20
#: At most so many labelled rows of each class are fitted on, chosen by hashed doc_id.
SAMPLE = 10_000
#: So many n-grams keep a weight, those whose presence tells the classes apart most surely.
KEEP = 8_192
MIN_DOCS = 2
SMOOTH = 1.0
RIDGE = 0.01
CHUNK = 1 << 17


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed character n-grams of the whole lower-cased text, repeats included, chunk by chunk."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            count = min(CHUNK, len(part) - n + 1)
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += part[k : k + count]
            h *= np.uint64(0xD6E8FEB86659FD93)
            yield (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The different n-grams of a text."""
    return np.unique(np.concatenate([np.unique(x) for x in grams(text)] or [np.zeros(0, np.int64)]))


@dataclass
class Model:
    """Weights of the kept n-grams (already multiplied by their log-count ratios) and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def held_out(doc_id: F.Column) -> F.Column:
    return (F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0)


def training_ids(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """About ``sample`` labelled doc_ids of each class outside the held-out fifth, and the number of all in each class.

    A larger class is thinned by a threshold on the hash of doc_id, set a twentieth low, so more than ``sample`` come out
    about never; no task gathers or sorts them. A doc_id with several labels counts as toxic if any says so; null labels
    and ids are ignored.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    totals = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    steps = 1 << 30
    keep = {c: steps if n <= sample else int(0.95 * steps * sample / n) for c, n in totals.items()}
    least = F.when(F.col("toxic") == 1, keep.get(1, 0)).otherwise(keep.get(0, 0))
    return one.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(steps)) < least).select("doc_id", F.col("toxic").cast("int")), totals


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["toxic", "grams"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[label, np.frombuffer(raw, "<i4")] += 1
    ids = np.flatnonzero(seen.any(0))
    for i in range(0, len(ids), 50_000):
        part = ids[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], ["gram", "clean", "toxic"])


def _vectors(ids: np.ndarray, ratio: np.ndarray):
    """A function of the n-grams of a row: those kept, each with its log-count ratio, as a sparse vector."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    def vector(raw: bytes):
        at = np.searchsorted(ids, own := np.frombuffer(raw, "<i4"))
        at = at[ids[np.minimum(at, len(ids) - 1)] == own]
        return Vectors.sparse(len(ids), at, ratio[at])

    return F.udf(vector, VectorUDT())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = KEEP) -> Model:
    """Fit on a bounded sample of the labelled rows; ``labels.toxic`` of the training part is all it learns from.

    The sampled texts are reduced to their n-grams once; counting n-grams per class and choosing the kept ones are Spark
    aggregations, and the logistic regression sums its gradients on the executors. Only the ``keep`` n-grams with their
    counts and weights reach the driver, however many or long the rows are. With no labelled row, or rows of one class only,
    the model is a constant: the smoothed share of toxic rows.
    """
    from pyspark.ml.classification import LogisticRegression

    ids, totals = training_ids(labels, sample)
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    # about two times `sample` ids at most: a bound for the broadcast that doesn't grow with the tables
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "text")
    rows = stage(chosen.mapInArrow(_extract, "toxic int, grams binary"), "toxicity-sample")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    counts = rows.mapInArrow(_count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / n[1] - F.col("clean") / n[0]
    spread = F.sqrt((F.col("toxic") + 1) / float(n[1]) ** 2 + (F.col("clean") + 1) / float(n[0]) ** 2)
    best = counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).withColumn("z", F.abs(share) / spread).orderBy(F.desc("z"), "gram").limit(keep).collect()
    if not best:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    best.sort(key=lambda r: r["gram"])
    kept = np.array([r["gram"] for r in best])
    p, q = (SMOOTH + np.array([r[c] for r in best], float) for c in ("toxic", "clean"))
    ratio = np.log((p / (n[1] + 2 * SMOOTH)) / (q / (n[0] + 2 * SMOOTH)))
    weight = F.when(F.col("toxic") == 1, toxic / n[1]).otherwise(clean / n[0])
    vectors = stage(rows.select(F.col("toxic").cast("double").alias("label"), weight.alias("weight"), _vectors(kept, ratio)("grams").alias("features")), "toxicity-vectors")
    fitted = LogisticRegression(weightCol="weight", regParam=RIDGE, standardization=False, maxIter=100).fit(vectors)
    return Model(kept, fitted.coefficients.toArray() * ratio, fitted.intercept)


def scorer(model: Model):
    """A vectorised function of a text column: the probability of label 1. Null texts count as empty."""
    from pyspark import SparkContext

    shared = SparkContext._active_spark_context.broadcast((model.dense(), model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        out = []
        for text in texts:
            found = [x[weights[x] != 0] for x in grams(text)]
            z = bias + float(weights[np.unique(np.concatenate(found))].sum()) if found else bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return pd.Series(out, dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    score is the probability of label 1, between 0 and 1; null and empty texts get the score of a text without any kept
    n-gram. Repeated rows get equal scores; a null doc_id has the remainder of the empty string. Only the text is an
    input of the score. Other columns of ``docs`` are not used. An empty table gives an empty one.
    """
    score = scorer(train(docs, labels, sample))
    out = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic. Null and empty texts are judged by the model's intercept;
    repeated rows stay or go alike; an empty table gives an empty one."""
    score = scorer(train(docs, labels, sample))
    return docs.where(score(F.col("text").cast("string")) < 0.5)
