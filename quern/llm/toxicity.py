"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of the lower-cased text. Labelled
rows give each n-gram its log-count ratio between the classes; those whose
ratio stands out of its own error are kept, and a logistic classifier is fitted
on presence times ratio. Fitting takes at most ``FIT_ROWS`` labelled rows (those
with the smallest hash of their id); scoring reads every whole text.

Defined results: a null or empty text has no n-gram and gets the score of the
intercept; of several labels of one document the largest counts; a null label
counts as none; with no labels, or one class only, each score is the share of
label 1 (0 without labels). Repeated rows are scored each; equal texts count
once in fitting, with the largest of their labels. Other columns pass through; a
column of the score's name is replaced. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bounded_sample, crc_mod, fresh_path, materialize, read_table, remove, ship
from quern.llm.grams import codes, slices, code_points, texts_of

FIT_ROWS = 12_000
SIZES = (3, 4, 5)
BITS = 20
#: An n-gram is kept if its log-count ratio is this many standard errors from 0 and it is in so many texts.
LEAST_ERRORS = 3.5
LEAST_TEXTS = 3
#: Weight of the quadratic penalty, for each training row.
PENALTY = 2e-3
STEPS = 200


@dataclass
class Model:
    place: np.ndarray  # hash -> feature, -1 for none
    weight: np.ndarray  # of a feature, its ratio included
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weight[present(text, self.place)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def present(text: str | None, place: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-gram hashes of a text, or with ``place`` its distinct features."""
    found = []
    for code in codes(code_points(text), SIZES, BITS):
        if place is not None:
            code = place[code]
            code = code[code >= 0]
        found.append(np.unique(code))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: the n-grams it saw and in how many texts."""
    counts, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in slices(batches):
        for text, label in zip(texts_of(batch, "text"), texts_of(batch, "toxic")):
            counts[label][present(text)] += 1
            rows[label] += 1
    for label in (0, 1):
        seen = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([label], pa.int32()), "rows": pa.array([int(rows[label])], pa.int64()), "grams": [seen.astype("<i4").tobytes()], "texts": [counts[label][seen].astype("<i4").tobytes()]})


def _features(place, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [present(t, place.value).astype("<i4").tobytes() for t in texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([pa.array(texts_of(batch, "toxic"), pa.int32()), pa.array(found, pa.binary())], ["toxic", "features"])


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a logistic classifier with a quadratic penalty, by accelerated gradient steps."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value, n, m = scale[flat], len(rows), len(scale)
    times = lambda w: np.bincount(owner, value * w[flat], n)
    back = lambda g: np.bincount(flat, value * g[owner], m)
    probe = np.ones(m)
    for _ in range(12):
        probe = back(times(probe)) + 1e-9
        top = np.linalg.norm(probe)
        probe /= top
    # the rarer class counts for more: rows weigh as if the classes stood at the square root of their real proportion
    share = y.mean()
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0)
    weight *= n / weight.sum()
    rate = 1 / (0.25 * weight.max() * (top + n) / n + PENALTY)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w2, b2 = w, b
    for k in range(STEPS):
        g = weight * (1 / (1 + np.exp(-np.clip(times(w2) + b2, -30, 30))) - y)
        w1, b1 = w2 - rate * (back(g) / n + PENALTY * w2), b2 - rate * g.mean()
        w2, b2 = w1 + k / (k + 3) * (w1 - w), b1 + k / (k + 3) * (b1 - b)
        w, b = w1, b1
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic; the caller leaves out held-out rows. At most ``rows`` are used."""
    spark = docs.sparkSession
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    path = fresh_path(spark, "toxic-fit")
    picked = bounded_sample(told, "doc_id", rows)  # at most ``rows`` ids: small enough to broadcast whatever the input
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-fit", path).repartition(6, "text")
    counts, total = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in sample.mapInArrow(_count, "toxic int, rows long, grams binary, texts binary").collect():
        counts[r.toxic][np.frombuffer(r.grams, "<i4")] += np.frombuffer(r.texts, "<i4")
        total[r.toxic] += r.rows
    if not total.all():
        remove(spark, path)
        share = np.clip((total[1] + 1e-9) / (total.sum() + 2e-9), 1e-9, 1 - 1e-9) if total.sum() else 1e-9
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log(share / (1 - share))))
    (q, p), smooth = counts, 1.0
    ratio = np.log((p + smooth) / (total[1] + 2 * smooth)) - np.log((q + smooth) / (total[0] + 2 * smooth))
    error = np.sqrt(1 / (p + smooth) + 1 / (q + smooth))
    chosen = np.flatnonzero((np.abs(ratio) >= LEAST_ERRORS * error) & (p + q >= LEAST_TEXTS))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = spark.sparkContext.broadcast(place)
    got = sample.mapInArrow(partial(_features, sent), "toxic int, features binary").collect()
    remove(spark, path)
    y = np.array([r.toxic for r in got], float)
    w, b = _logistic([np.frombuffer(r.features, "<i4") for r in got], y, ratio[chosen])
    return Model(place, w * ratio[chosen], b)


def _score(model, text: str, keep: list[str], name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = pa.array([model.value.score(t) for t in texts_of(batch, text)], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), scores], [*keep, name])


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the score of every whole text."""
    ship(df.sparkSession)
    keep = [c for c in keep or df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(partial(_score, sent, text, keep, name), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
