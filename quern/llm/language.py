"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For each place of the code a binary
naive Bayes classifier on hashed character n-grams tells the languages with +1 from
the others; its margin for a text is the mean log-odds of the text's n-grams
over the margins' spread in training. Decoding sums, for each codeword, the
exponential losses of the places, weighted by how far each place's classifier can
be trusted: its expected error on rows that it was not fitted on, in folds. The
codeword with the least loss wins, the first language by name on a tie. A text
whose two best codewords lie close together is flagged as ambiguous.

Fitting takes at most ``FIT_ROWS`` labelled rows (smallest hash of their id);
prediction reads every whole text. Defined results: null texts and texts
without a letter are ``und`` with score 0; without labelled rows all are;
null languages are not learned; repeated rows are predicted each; with one
language only, every text with a letter gets it; other columns pass through, and
columns of the new ones' names are replaced; an empty table gives no row.
"""

from __future__ import annotations

import re
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

FIT_ROWS = 20_000
SIZES = (2, 3)
BITS = 17
#: A text is ambiguous if its second-best language has at least this share of the best one's score.
AMBIGUOUS = 0.5
RANDOM_CODE_BITS = 31
RANDOM_CODES = 40
#: The labelled rows are dealt to so many folds; each place's trust is measured on the fold that it has not seen.
FOLDS = 3
#: How fast a language's score falls with its codeword's loss.
SHARPNESS = 4.0
_LETTER = re.compile(r"[^\W\d_]")


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1 and -1: every split of the languages up to six; beyond, of many random codes the one whose rows lie furthest apart."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        columns = [[1] + [1 if (c >> j) & 1 else -1 for j in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    places = max(RANDOM_CODE_BITS, 4 * (k - 1).bit_length())
    for _ in range(RANDOM_CODES):
        found: dict[tuple, np.ndarray] = {}
        while len(found) < places:
            column = np.where(rng.permutation(k) < k // 2, 1.0, -1.0)
            found[tuple(column * column[0])] = column * column[0]
        code = np.array(list(found.values())).T
        least = int(((places - code @ code.T) / 2 + places * np.eye(k)).min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x places
    odds: np.ndarray  # n-gram hashes x places
    spread: np.ndarray  # of the margins, per place
    trust: np.ndarray  # weight of each place in decoding

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for code in codes(code_points(text), SIZES, BITS):
            total += self.odds[code].sum(axis=0, dtype=np.float64)
            n += len(code)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, False
        m = np.clip(self.margins(text) / self.spread, -4, 4)
        loss = (np.exp(-self.code * m) * self.trust).sum(axis=1) / self.trust.sum()
        share = np.exp(-SHARPNESS * (loss - loss.min()))
        share /= share.sum()
        best = int(np.argmin(loss))
        second = float(np.partition(share, -2)[-2]) if len(share) > 1 else 0.0
        return self.languages[best], float(share[best]), second >= AMBIGUOUS * float(share[best])


def _counts(languages: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, language and fold: sums of the texts' n-gram shares, so that a long text counts as one."""
    sums, place = {}, {x: i for i, x in enumerate(languages)}
    for batch in slices(batches):
        for text, lang, fold in zip(texts_of(batch, "text"), texts_of(batch, "lang"), texts_of(batch, "fold")):
            if text and (found := list(codes(code_points(text), SIZES, BITS))):
                own, n = sums.setdefault((place[lang], fold), np.zeros(1 << BITS)), sum(map(len, found))
                for code in found:
                    np.add.at(own, code, 1.0 / n)
    yield from _rows(sums)


def _rows(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, fold), own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), pa.array([fold], pa.int32()), pa.array([own.astype("<f4").tobytes()], pa.binary())], ["lang", "fold", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for lang, fold, own in zip(*(batch.column(k) for k in range(3))):
            sums.setdefault((lang.as_py(), fold.as_py()), np.zeros(1 << BITS))[:] += np.frombuffer(own.as_py(), "<f4")
    yield from _rows(sums)


def _odds(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds of every n-gram at every place of the code, from the languages' sums."""
    share = (sums + 1e-4) / (sums + 1e-4).sum(axis=1, keepdims=True)
    plus, minus = (code.T > 0).astype(float), (code.T < 0).astype(float)
    mean = lambda side: (side / np.maximum(side.sum(axis=1, keepdims=True), 1)) @ share
    return np.ascontiguousarray(np.clip((np.log(mean(plus) + 1e-12) - np.log(mean(minus) + 1e-12)).T, -8, 8), np.float32)


def _margins(models, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's margins by the classifiers that have not seen its fold."""
    for batch in slices(batches):
        found = [models.value[k].margins(t).astype("<f8").tobytes() if t else None for t, k in zip(texts_of(batch, "text"), texts_of(batch, "fold"))]
        yield pa.RecordBatch.from_arrays([pa.array(texts_of(batch, "lang"), pa.string()), pa.array(found, pa.binary())], ["lang", "margins"])


def fit(df: DataFrame, rows: int = FIT_ROWS) -> Model:
    """``df``: doc_id, text, lang of training rows only. At most ``rows`` of them are used."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "language-fit")
    told = df.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    picked = bounded_sample(told.select("doc_id", "lang"), "doc_id", rows).select("doc_id").distinct()
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")  # equal texts share one
    sample = materialize(told.join(F.broadcast(picked), "doc_id").select("text", "lang", fold), "language-fit", path).repartition(6)
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if len(languages) < 2:
        remove(spark, path)
        return Model(languages, np.ones((len(languages), 1)), np.zeros((1 << BITS, 1), np.float32), np.ones(1), np.ones(1))
    sums = np.zeros((FOLDS, len(languages), 1 << BITS))
    partial_sums = sample.mapInArrow(partial(_counts, languages), "lang int, fold int, sums binary")
    for r in partial_sums.repartition("lang").mapInArrow(_added, "lang int, fold int, sums binary").toLocalIterator():
        sums[r.fold, r.lang] += np.frombuffer(r.sums, "<f4")
    code = codewords(len(languages))
    model = Model(languages, code, _odds(sums.sum(axis=0), code), np.ones(code.shape[1]), np.ones(code.shape[1]))
    unseen = [Model(languages, code, _odds(sums.sum(axis=0) - sums[k], code), model.spread, model.trust) for k in range(FOLDS)]
    sent = spark.sparkContext.broadcast(unseen)
    got = [r for r in sample.mapInArrow(partial(_margins, sent), "lang string, margins binary").collect() if r.margins]
    sent.unpersist()
    remove(spark, path)
    if got:
        m = np.array([np.frombuffer(r.margins, "<f8") for r in got])
        want = code[[languages.index(r.lang) for r in got]]
        model.spread = np.maximum(np.abs(m).mean(axis=0), 1e-6)
        # expected errors rather than counted ones: they differ between places that get every row right
        wrong = np.clip((1 / (1 + np.exp(np.clip(2 * m * want / model.spread, -30, 30)))).mean(axis=0), 1e-6, 0.49)
        model.trust = 0.5 * np.log((1 - wrong) / wrong)
    return model


def _predict(model, text: str, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [model.value.predict(t) for t in texts_of(batch, text)]
        told = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *told], [*keep, "lang_pred", "score", "ambiguous"])


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with lang_pred, score and ambiguous; columns of these names are replaced."""
    ship(df.sparkSession)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    keep = [c for c in keep or df.columns if c not in {f.name for f in new}]
    sent = df.sparkSession.sparkContext.broadcast(model)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(partial(_predict, sent, text, keep), T.StructType([*(df.schema[c] for c in keep), *new]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
