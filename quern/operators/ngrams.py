"""Language detection trained on labelled texts: naive Bayes over character n-grams, cut in Arrow batches.

A language's profile is its ``PROFILE`` most frequent n-grams of one to three
characters, in the first ``S.DETECT_CHARS`` characters of each text, lower-cased,
with everything that is no letter as one space. The vocabulary is what any profile
holds, so it has at most ``PROFILE`` n-grams a language and is broadcast; the weight
of an n-gram is the logarithm of its smoothed share of a language's n-grams in the
vocabulary. A text's language has the largest sum of weights, the first by name
on a tie; the confidence is its share of the languages' likelihoods.

An n-gram is one number, its characters' code points side by side in 21 bits each.
A task counts the n-grams of its own texts before they are shuffled, and a text is
scored where it lies, so no row is made for an n-gram of a text.

Defined results: texts without a language teach nothing; a text without an
n-gram of the vocabulary has no language and confidence 0; repeated rows count
each; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import schemas as S
from quern.operators.scratch import settled, ship

SIZES, PROFILE = (1, 2, 3), 400
#: Languages that one model may tell apart.
MOST_LANGUAGES = 256
#: Texts that a task takes apart at a time.
ROWS = 2_000


def plain(text: Column) -> Column:
    """A text's beginning, of which n-grams are cut: letters, and one space for all else."""
    return F.regexp_replace(F.lower(F.substring(text, 1, S.DETECT_CHARS)), r"[^\p{L}]+", " ")


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of plain texts as numbers, repeats too, and the text that each is in; none of a text without letters."""
    bare = [(t or "").strip(" ") for t in texts]
    texts = [f" {t} " if t else "" for t in bare]
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams, of = [c[c != ord(" ")]], [own[c != ord(" ")]]
    made = c
    for n in SIZES[1:]:
        made = (made[:-1] << 21) | c[n - 1 :]
        inside = own[: len(made)] == own[n - 1 :]
        grams.append(made[inside])
        of.append(own[: len(made)][inside])
    return np.concatenate(grams), np.concatenate(of)


def code(gram: str) -> int:
    """The number that stands for an n-gram."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, plain) to (lang, code, n): one row for each n-gram of a language in a stretch of ``ROWS`` texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            texts = batch.slice(start, ROWS).to_pandas()
            for lang, some in texts.groupby("lang")["plain"]:
                seen = pd.Series(codes(list(some))[0]).value_counts(sort=False)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.index.to_numpy(), pa.int64()), pa.array(seen.to_numpy(), pa.int64())], ["lang", "code", "n"])


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) to (lang, gram, n)."""
    for batch in batches:
        g = batch.column("code").to_numpy()
        g = np.where(g < 1 << 21, g << 42, np.where(g < 1 << 42, g << 21, g))  # the first character in front
        points = np.stack([g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF], axis=1).astype("<u4")
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(points.view("<U3")[:, 0].tolist(), pa.string()), batch.column("n")], ["lang", "gram", "n"])


def trained(texts: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[str]]:
    """(gram, weights: one for each language), and the languages in order."""
    ship(texts.sparkSession)
    rows = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), plain(F.col(text)).alias("plain"))
    summed = rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = settled(summed.mapInArrow(_spelt, "lang string, gram string, n long"), "ngrams")[0]
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return counts.select("gram", F.array().cast("array<double>").alias("weights")), []
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    vocabulary = counts.withColumn("_r", place).where(F.col("_r") <= PROFILE).select("gram").distinct()
    held = settled(counts.join(F.broadcast(vocabulary), "gram").groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, name in enumerate(languages))), "vocabulary")[0]
    size, *totals = held.agg(F.count(F.lit(1)), *(F.sum(f"n{k}") for k in range(len(languages)))).first()
    weights = F.array(*(F.ln((F.col(f"n{k}") + 1.0) / float((total or 0) + size)) for k, total in enumerate(totals)))
    return held.select("gram", weights.alias("weights")), languages


def detect(rows: DataFrame, model: tuple[DataFrame, list[str]], text: str = "text") -> DataFrame:
    """``rows`` with detected_lang and detected_confidence."""
    weights, languages = model
    rows = rows.drop("detected_lang", "detected_confidence")
    if not languages:
        return rows.withColumns({"detected_lang": F.lit(None).cast("string"), "detected_confidence": F.lit(0.0)})
    ship(rows.sparkSession)
    told = scorer(weights.orderBy("gram").collect(), languages)(plain(F.col(text)))
    return rows.withColumn("_told", told).withColumns({"detected_lang": F.col("_told.lang"), "detected_confidence": F.col("_told.confidence")}).drop("_told")


def scorer(held: list, languages: list[str]):
    """A function of plain texts that gives (lang, confidence). ``held``: the vocabulary's rows, of which the profiles' size and the languages bound the number."""
    vocabulary = pd.Index(np.array([code(r.gram) for r in held], dtype=np.int64))
    weights = np.array([r.weights for r in held]).reshape(len(held), len(languages))

    def score(texts: pd.Series) -> pd.DataFrame:
        parts = [_scored(texts.iloc[k : k + ROWS], vocabulary, weights, languages) for k in range(0, len(texts), ROWS)]
        return pd.concat(parts) if parts else pd.DataFrame({"lang": pd.Series(dtype="object"), "confidence": pd.Series(dtype="float64")})

    return F.pandas_udf(score, "lang string, confidence double")


def _scored(texts: pd.Series, vocabulary: pd.Index, weights: np.ndarray, languages: list[str]) -> pd.DataFrame:
    grams, of = codes(list(texts))
    place = vocabulary.get_indexer(grams)
    of, place = of[place >= 0], place[place >= 0]
    sums = np.stack([np.bincount(of, weights=weights[place, k], minlength=len(texts)) for k in range(len(languages))], axis=1)
    met = np.bincount(of, minlength=len(texts)) > 0
    confidence = np.where(met, 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
    return pd.DataFrame({"lang": np.where(met, np.array(languages, dtype=object)[sums.argmax(axis=1)], None), "confidence": confidence}, index=texts.index)


class TrainedDetector:
    """A detector for ``language.detected``: rows in, rows with detected_lang and detected_confidence out."""

    def __init__(self, texts: DataFrame, text: str = "text", lang: str = "lang") -> None:
        self.model = trained(texts, text, lang)

    def detect_rows(self, rows: DataFrame, text: str) -> DataFrame:
        return detect(rows, self.model, text)
