"""Model interfaces, and deterministic defaults made of built-in expressions.

A real model plugs in as an object with the same method, usually around an
iterator pandas UDF that loads its weights once per task.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X


class LanguageDetector(Protocol):
    def detect(self, text: Column) -> Column:
        """(lang, confidence); lang null where detection fails."""


class Translator(Protocol):
    name: str
    engine: str
    engine_version: str

    def translate(self, text: Column, source: Column, target: str, retry: bool = False) -> Column:
        """The translation; null or blank where it fails."""

    def count_tokens(self, text: Column) -> Column: ...


class SentimentModel(Protocol):
    def rate(self, text: Column) -> Column:
        """(stars 1 to 5, confidence)."""


class ConfusionModel(Protocol):
    def judge(self, text: Column) -> Column:
        """(label ``confused`` or ``not confused``, the top one; score)."""


class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """array<double>."""


class Lemmatizer(Protocol):
    def lemmas(self, words: Column, lang: Column) -> Column: ...


#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "ca": ("els", "les", "amb", "és", "que", "una", "per", "però", "són", "hi", "dels", "aquest", "això", "molt", "també", "perquè"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auch", "für", "sich", "auf", "dem", "den", "von"),
    "en": ("the", "and", "of", "to", "is", "that", "in", "it", "was", "for", "with", "as", "this", "are", "not", "by"),
    "es": ("los", "las", "con", "es", "que", "una", "por", "pero", "son", "del", "este", "esto", "muy", "también", "porque", "el"),
    "fr": ("le", "les", "des", "et", "est", "que", "une", "pour", "dans", "pas", "avec", "sur", "qui", "du", "la", "un"),
}


class ProfileDetector:
    """The language whose function words take the largest share of the first characters' words; ties by name."""

    def detect(self, text: Column) -> Column:
        w = F.transform(X.words(F.lower(X.prefix(text))), X.bare_word)
        share = lambda own: F.size(F.filter(w, lambda x: x.isin(*own))) / F.greatest(F.size(w), F.lit(1))
        scores = [F.struct(share(own).alias("s"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, own) in enumerate(FUNCTION_WORDS.items())]
        best = F.greatest(*scores)
        return F.struct(F.when(best["s"] > 0, best["lang"]).alias("lang"), best["s"].alias("confidence"))


class CopyTranslator:
    """Copies the text: stands in where no translation model is installed."""

    name, engine, engine_version = "copy", "builtin", "1"

    def translate(self, text: Column, source: Column, target: str, retry: bool = False) -> Column:
        return X.strip(text)

    def count_tokens(self, text: Column) -> Column:
        return X.word_count(text)


#: Small sentiment and confusion lexicons (Spanish, Catalan, English).
GOOD_WORDS = ("bueno", "buena", "bien", "mejor", "excelente", "feliz", "fácil", "bo", "bona", "bé", "millor", "good", "great", "better", "happy", "easy")
BAD_WORDS = ("malo", "mala", "mal", "peor", "terrible", "triste", "difícil", "dolent", "dolenta", "pitjor", "bad", "worse", "awful", "sad", "hard")
UNSURE_WORDS = ("confuso", "confundido", "duda", "entiendo", "sé", "confós", "dubte", "confused", "unclear", "unsure", "know")


def _share(text: Column, own: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.transform(X.words(X.prefix(text, S.CLASSIFY_CHARS)), X.bare_word), lambda x: x.isin(*own)))


class LexiconSentiment:
    def rate(self, text: Column) -> Column:
        good, bad = _share(text, GOOD_WORDS), _share(text, BAD_WORDS)
        stars = F.greatest(F.lit(1), F.least(F.lit(5), F.lit(3) + good - bad))
        return F.struct(stars.cast("int").alias("stars"), (F.abs(good - bad) / F.greatest(good + bad, F.lit(1))).cast("double").alias("confidence"))


class LexiconConfusion:
    def judge(self, text: Column) -> Column:
        unsure = _share(text, UNSURE_WORDS)
        score = F.when(unsure > 0, F.least(F.lit(0.55) + unsure * 0.1, F.lit(1.0))).otherwise(0.9)
        return F.struct(F.when(unsure > 0, "confused").otherwise("not confused").alias("label"), score.alias("score"))


class HashedEmbedder:
    """Unit vectors of hashed word counts."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, text: Column) -> Column:
        slots = F.transform(F.transform(X.words(text), X.bare_word), lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)))
        counted = lambda s: F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double"))
        unit = lambda c: X.let(F.sqrt(X.dot(c, c)), lambda norm: F.transform(c, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0))))
        return X.let(slots, lambda s: X.let(counted(s), unit))


class SameLemmas:
    def lemmas(self, words: Column, lang: Column) -> Column:
        return F.transform(words, F.lower)
