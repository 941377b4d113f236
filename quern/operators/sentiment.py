"""Sentence sentiment and confusion, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.models import ConfusionModel, LexiconConfusion, LexiconSentiment, SentimentModel


def analyse(sentences: DataFrame, text: str = "text", rating: SentimentModel | None = None, confusion: ConfusionModel | None = None) -> DataFrame:
    """``sentences`` with sentiment, score, confidence and confusion(status, confidence); the models see 512 characters."""
    seen = F.substring(text, 1, S.CLASSIFY_CHARS)
    rated = sentences.withColumn("_r", (rating or LexiconSentiment()).rate(seen)).withColumn("_c", (confusion or LexiconConfusion()).judge(seen))
    confused = (F.col("_c.label") == "confused") & (F.col("_c.score") > S.CONFUSED_ABOVE)
    return rated.withColumns({
        "sentiment": X.score_label(F.col("_r.stars")), "score": F.greatest(F.least(F.col("_r.stars").cast("double"), F.lit(5.0)), F.lit(0.0)), "confidence": F.col("_r.confidence"),
        "confusion": F.when(F.col("_c").isNotNull(), F.struct(F.when(confused, "CONFUSED").otherwise("NOT_CONFUSED").alias("status"), F.col("_c.score").alias("confidence"))),
    }).drop("_r", "_c")


def by_question(rows: DataFrame, *by: str) -> DataFrame:
    """Mean score and share of confused sentences per question; questions without sentences have no row."""
    return rows.groupBy(*by).agg(F.avg("score").alias("score"), (100.0 * F.count_if(F.col("confusion.status") == "CONFUSED") / F.count(F.lit(1))).alias("confusion_percentage"))


def flat(nested: DataFrame) -> DataFrame:
    """Both shapes of a result document, {interview: {question: {sentences}}} and {id: {sentences}}, as rows."""
    if "question_id" not in nested.columns:
        nested = nested.withColumn("question_id", F.lit(None).cast("string"))
    rows = nested.select("interview_id", "question_id", F.posexplode("sentences").alias("sentence_index", "s"))
    return rows.select("interview_id", "question_id", "sentence_index", "s.*")
