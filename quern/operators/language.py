"""Languages of interviews and of their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.models import LanguageDetector, ProfileDetector


def detected(responses: DataFrame, detector: LanguageDetector | None = None, text: str = "original_text") -> DataFrame:
    """``responses`` with long_enough, and the detector's lang and confidence where it is. A detector may take whole tables (``detect_rows``)."""
    long = F.coalesce(X.long_enough(F.col(text)), F.lit(False))
    if hasattr(detector, "detect_rows"):
        told = detector.detect_rows(responses.withColumn("long_enough", long), text)
        return told.withColumns({c: F.when(F.col("long_enough"), F.col(c)) for c in ("detected_lang", "detected_confidence")})
    found = (detector or ProfileDetector()).detect(F.col(text))
    return responses.withColumn("long_enough", long).withColumn("_d", F.when(F.col("long_enough"), found)).withColumns({"detected_lang": F.col("_d.lang"), "detected_confidence": F.col("_d.confidence")}).drop("_d")


def primary_languages(found: DataFrame) -> DataFrame:
    """(interview_id, votes_ca, votes_es, interview_primary_language, fallback_used, tie_broken): the vote of the long responses."""
    votes = [F.count_if(F.col("long_enough") & (F.col("detected_lang") == lang)).alias(f"votes_{lang}") for lang in S.LANGUAGES]
    ca, es = (F.col(f"votes_{lang}") for lang in S.LANGUAGES)
    return found.groupBy("interview_id").agg(*votes).select("*", F.when(ca >= es, "ca").otherwise("es").alias("interview_primary_language"), (ca + es == 0).alias("fallback_used"), ((ca == es) & (ca > 0)).alias("tie_broken"))


def response_languages(found: DataFrame, primary: DataFrame) -> DataFrame:
    """``found`` with source_language and language_detection_method; all but clear cases take the interview's language."""
    joined = found.join(primary.select("interview_id", "interview_primary_language"), "interview_id", "left")
    direct = F.col("detected_lang").isin(*S.LANGUAGES)
    method = (
        F.when(~F.col("long_enough"), "interview_fallback_short").when(direct, "direct").when(F.col("detected_lang") == "en", "interview_fallback_unexpected_english")
        .when(F.col("detected_lang").isNotNull(), "interview_fallback_unsupported_language").otherwise("interview_fallback_detection_failed")
    )
    return joined.withColumn("language_detection_method", method).withColumn("source_language", F.when(F.col("language_detection_method") == "direct", F.col("detected_lang")).otherwise(F.col("interview_primary_language")))
