"""Translation of sentences and responses through the memory and a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import quality as Q
from quern.functions import text as X
from quern.models import CopyTranslator, Translator
from quern.operators import memory as M
from quern.operators import batched, segments


def translate(texts: DataFrame, memory: DataFrame, model: Translator | None = None, text: str = "text_source", version: str = S.GENERATION_VERSION, retry: bool = False) -> DataFrame:
    """``texts`` (with source_language) with translated_text, hit and fresh: the memory first, then the model, once per distinct text.

    A blank translation is a failure: translated_text is null and nothing is remembered. A model that takes batches is
    called at once (see ``batched``), under the settings of its ``for_retry()``, if it has any, on a retry.
    """
    model = model or CopyTranslator()
    asked = M.keyed(texts, text, F.col("source_language"), model.name, version)
    new = M.misses(asked, memory)
    if hasattr(model, "translate_batch"):
        own = model.for_retry() if retry and hasattr(model, "for_retry") else model
        new = batched.translate(new, own, text, key="source_hash").withColumnRenamed("translated_text", "_made")
    else:
        new = new.withColumn("_made", model.translate(F.col(text), F.col("source_language"), S.TARGET_LANGUAGE, retry))
    new = new.where(~X.is_blank(F.col("_made"))).select(*M.KEYS, F.col("_made"))
    found = M.look_up(asked, memory).join(new, M.KEYS, "left")
    kept = found.withColumn("fresh", ~F.col("hit") & F.col("_made").isNotNull()).withColumn("translated_text", F.coalesce("translated_text", "_made"))
    return kept.drop("_made")


def _entry(text: str) -> Column:
    """What the memory may take in of a translated row; null where it has that already, or where the model failed."""
    return F.when(F.col("fresh"), F.struct(*M.KEYS, F.col(text).alias("source_text"), "translated_text"))


def made(translated: DataFrame, text: str = "text_source") -> DataFrame:
    """The entries that a translation made: the memory's keys, source_text, translated_text."""
    return translated.select(_entry(text).alias("m")).where("m is not null").select("m.*")


def memory_rows(entries: DataFrame, model: Translator | None = None) -> DataFrame:
    """What a run adds to the memory: its entries, each key once."""
    model = model or CopyTranslator()
    return entries.dropDuplicates(M.KEYS).select(*M.KEYS, "source_text", "translated_text", F.lit(model.engine).alias("engine"), F.lit(model.engine_version).alias("engine_version"), F.current_timestamp().alias("created_at"))


def sentences(rows: DataFrame, memory: DataFrame, model: Translator | None = None, settle: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Sentences (sentence_id, source_language, text_source) with text_es, translation_provenance and made (the memory's new entry).

    Spanish is copied; failures get one more pass under the retry settings. ``settle`` may write what the first pass gave.
    """
    other = F.coalesce(F.col("source_language") != S.TARGET_LANGUAGE, F.lit(False))
    first = translate(rows.where(other), memory, model)
    if settle:
        first = settle(first, "first")
    own = F.col("source_language") == S.TARGET_LANGUAGE
    rest = rows.where(~other).withColumns({"text_es": F.when(own, F.col("text_source")), "translation_provenance": F.when(own, "SOURCE_ES").otherwise("FAILED")})
    done = first.where("translated_text is not null").withColumns({"text_es": F.col("translated_text"), "translation_provenance": F.when(F.col("hit"), "CACHE_HIT").otherwise("FRESH_OK"), "made": _entry("text_source")})
    again = translate(first.where("translated_text is null").select(*rows.columns), memory, model, version=S.RETRY_GENERATION_VERSION, retry=True)
    repaired = again.withColumns({"text_es": F.col("translated_text"), "translation_provenance": F.when(F.col("translated_text").isNotNull(), "RETRY_OK").otherwise("FAILED"), "made": _entry("text_source")})
    columns = ["sentence_id", *(c for c in rows.columns if c != "sentence_id"), "text_es", "translation_provenance", "made"]
    return done.select(*columns).unionByName(repaired.select(*columns)).unionByName(rest, allowMissingColumns=True)


def repair_repetition(told: DataFrame, memory: DataFrame, model: Translator | None = None, settle: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Translations that repeat themselves are made anew under the retry settings; the new one (entry remade) counts only if it is sound."""
    checked = told.withColumn("_loops", (F.col("translation_provenance") != "SOURCE_ES") & F.coalesce(Q.worst_run(F.col("text_es")).isNotNull(), F.lit(False)))
    if settle:
        checked = settle(checked, "checked")
    again = translate(checked.where("_loops"), memory, model, version=S.RETRY_GENERATION_VERSION, retry=True)
    again = again.withColumn("_better", F.when(~Q.degenerate(F.col("text_source"), F.col("translated_text"))["flagged"], F.col("translated_text")))
    better = F.col("_better").isNotNull()
    remade = again.withColumns({
        "remade": F.when(better, _entry("text_source")),
        "repetition_fallback_retry": F.struct(F.lit(True).alias("attempted"), better.alias("resolved")),
        "translation_provenance": F.when(better, "REPETITION_REPAIRED").otherwise(F.col("translation_provenance")),
        "text_es": F.coalesce("_better", "text_es"),
    }).select(*told.columns, "remade", "repetition_fallback_retry")
    return remade.unionByName(checked.where("not _loops").drop("_loops"), allowMissingColumns=True)


def responses(rows: DataFrame, memory: DataFrame, model: Translator | None = None, text: str = "original_text") -> DataFrame:
    """Whole responses in chunks of sentences: (response_id, text_es, hard_split_count, failed); one failed chunk fails its response."""
    packed = rows.withColumn("_c", segments.chunks(segments.split_sentences(F.col(text))))
    pieces = packed.select("response_id", "source_language", F.col("_c.hard_splits").alias("hard_split_count"), F.posexplode("_c.chunks").alias("place", "text_source"))
    made = translate(pieces, memory, model)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "translated_text"))), lambda s: s["translated_text"]), " ")
    out = made.groupBy("response_id").agg(F.bool_or(F.col("translated_text").isNull()).alias("failed"), joined.alias("text_es"), F.max("hard_split_count").alias("hard_split_count"))
    return out.withColumn("text_es", F.when(~F.col("failed"), F.col("text_es")))
