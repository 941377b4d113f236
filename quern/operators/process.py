"""Corpus processing: responses and sentences with languages, translations, diagnostics and statuses, in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import quality as Q
from quern.functions import text as X
from quern.models import Embedder, HashedEmbedder, LanguageDetector, Lemmatizer, ProfileDetector, SameLemmas, Translator
from quern.operators import language, segments, translate
from quern.operators.scratch import settled


@dataclass
class Processed:
    responses: DataFrame
    sentences: DataFrame
    translated: DataFrame  # what the memory may take in
    expected: DataFrame  # sentence_id of every sentence that went in
    fatal: DataFrame  # response_id, reason: responses that a frozen segmentation lacks


def routed(rows: DataFrame) -> DataFrame:
    """(interview_id, question_id, original_text) with response_id, status and exclusion_reason: blank texts are excluded, not lost."""
    blank = X.is_blank(F.col("original_text"))
    return rows.select("*", X.response_id(F.col("interview_id"), F.col("question_id")).alias("response_id"), F.when(blank, "EXCLUDED").otherwise("OK").alias("status"), F.when(blank, "empty_text").alias("exclusion_reason"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def with_frozen(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """The frozen language rules; language_conflict tells where detection said otherwise."""
    kept = frozen.groupBy("response_id").agg(F.first("source_language", ignorenulls=True).alias("_frozen"))
    return rows.join(kept, "response_id", "left").withColumns({"language_conflict": F.coalesce(F.col("_frozen") != F.col("source_language"), F.lit(False)), "source_language": F.coalesce("_frozen", "source_language")}).drop("_frozen")


def sentence_status(provenance: Column, flagged: Column) -> Column:
    return F.when(F.coalesce(flagged, F.lit(False)), "FLAGGED").otherwise(provenance)


def response_status(required: Column, total: Column, failed: Column, hits: Column) -> Column:
    return (
        F.when(~required, "IDENTITY_COPY").when((total == 0) | (failed == total), "WARNING_TRANSLATION_FAILED").when(failed > 0, "PARTIAL_TRANSLATION_FAILURE")
        .when(hits == total, "CACHE_HIT").otherwise("TRANSLATED")
    )


def counts(keys: Column, known: tuple[str, ...]) -> Column:
    """MAP of how often each of the known values occurs; absent ones are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.count_if(keys == k).alias("n")) for k in known))
    return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))


def assemble(sentences: DataFrame) -> DataFrame:
    """Sentences to one row per response: text in order, statuses, ids of the failed and the flagged."""
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", value.alias("v")))), lambda s: s["v"])
    good = F.when((F.col("sentence_status") != "FAILED") & (F.col("text_es") != ""), F.col("text_es"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("sentence_index", good.alias("v")))), lambda s: s["v"].isNotNull())
    return sentences.groupBy("response_id").agg(
        F.nullif(F.array_join(F.transform(kept, lambda s: s["v"]), " "), F.lit("")).alias("text_es"),
        ordered(F.col("sentence_id")).alias("sentence_ids"), F.count(F.lit(1)).cast("int").alias("sentence_count"),
        counts(F.col("sentence_status"), (*S.PROVENANCES, "FLAGGED")).alias("sentence_status_counts"),
        F.array_sort(F.collect_list(F.when(F.col("sentence_status") == "FAILED", F.col("sentence_id")))).alias("failed_sentence_ids"),
        F.array_sort(F.collect_list(F.when(F.col("sentence_status") == "FLAGGED", F.col("sentence_id")))).alias("flagged_sentence_ids"),
        F.count_if(F.col("translation_provenance") == "CACHE_HIT").alias("_hits"),
    )


def topic_texts(rows: DataFrame, lemmatizer: Lemmatizer | None = None, text: str = "text_es") -> DataFrame:
    """topic_text_es_raw and topic_text_es_clean: cleaned, lemmatised, without lone marks and numbers."""
    lemmas = (lemmatizer or SameLemmas()).lemmas(X.words(X.clean_keeping_marks(F.col(text))), F.lit(S.TARGET_LANGUAGE))
    clean = X.drop_lone_punctuation(F.array_join(lemmas, " "))
    return rows.withColumns({"topic_text_es_raw": F.col(text), "topic_text_es_clean": clean}).withColumn("topic_text_es_clean_empty", X.is_blank(F.col("topic_text_es_clean")))


def process(rows: DataFrame, memory: DataFrame, frozen: DataFrame | None = None, translator: Translator | None = None, detector: LanguageDetector | None = None, embedder: Embedder | None = None, lemmatizer: Lemmatizer | None = None, settle: Callable[[DataFrame, str], DataFrame] | None = None) -> Processed:
    """(interview_id, question_id, original_text) to responses and sentences.

    ``settle(table, name)`` may write a table and read it again. Each step that more than one table is made of goes through
    it, so that a step works once and the model sees a text once, however many tables are made. A response that the frozen segmentation lacks has no sentences and is a fatal error.
    """
    all_rows = routed(rows)
    found = language.detected(all_rows.where("status = 'OK'"), detector)
    told = language.response_languages(found, language.primary_languages(found))
    settle = settle or (lambda table, name: table)
    told = settle(told if frozen is None else with_frozen(told, frozen), "told")
    if frozen is not None:
        cut = frozen.where("sentence_id is not null").select("response_id", "sentence_id", "sentence_index", "text_source").join(told.select("response_id"), "response_id", "left_semi")
        fatal = told.join(frozen, "response_id", "left_anti").select("response_id", F.lit("missing_from_frozen_segmentation").alias("reason"))
    else:
        fatal = told.where(F.lit(False)).select("response_id", F.lit("").alias("reason"))
        cut = segments.numbered(told).select("response_id", "sentence_id", "sentence_index", "text_source")
    cut = settle(cut, "cut")
    asked = settle(cut.join(told.select("response_id", "interview_id", "question_id", "source_language"), "response_id"), "asked")
    translated = translate.repair_repetition(translate.sentences(asked, memory, translator, settle), memory, translator, settle)
    made = F.col("text_es").isNotNull() & (F.col("translation_provenance") != "SOURCE_ES")
    seen = (detector or ProfileDetector()).detect(F.col("text_es"))
    checks = F.struct(Q.language_check(F.col("text_es"), seen["lang"], seen["confidence"]).alias("target_language_check"), Q.degenerate(F.col("text_source"), F.col("text_es")).alias("degenerate_output"), Q.lengths(F.col("text_source"), F.col("text_es")).alias("length_diagnostics"))
    translated = settle(translated.withColumn("quality", F.when(made, checks)), "translated")
    entries = translated.select(F.explode(F.array_compact(F.array("made", "remade"))).alias("m")).select("m.*")
    sentences = translated.drop("made", "remade")
    sentences = sentences.withColumn("sentence_status", sentence_status(F.col("translation_provenance"), F.col("quality.degenerate_output.flagged")))
    sentences = sentences.withColumn("translation_required", F.col("source_language") != S.TARGET_LANGUAGE)

    joined = told.withColumn("translation_required", F.col("source_language") != S.TARGET_LANGUAGE).join(assemble(sentences), "response_id", "left")
    failed = F.size("failed_sentence_ids")
    joined = joined.withColumns({"text_es_status": response_status(F.col("translation_required"), F.coalesce("sentence_count", F.lit(0)), failed, F.col("_hits")), "response_translation_complete": failed == 0})
    embed = (embedder or HashedEmbedder()).embed
    similarity = F.when(F.col("translation_required") & F.col("text_es").isNotNull(), X.dot(embed(F.col("original_text")), embed(F.col("text_es"))))
    told_es = (detector or ProfileDetector()).detect(F.col("text_es"))
    response_quality = F.struct(Q.language_check(F.col("text_es"), told_es["lang"], told_es["confidence"]).alias("target_language_check"), Q.lengths(F.col("original_text"), F.col("text_es")).alias("length_diagnostics"), Q.degenerate(F.col("original_text"), F.col("text_es")).alias("degenerate_output"), similarity.alias("semantic_similarity"))
    done = topic_texts(joined, lemmatizer).withColumn("quality", F.when(F.col("translation_required"), response_quality)).drop("_hits", "long_enough", "detected_lang", "detected_confidence")
    excluded = all_rows.where("status = 'EXCLUDED'")
    return Processed(done.unionByName(excluded, allowMissingColumns=True), sentences, entries, cut.select("sentence_id"), fatal)


def usable(status: Column) -> Column:
    return status.isin(*S.USABLE_STATUSES)


def bridge(responses: DataFrame, sentences: DataFrame) -> DataFrame:
    """(interview_id, question_id, sentences): the sound responses' translated sentences in order, for the sentiment stage."""
    sound = responses.where("status = 'OK'").select("response_id", "interview_id", "question_id")
    texts = sentences.where("text_es is not null and text_es <> ''").groupBy("response_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "text_es"))), lambda s: s["text_es"]).alias("sentences"))
    return sound.join(texts, "response_id", "left").select("interview_id", "question_id", F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences"))


def _places(keys: DataFrame, key: str) -> DataFrame:
    """(key, _p, _n): each row's place in the order of ``key`` from 0, and the number of rows."""
    dealt = settled(keys.repartitionByRange(key).withColumn("_r", F.spark_partition_id()), "places")[0]
    counts = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))  # a row per range
    told = counts.select("_r", (F.sum("_c").over(W.orderBy("_r")) - F.col("_c")).alias("_b"), F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_n"))
    inside = dealt.withColumn("_i", F.row_number().over(W.partitionBy("_r").orderBy(key)) - 1)
    return inside.join(told, "_r").select(key, (F.col("_b") + F.col("_i")).alias("_p"), "_n")


def evenly_spaced(rows: DataFrame, key: str, k: int | None, *by: str) -> DataFrame:
    """``k`` rows spread evenly over the order of ``key``: the rows at floor(i * n / k). None or too large: all; 0: none.

    Without ``by`` the whole table is one sequence: its keys are dealt to ranges, numbered in each, and counted on from
    range to range, so no task sees them all.
    """
    if k is None or k < 0:
        return rows
    if k == 0:
        return rows.limit(0)
    if by:
        part = W.partitionBy(*by)
        place = rows.select(*by, key, (F.row_number().over(part.orderBy(key)) - 1).alias("_p"), F.count(F.lit(1)).over(part).alias("_n"))
    else:
        place = _places(rows.select(key), key)
    # p is floor(i * n / k) for some i exactly if the next i's place lies beyond it
    i = F.floor((F.col("_p") * k + F.col("_n") - 1) / F.col("_n"))
    chosen = place.where((F.col("_n") <= k) | ((F.floor(i * F.col("_n") / k) == F.col("_p")) & (i < k)))
    return rows.join(chosen.select(*by, key), [*by, key], "left_semi")


def round_trip(responses: DataFrame, memory: DataFrame, back: Translator, embedder: Embedder | None = None, k: int | None = S.ROUND_TRIP_SAMPLE) -> DataFrame:
    """The distribution of similarities between responses and their translations translated back, on an evenly spaced sample."""
    usable_ones = responses.where(usable(F.col("text_es_status")) & F.col("translation_required") & F.col("text_es").isNotNull())
    sample = evenly_spaced(usable_ones.select("response_id", "original_text", "text_es", F.lit(S.TARGET_LANGUAGE).alias("source_language")), "response_id", k)
    returned = translate.translate(sample, memory, back, text="text_es")
    embed = (embedder or HashedEmbedder()).embed
    scored = returned.withColumn("similarity", X.dot(embed(F.col("original_text")), embed(F.col("translated_text"))))
    return Q.distribution(scored, "similarity")
