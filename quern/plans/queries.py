"""The registered queries: ``documents`` stand for responses (source = interview), ``conversations`` for ordered sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import quality as Q
from quern.functions import text as X
from quern.operators import audit, density, descent, evaluation, insights, layout, ngrams, process, report, segments, topics
from quern.operators import memory as M
from quern.operators.scratch import Tables, settled
from quern.operators.vectors import nearest
from quern.sources import transcripts
from quern.streaming import incremental


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(s, d):
    return table(s, d, "documents")


def q01_responses(s, d):
    return _docs(s, d).groupBy(F.col("source").alias("interview_id")).agg(F.count(F.lit(1)).alias("responses"), F.count_if(X.is_blank(F.col("text"))).alias("empty"), F.count_distinct("text").alias("distinct_texts"))


def q02_long_enough(s, d):
    return _docs(s, d).groupBy("lang", X.long_enough(F.col("text")).alias("long_enough")).agg(F.count(F.lit(1)).alias("n"))


def _turns(s, d):
    c = table(s, d, "conversations")
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(answers, ["conv_id", "turn"]).withColumn("q", Q.lengths(F.col("text"), F.col("answer")))


def q03_length_ratios(s, d):
    t = _turns(s, d)
    return t.select("conv_id", "turn", "q.source_tokens", "q.target_tokens", F.round("q.char_ratio", 6).alias("char_ratio"), F.round("q.token_ratio", 6).alias("token_ratio"), "q.length_ratio_outlier")


def q04_distribution(s, d):
    told = Q.distribution(_docs(s, d), "n_chars", "source", bound=200.0)
    return told.select("source", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "p05", "p25", "min")), "n_below")


def q05_duplicate_texts(s, d):
    return audit.duplicates(_docs(s, d).select(X.digest(F.col("text")).alias("sha256")), "sha256")


def q06_key_difference(s, d):
    return report.key_difference(_docs(s, d).select("doc_id"), table(s, d, "labels").select("doc_id"), ["doc_id"]).select("side", "n")


def q07_memory_coverage(s, d):
    docs = _docs(s, d).withColumn("source_language", F.col("lang"))
    asked = M.keyed(docs, "text", F.col("lang"), "model", "1")
    seen = asked.join(table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    memory = seen.select(*M.KEYS, F.col("text").alias("translated_text")).distinct()
    return M.coverage(asked, memory, "doc_id").select("total", "hits", "misses", F.round("coverage", 9).alias("coverage"))


def q08_language_vote(s, d):
    long = _docs(s, d).where(X.long_enough(F.col("text")))
    votes = long.groupBy(F.col("source").alias("interview_id"), "lang").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("interview_id").agg(F.min_by("lang", F.struct(-F.col("votes"), "lang")).alias("primary_language"), F.sum("votes").alias("considered"))


def q09_repetition(s, d):
    found = _docs(s, d).select("doc_id", Q.worst_run(F.col("text")).alias("w")).where("w is not null")
    return found.select("doc_id", F.col("w.ngram").alias("ngram"), F.col("w.count").alias("n"))


def q10_sentences(s, d):
    rows = _docs(s, d).select(X.response_id(F.col("source"), F.col("doc_id").cast("string")).alias("response_id"), "text")
    cut = segments.explode_sentences(rows, segments.split_sentences(F.col("text"))).drop("text")
    return cut.select(X.sentence_id(F.col("response_id"), F.col("sentence_index")).alias("sentence_id"), "sentence_index", X.digest(F.col("text_source")).alias("sha256"), X.word_count(F.col("text_source")).alias("words"))


_FRAGMENTS = [
    ("a::1", 0, "Van acabar ficant sensors..."), ("a::1", 1, "-...de camions..."), ("a::1", 2, "- enviat."), ("a::1", 3, "Nova frase…"), ("a::1", 4, "Majúscula."),
    ("b::1", 0, "I llavors…"), ("b::1", 1, "2 coses."), ("b::1", 2, "fi..."), ("b::1", 3, "«sí»"), ("c::1", 0, "sol"),
]


def q11_continuations(s, d):
    rows = s.createDataFrame(_FRAGMENTS, "response_id string, sentence_index int, text_source string")
    return segments.merge_continuations(rows).select("response_id", "sentence_index", "text_source", F.size("fragments").alias("fragments"))


def q12_ordered_text(s, d):
    c = table(s, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), " ").alias("t"))
    return whole.select("conv_id", X.digest(F.col("t")).alias("sha256"), F.length("t").alias("chars"))


def q13_recurring_phrases(s, d):
    cut = _docs(s, d).select(F.col("lang").alias("question_id"), F.col("source").alias("interview_id"), F.explode(segments.split_sentences(F.col("text"))).alias("t"))
    return audit.recurring_phrases(cut, X.normal_sentence(F.col("t")))


def _topic_words(s, d):
    """Each language's ten most frequent longer words: a topic result without a model."""
    words = _docs(s, d).select("lang", F.explode(X.word_set(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    counted = words.groupBy(F.col("lang").alias("topic"), "word").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = insights.top_terms(counted, 10)
    told = best.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    return settled(told, "topic-words")[0]  # a row per language, which its users read more than once


def _scored(s, d):
    c = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    n = F.length("text")
    return c.withColumns({"score": (1 + n % 9 / 2.0), "confused": F.when(n % 7 > 0, n % 7 < 3)})


def _matched(s, d, least=1, topic_words=None):
    return insights.matches(topic_words or _topic_words(s, d), _scored(s, d), "key", X.word_set(F.col("text")), least)


def q14_topic_scores(s, d):
    told = insights.score_distribution(_matched(s, d), _scored(s, d), "key")
    return told.select("topic", "score", "n", F.round("percent", 6).alias("percent"))


def q15_topic_averages(s, d):
    t = _topic_words(s, d)
    told = insights.topic_averages(t, _matched(s, d, 2, t), _scored(s, d), "key")
    return told.select("topic", "average_score", "sentiment", "sample_size", F.array_join("matched", " ").alias("matched"))


def q16_clarity_crosstab(s, d):
    told = insights.clarity_crosstab(_scored(s, d))
    return told.select("rating", F.round("clear", 9).alias("clear"), F.round("confused", 9).alias("confused"))


def q17_topic_summary(s, d):
    told = insights.topic_summary(_matched(s, d), _scored(s, d), "key")
    return told.select("topic", *(F.round(c, 6).alias(c) for c in ("mean_score", "percent_positive", "percent_confused")), "n")


def q18_topic_similarity(s, d):
    t = _topic_words(s, d)
    return evaluation.similarity(t, t).select("left", "right", F.round("jaccard", 9).alias("jaccard"))


def q19_evenly_spaced(s, d):
    return process.evenly_spaced(_docs(s, d).select("source", "doc_id"), "doc_id", 7, "source")


def q20_last_wins(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return transcripts.last_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def q21_failure_streaks(s, d):
    e = table(s, d, "events")
    return report.failure_streaks(e, ["user_id"], "event_id", F.col("event_type") == "error", S.MOST_FAILED_BATCHES)


def q22_status_rollup(s, d):
    rows = _docs(s, d).join(table(s, d, "labels"), "doc_id", "left")
    status = process.response_status(F.col("lang") != "es", F.coalesce("n_chars", F.lit(0)), F.when(F.col("toxic") == 1, F.col("n_chars")).otherwise(F.coalesce("quality", F.lit(0))), F.when(F.col("quality").isNull(), F.col("n_chars")).otherwise(0))
    return rows.groupBy("source", status.alias("text_es_status")).agg(F.count(F.lit(1)).alias("n"))


def q23_tfidf_terms(s, d):
    """A term's weights add up to its count times its idf, so counts by source are all that moves, not a row for each term of each document."""
    docs = _docs(s, d).select("source", "doc_id", "text")
    n = docs.count()
    # rows that share a key are one document: their terms are told apart by key, those of all others by row
    shared = settled(docs.groupBy("source", "doc_id").count().where("count > 1").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.lit(True).alias("_many")), "shared")[0]
    rows = docs.join(shared, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("source", "doc_id", X.topic_tokens(F.col("text")).alias("tokens"), F.coalesce("_many", F.lit(False)).alias("many"))
    entry = lambda ts, new: F.transform(ts, lambda t: F.struct(t.alias("term"), F.lit(new).alias("new")))
    every = X.let(F.struct("tokens", "many"), lambda x: F.concat(entry(x["tokens"], 0), F.when(x["many"], entry(F.array().cast("array<string>"), 1)).otherwise(entry(F.array_distinct(x["tokens"]), 1))))
    own = rows.select("source", F.inline(every))
    again = rows.where("many").select("source", "doc_id", F.explode("tokens").alias("term")).distinct().select("source", "term", F.lit(1).alias("new"))
    counted = own.unionByName(again).groupBy("source", "term").agg(F.count_if(F.col("new") == 0).alias("tf"), F.sum("new").alias("df"))
    counted = settled(counted, "counted")[0]  # read twice
    df = counted.groupBy("term").agg(F.sum("df").alias("df")).where((F.col("df") >= S.MIN_DF) & (F.col("df") <= S.MAX_DF * n))
    score = F.round(F.col("tf") * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0), 4)
    total = counted.drop("df").join(df, "term").select(F.col("source").alias("topic"), F.col("term").alias("word"), score.alias("score"))
    return insights.top_terms(total, 10)


def q24_nearest(s, d):
    """A search: the rows whose id is divisible by 100 against all rows."""
    rows = table(s, d, "embeddings")
    told = nearest(rows, "vec_id", "embedding", 5, queries=rows.where(F.col("vec_id") % 100 == 0))
    return told.select("vec_id", "rank", F.round("cosine", 4).alias("cosine"))


def q25_coherence(s, d):
    told = evaluation.coherence(_topic_words(s, d), _docs(s, d), F.transform(X.words(F.col("text")), X.bare_word))
    return told.select("topic", F.round("c_npmi", 6).alias("c_npmi"))


def q26_word_counts(s, d):
    """Words of the pages' text, without those of the benchmark's."""
    words = lambda df, c: df.select(F.explode(X.topic_tokens(c)).alias("word"))
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    kept = words(table(s, d, "pages"), plain).join(words(table(s, d, "benchmark"), F.col("text")).distinct(), "word", "left_anti")
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q27_sessions(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    told = incremental.sessions(e)
    return told.select("user_id", F.unix_micros("session.start").alias("begin_us"), (F.unix_micros("session.end") - 30 * 60 * 1_000_000).alias("end_us"), "n")


def _modelled(s, d, algorithm, k):
    docs = _docs(s, d).select(F.col("doc_id").alias("doc"), "text")
    return topics.extract_topics(docs, algorithm, k).topics


def q28_lda(s, d):
    return _modelled(s, d, "lda", 4)


def q29_svd(s, d):
    return _modelled(s, d, "svd", 4)


def q30_nmf(s, d):
    return _modelled(s, d, "nmf", 4)


def q31_clusters(s, d):
    return _modelled(s, d, "cluster", 8)


def q101_trained_languages(s, d):
    """Every document's language by profiles of two thirds of the labelled documents."""
    docs = _docs(s, d)
    told = ngrams.detect(docs, ngrams.trained(docs.where(F.col("doc_id") % 3 != 1)))
    return told.select("doc_id", "detected_lang", F.round("detected_confidence", 4).alias("confidence"))


def q98_neighbours(s, d):
    """Every vector's five nearest, without comparing all with all."""
    with Tables(s, "q98") as tables:
        found = descent.neighbours(table(s, d, "embeddings"), "vec_id", "embedding", 5, tables)
        return settled(found.select(F.col("node").alias("vec_id"), "neighbour", "rank", F.round(1 - F.col("distance"), 6).alias("cosine")), "neighbours")[0]


def q103_layout(s, d):
    """Two coordinates for every vector, laid out by its neighbour graph."""
    with Tables(s, "q103") as tables:
        near = tables.table(descent.neighbours(table(s, d, "embeddings"), "vec_id", "embedding", 15, tables), "near")
        told = layout.placed(near, 2, tables)
        return settled(told.select(F.col("node").alias("vec_id"), F.round(F.get("p", F.lit(0)), 6).alias("x"), F.round(F.get("p", F.lit(1)), 6).alias("y")), "layout")[0]


def q99_density(s, d):
    """Density clusters of all vectors, and how many of each table label they hold."""
    rows = table(s, d, "embeddings")
    with Tables(s, "q99") as tables:
        near = tables.table(descent.neighbours(rows, "vec_id", "embedding", 10, tables, "euclid"), "near")
        found = density.clusters(density.reachability(near, 5), 10, tables)
        told = rows.join(found.withColumnRenamed("label", "cluster"), rows["vec_id"] == found["node"], "left").groupBy(F.coalesce("cluster", F.lit(-1)).alias("cluster"), "label")
        return settled(told.agg(F.count(F.lit(1)).alias("n")), "density")[0]


def q32_assertions(s, d):
    docs, labels, c = _docs(s, d), table(s, d, "labels"), table(s, d, "conversations")
    keys = docs.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("x"))
    orphaned = labels.join(docs, "doc_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("x"))
    sizes = audit.holds(docs, F.length("text") == F.col("n_chars"))
    turns = c.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.bool_and(F.col("m") - F.col("n") <= 0).alias("x"))
    return audit.assertions({"unique_doc_ids": keys, "labels_have_documents": orphaned, "n_chars_is_length": sizes, "turns_are_dense": turns})


_TRANSCRIPT = "-.Pregunta 1.1.-\n[00:00:01.000 --> 00:00:05.000]   Sí, tenim  una granja...\n[00:00:05.000 --> 00:00:09.000]   -...de prova. -.Pregunta 1.2a.-\nNo.\n-.Pregunta 1.1.- Una   altra"


def q33_transcripts(s, d):
    rows = s.createDataFrame([("t1", _TRANSCRIPT), ("t2", "res")], "interview_id string, content string")
    return transcripts.parse_list(rows)


def q34_chunks(s, d):
    packed = _docs(s, d).select("doc_id", segments.pack_words(F.col("text")).alias("p"))
    return packed.select("doc_id", F.size("p").alias("pieces"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


def q35_confusion_partition(s, d):
    rows = _scored(s, d).withColumn("confusion", F.when(F.col("confused").isNotNull(), F.struct(F.when(F.col("confused"), "CONFUSED").otherwise("NOT_CONFUSED").alias("status"))))
    return audit.confusion_partition(rows)


def q36_degenerate(s, d):
    t = table(s, d, "conversations")
    told = t.select("conv_id", "turn", Q.degenerate(F.lit("source"), F.col("text")).alias("g"))
    return told.groupBy("g.is_empty", "g.is_identical_to_source", "g.repetition_flag", "g.flagged").agg(F.count(F.lit(1)).alias("n"))


def q37_question_order(s, d):
    rows = s.createDataFrame([(q,) for q in ("2.10", "2.9", "1.3a", "1", "10.1", "1.3b")], "question_id string")
    return rows.select("question_id", F.row_number().over(W.orderBy(X.question_parts(F.col("question_id")), "question_id")).alias("place"))


def q38_score_histogram(s, d):
    told = insights.score_histogram(_scored(s, d))
    return told.select("bin", "n", F.round("percent", 6).alias("percent"))


def q39_clean_text(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", X.digest(X.clean(F.col("text"))).alias("clean"), X.digest(X.topic_text(F.col("text"))).alias("topic"), X.digest(X.drop_punctuation(F.col("text"))).alias("bare"))


def q40_diversity(s, d):
    return evaluation.diversity(_topic_words(s, d)).select(F.round("diversity", 9).alias("diversity"))


def q41_document_continuations(s, d):
    """As q11, on the sentences of all documents."""
    rows = _docs(s, d).select(X.response_id(F.col("source"), F.col("doc_id").cast("string")).alias("response_id"), "text")
    cut = segments.explode_sentences(rows, segments.split_sentences(F.col("text"))).drop("text")
    merged = segments.merge_continuations(cut)
    return merged.select("response_id", "sentence_index", X.digest(F.col("text_source")).alias("sha256"), F.size("fragments").alias("fragments"))


def q102_planted_continuations(s, d):
    """As q41, with sentences that trail off and go on: the points of every second document become ellipses of two kinds, its letters small."""
    low = F.lower("text")
    planted = F.when(F.col("doc_id") % 4 == 0, F.replace(low, F.lit(". "), F.lit("... "))).when(F.col("doc_id") % 4 == 2, F.replace(low, F.lit(". "), F.lit("… - ..."))).otherwise(F.col("text"))
    rows = _docs(s, d).select(X.response_id(F.col("source"), F.col("doc_id").cast("string")).alias("response_id"), planted.alias("text"))
    merged = segments.merge_continuations(segments.explode_sentences(rows, segments.split_sentences(F.col("text"))).drop("text"))
    return merged.select("response_id", "sentence_index", X.digest(F.col("text_source")).alias("sha256"), F.size("fragments").alias("fragments"))


def q42_document_transcripts(s, d):
    """As q33, on all documents made into transcripts: each sentence is the answer to a question of its own."""
    marked = F.transform(segments.split_sentences(F.col("text")), lambda t, i: F.concat(F.lit("-.Pregunta "), (i + 1).cast("string"), F.lit(".-\n[00:00:01.000 --> 00:00:05.000]   "), t))
    rows = _docs(s, d).select(F.col("doc_id").cast("string").alias("interview_id"), F.array_join(marked, "\n").alias("content"))
    return transcripts.parse_list(rows).select("interview_id", "position", "question_id", X.digest(F.col("original_text")).alias("sha256"))


def q43_document_question_order(s, d):
    """As q37, on the distinct ids that all documents give: at most 10,000."""
    ids = _docs(s, d).select(F.concat_ws(".", (F.col("doc_id") % 100).cast("string"), F.concat((F.col("n_chars") % 25).cast("string"), F.when(F.col("lang") == "en", "").otherwise(F.substring("lang", 1, 1)))).alias("question_id"))
    return ids.distinct().select("question_id", F.row_number().over(W.orderBy(X.question_parts(F.col("question_id")), "question_id")).alias("place"))


def flagship(s: SparkSession, sf_dir: str) -> DataFrame:
    """Interviews, their responses and sentences, and how far each one's most widespread short phrase reaches."""
    # a row without a phrase brings a document's sentences, so that one chain of sums tells both and texts are cut once
    entry = lambda phrase, n: F.struct(phrase.cast("string").alias("phrase"), n.alias("cut"))
    short = lambda p: (p != "") & (X.word_count(p) <= S.SHORT_TOKENS)
    phrases = lambda ss: F.array_distinct(F.filter(F.transform(ss, X.normal_sentence), short))
    entries = X.let(segments.split_sentences(F.col("text")), lambda ss: F.concat(F.array(entry(F.lit(None), F.size(ss))), F.transform(phrases(ss), lambda p: entry(p, F.lit(0)))))
    rows = _docs(s, sf_dir).select(F.col("source").alias("interview_id"), F.col("doc_id").alias("question_id"), F.explode_outer(entries).alias("e"))
    rows = rows.select("interview_id", "question_id", "e.*").where("phrase is not null or cut > 0")
    by_question = rows.groupBy("interview_id", "phrase", "question_id").agg(F.sum("cut").alias("cut"))
    spread = by_question.groupBy("interview_id", "phrase").agg(F.count("question_id").alias("known"), F.count(F.lit(1)).alias("n"), F.sum("cut").alias("cut"))
    whole, told = F.col("phrase").isNull(), F.col("phrase").isNotNull()
    return spread.groupBy("interview_id").agg(
        F.max(F.when(whole, F.col("known"))).alias("responses"), F.sum("cut").alias("sentences"),
        F.min_by("phrase", F.when(told, F.struct(-F.col("n"), "phrase"))).alias("phrase"), F.max(F.when(told, F.col("n"))).alias("n_with_phrase"),
    )


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()} | {"q00_flagship": flagship}
