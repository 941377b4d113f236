"""Topics against sentences, and the tables behind the charts. A null confusion counts as clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as X


def matches(topics: DataFrame, sentences: DataFrame, sentence_key: str, words: Column, least: int = 1) -> DataFrame:
    """(topic, sentence_key) wherever they share ``least`` words: an equi-join on words, never topic by sentence."""
    wanted = topics.select("topic", F.explode(F.array_distinct(F.transform("words", X.bare_word))).alias("word"))
    held = sentences.select(sentence_key, F.explode(words).alias("word"))
    return held.join(wanted, "word").groupBy("topic", sentence_key).agg(F.count_distinct("word").alias("shared")).where(F.col("shared") >= least).select("topic", sentence_key)


def score_distribution(matched: DataFrame, scores: DataFrame, sentence_key: str) -> DataFrame:
    """(topic, score, n, percent): sentences of each rounded score, and their share of the topic's."""
    counted = matched.join(scores, sentence_key).groupBy("topic", F.bround(F.coalesce("score", F.lit(3.0))).cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("topic")))


def topic_averages(topics: DataFrame, matched: DataFrame, scores: DataFrame, sentence_key: str, most: int = 5) -> DataFrame:
    """(topic, average_score, sentiment, sample_size, first matches); a topic without matches is neutral at 3."""
    joined = matched.join(scores, sentence_key)
    own = joined.groupBy("topic").agg(F.avg("score").alias("a"), F.count(F.lit(1)).alias("n"))
    first = joined.withColumn("_r", F.row_number().over(W.partitionBy("topic").orderBy(sentence_key))).where(F.col("_r") <= most)
    listed = first.groupBy("topic").agg(F.array_sort(F.collect_list(F.col(sentence_key))).alias("matched"))
    average = F.coalesce("a", F.lit(3.0))
    return topics.select("topic").join(own, "topic", "left").join(listed, "topic", "left").select("topic", F.bround(average, 2).alias("average_score"), X.average_label(average).alias("sentiment"), F.coalesce("n", F.lit(0)).alias("sample_size"), F.coalesce("matched", F.array().cast(listed.schema["matched"].dataType)).alias("matched"))


def topic_summary(matched: DataFrame, scores: DataFrame, sentence_key: str) -> DataFrame:
    """(topic, mean_score, percent_positive, percent_confused, n) of topics with matches."""
    n = F.count(F.lit(1))
    return matched.join(scores, sentence_key).groupBy("topic").agg(F.avg("score").alias("mean_score"), (100.0 * F.count_if(F.col("score") >= 4) / n).alias("percent_positive"), (100.0 * F.count_if(F.col("confused")) / n).alias("percent_confused"), n.alias("n"))


def clarity_crosstab(rows: DataFrame, score: str = "score", confused: str = "confused") -> DataFrame:
    """(rating 1..5, clear, confused): shares of each rating's rows, every cell present."""
    spine = rows.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    unsure = F.coalesce(F.col(confused), F.lit(False))
    counted = rows.groupBy(F.bround(score).cast("int").alias("rating")).agg(F.count_if(~unsure).alias("a"), F.count_if(unsure).alias("b"))
    both = spine.join(counted, "rating", "left")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("a") + F.col("b")), F.lit(0.0))
    return both.select("rating", share("a").alias("clear"), share("b").alias("confused"))


def clarity_totals(rows: DataFrame, confused: str = "confused") -> DataFrame:
    unsure = F.coalesce(F.col(confused), F.lit(False))
    return rows.agg(F.count_if(unsure).alias("confused"), F.count_if(~unsure).alias("clear"))


def score_histogram(rows: DataFrame, score: str = "score") -> DataFrame:
    """(bin 1..5, n, percent)."""
    spine = rows.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("bin"))
    counted = rows.groupBy(F.greatest(F.least(F.floor(score).cast("int"), F.lit(5)), F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(score).alias("_all"))
    return spine.join(counted, "bin", "left").crossJoin(total).select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(100.0 * F.try_divide("n", "_all"), F.lit(0.0)).alias("percent"))  # five rows by one


def word_weights(terms: DataFrame) -> DataFrame:
    """(topic, word, weight): each word's first token, lower-cased, with its best score."""
    token = F.lower(F.split_part("word", F.lit(" "), F.lit(1)))
    return terms.groupBy("topic", token.alias("word")).agg(F.max("score").alias("weight"))


def top_terms(terms: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, word, score): the best ``n`` words of each topic."""
    ranked = terms.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "word")))
    return ranked.where(F.col("rank") <= n).select("topic", "rank", "word", "score")
