"""Reconciliation of the stages: counts, keys, partitions of totals, and the assertions over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X

KEYS = ["interview_id", "question_id"]


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary(rows: DataFrame, stage: str, text: str | None = None) -> DataFrame:
    """(stage, interviews, responses, keys, empty)."""
    empty = F.count_if(X.is_blank(F.col(text))) if text else F.lit(0).cast("bigint")
    return rows.agg(F.lit(stage).alias("stage"), F.count_distinct("interview_id").alias("interviews"), F.count(F.lit(1)).alias("responses"), F.count_distinct(F.struct(*KEYS)).alias("keys"), empty.alias("empty"))


def stage_table(stages: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (summary(df, name, text) for name, (df, text) in stages.items()))


def confusion_partition(rows: DataFrame) -> DataFrame:
    """Sentences by confusion, and whether the three parts make the whole."""
    status, n = F.col("confusion.status"), F.count(F.lit(1))
    a, b, c = F.count_if(status == "CONFUSED"), F.count_if(status == "NOT_CONFUSED"), F.count_if(F.col("confusion").isNull())
    return rows.agg(n.alias("n_sentences"), a.alias("confused"), b.alias("not_confused"), c.alias("no_confusion_field"), (a + b + c == n).alias("partition_holds"), F.bround(F.try_divide(100.0 * a, n), 1).alias("confused_pct"))


def topic_sizes(topics: DataFrame, sizes: DataFrame, documents: DataFrame) -> DataFrame:
    """Assigned documents against the size distribution (size, n): what is left over are outliers."""
    one = topics.agg(F.count(F.lit(1)).alias("n_topics"), F.coalesce(F.sum("count"), F.lit(0)).alias("assigned")).crossJoin(sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("from_sizes"))).crossJoin(documents.agg(F.count(F.lit(1)).alias("documents")))  # one-row tables
    return one.select("*", (F.col("from_sizes") - F.col("assigned")).alias("outliers_implied"), (F.col("from_sizes") == F.col("documents")).alias("adds_up"))


def recurring_phrases(sentences: DataFrame, phrase: Column, by: str = "question_id", over: str = "interview_id", most: int = 30) -> DataFrame:
    """Short phrases that recur in many interviews at one question: each question's most widespread one, if it covers enough of them.

    (question, phrase, n_with_phrase, n_interviews, coverage), the widest first. Ties go to the first phrase in order.
    """
    # one pass: a row for each sentence's short phrase, and one without a phrase that counts the interviews
    short = X.let(phrase, lambda p: F.when((p != "") & (X.word_count(p) <= S.SHORT_TOKENS), p))
    told = sentences.select(by, over, F.explode(F.array(F.lit(None).cast("string"), short)).alias("phrase"))
    spread = told.groupBy(by, over, "phrase").agg(F.lit(1).alias("_one")).groupBy(by, "phrase").agg(F.count(F.lit(1)).alias("n"), F.count(over).alias("known"))
    named = F.col("phrase").isNotNull()
    best = spread.groupBy(by).agg(
        F.max(F.when(named, F.col("n"))).alias("n_with_phrase"), F.min_by("phrase", F.when(named, F.struct(-F.col("n"), "phrase"))).alias("phrase"), F.max(F.when(~named, F.col("known"))).alias("n_interviews")
    )
    both = best.where("n_with_phrase is not null").withColumn("coverage", F.col("n_with_phrase") / F.col("n_interviews"))
    flagged = both.where(F.col("coverage") >= S.COVERAGE)
    return flagged.orderBy(F.desc("coverage"), by).limit(most).select(by, "phrase", "n_with_phrase", "n_interviews", F.bround("coverage", 2).alias("coverage"))


def assertions(facts: dict[str, DataFrame]) -> DataFrame:
    """(name, passed) of one-row, one-column boolean tables; an unknown result has not passed."""
    rows = [df.select(F.lit(name).alias("name"), F.coalesce(F.col(df.columns[0]), F.lit(False)).alias("passed")) for name, df in facts.items()]
    return reduce(DataFrame.unionByName, rows)


def holds(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether every row meets the condition; true for no rows."""
    return df.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("passed"))


def all_pass(told: DataFrame) -> DataFrame:
    return told.agg(F.bool_and("passed").alias("all_passed"))


def missing_transcripts(raw: DataFrame, listed: DataFrame) -> DataFrame:
    return listed.join(raw, "interview_id", "left_anti").select("interview_id").distinct()


def markdown(df: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(str(v) for v in row)} |\n" for row in df.collect())


def topic_keys(documents: DataFrame) -> DataFrame:
    """(interview_id, question_id) of a topic-model input."""
    return documents.select("metadata.interview_id", "metadata.question_id")


#: The ten assertions over the stages of a run.
ASSERTIONS = (
    "sentiment_parts_make_the_whole", "assigned_and_outliers_make_the_documents", "topic_input_counts_as_its_stats_say", "no_duplicate_keys_in_topic_input",
    "no_repeated_questions_in_raw_transcripts", "full_responses_match_topic_input", "topic_input_drops_exactly_the_empty_responses",
    "no_responses_lost_before_sentiment", "no_responses_lost_by_sentiment", "copies_of_files_are_identical",
)


@dataclass
class Stages:
    """The tables of one run, or of several that a column ``run`` tells apart. Without a table, what needs it holds."""

    raw: DataFrame  # interview_id, question_id: a row for each question found in a transcript
    processed: DataFrame  # interview_id, question_id, text
    documents: DataFrame  # interview_id, question_id
    stats: DataFrame  # total_documents
    topic_counts: DataFrame | None  # topic (-1: outliers), count
    sentiment_input: DataFrame  # interview_id, question_id
    sentiment_results: DataFrame | None  # interview_id, question_id, confusion
    files: DataFrame | None  # first_exists, second_exists, byte_identical


def run_assertions(stages: Stages) -> DataFrame:
    """(run, name, passed) of every run that has processed responses; ``run`` is null where the tables have none."""
    of = lambda df: df if "run" in df.columns else df.withColumn("run", F.lit(None).cast("int"))
    by = lambda df: of(df).groupBy("run")
    keys = lambda df: of(df).select("run", *KEYS)
    count, n_keys = F.count(F.lit(1)), F.count_distinct(F.struct(*KEYS))
    lost = lambda a, b: minus(keys(a), keys(b))

    def minus(a: DataFrame, b: DataFrame) -> DataFrame:
        """Keys of ``a`` that ``b`` lacks; nulls are equal."""
        told = a.withColumn("_in", F.lit(0)).unionByName(b.withColumn("_in", F.lit(1)))
        return told.groupBy("run", *KEYS).agg(F.max("_in").alias("_in")).where("_in = 0").drop("_in")

    def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
        """Runs for which two tables (run, n) differ; a run that one lacks has 0 there."""
        return a.unionByName(b.withColumn("n", -F.col("n"))).groupBy("run").agg(F.sum("n").alias("n")).where("n <> 0")

    processed, documents = of(stages.processed), of(stages.documents)
    empty = processed.where(X.is_blank(F.col("text")))
    faults = {name: None for name in ASSERTIONS}
    if stages.sentiment_results is not None:
        status = F.col("confusion.status")
        told = F.count_if(status == "CONFUSED") + F.count_if(status == "NOT_CONFUSED") + F.count_if(F.col("confusion").isNull())
        faults[ASSERTIONS[0]] = by(stages.sentiment_results).agg((count - told).alias("n")).where("n <> 0")
        faults[ASSERTIONS[8]] = lost(stages.sentiment_input, stages.sentiment_results)
    if stages.topic_counts is not None:
        faults[ASSERTIONS[1]] = unequal(by(stages.topic_counts).agg(F.sum("count").alias("n")), by(documents).agg(count.alias("n")))
    faults[ASSERTIONS[2]] = unequal(by(stages.stats).agg(F.sum("total_documents").alias("n")), by(documents).agg(count.alias("n")))
    faults[ASSERTIONS[3]] = duplicates(documents, "run", *KEYS)
    faults[ASSERTIONS[4]] = duplicates(of(stages.raw), "run", *KEYS)
    faults[ASSERTIONS[5]] = unequal(processed.groupBy("run").agg(F.count_if(~X.is_blank(F.col("text"))).alias("n")), documents.groupBy("run").agg(n_keys.alias("n")))
    dropped = lost(processed, documents)
    faults[ASSERTIONS[6]] = minus(dropped, keys(empty)).unionByName(minus(keys(empty), dropped))
    faults[ASSERTIONS[7]] = lost(processed, stages.sentiment_input)
    if stages.files is not None:
        faults[ASSERTIONS[9]] = of(stages.files).where("first_exists and second_exists and byte_identical is not true")
    found = reduce(DataFrame.unionByName, (df.select("run", F.lit(name).alias("name")) for name, df in faults.items() if df is not None)).groupBy("run", "name").agg(F.lit(True).alias("_fault"))
    asked = processed.groupBy("run").agg(count.alias("_n")).select("run", F.explode(F.array(*map(F.lit, ASSERTIONS))).alias("name"))
    met = (asked["run"].eqNullSafe(found["run"])) & (asked["name"] == found["name"])
    return asked.join(found, met, "left").select(asked["run"], asked["name"], F.col("_fault").isNull().alias("passed"))
