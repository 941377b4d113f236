"""Transcripts, corpora and topic inputs to tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X

#: Fixed value: a question marker and the text up to the next one or the end.
_MARKED = r"(?s)-\.Pregunta ([\da-zA-Z.]+)\.-(.*?)(?=-\.Pregunta [\da-zA-Z.]+\.-|\z)"


def read_transcripts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(interview_id = file name, content) of every transcript."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_name").alias("interview_id"), F.col("value").alias("content"))


def tidy_answer(c: Column) -> Column:
    """One line, without time stamps; doubled spaces are halved once, as the format has it."""
    flat = F.replace(F.replace(X.drop_stamps(X.strip(c)), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return X.strip(flat)


def parse_list(df: DataFrame) -> DataFrame:
    """(interview_id, position, question_id, original_text): every marker in order, repeated ones too."""
    ids, bodies = (F.regexp_extract_all("content", F.lit(_MARKED), F.lit(k)) for k in (1, 2))
    parts = df.select("interview_id", F.posexplode(F.arrays_zip(ids.alias("q"), bodies.alias("t"))).alias("position", "part"))
    return parts.select("interview_id", "position", F.col("part.q").alias("question_id"), tidy_answer(F.col("part.t")).alias("original_text"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    values = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values)).select(*df.columns)


def parse_map(df: DataFrame) -> DataFrame:
    """As ``parse_list``, but a repeated marker replaces the earlier one."""
    return last_wins(parse_list(df), ["interview_id", "question_id"], "position").drop("position")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON document as one row; no file or no such document: no row."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    body = spark.read.text(path, wholetext=True)
    kind = f"struct<{schema}>" if not schema.startswith(("map", "array", "struct")) else schema
    parsed = body.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("v")).where("v is not null")
    return parsed.select("v.*") if kind.startswith("struct") else parsed


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """{interview: {question: text}} to (interview_id, question_id, original_text)."""
    corpus = read_json(spark, path, S.CORPUS)
    if "v" not in corpus.columns:
        return spark.createDataFrame([], S.RESPONSES_IN)
    interviews = corpus.select(F.explode("v").alias("interview_id", "answers"))
    return interviews.select("interview_id", F.explode("answers").alias("question_id", "original_text"))


def nest(df: DataFrame, value: str = "original_text") -> DataFrame:
    """One row per interview with its map of answers: the rows of the nested form."""
    return df.groupBy("interview_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_id", value)))).alias("answers"))


def only_questions(df: DataFrame, questions: list[str]) -> DataFrame:
    """The chosen questions; interviews with none of them fall away by themselves."""
    return df.where(F.col("question_id").isin(questions))


def question_order(df: DataFrame) -> DataFrame:
    """The distinct questions with their sort keys, sorted."""
    return df.select("question_id").distinct().orderBy(X.question_parts(F.col("question_id")), "question_id")


def topic_documents(responses: DataFrame, text: str = "topic_text_es_clean") -> DataFrame:
    """(text, metadata): the documents of a topic-model input; blank texts go."""
    return responses.where(~X.is_blank(F.col(text))).select(F.col(text).alias("text"), F.struct("interview_id", "question_id").alias("metadata"))


def topic_stats(documents: DataFrame) -> DataFrame:
    """(total_documents, generated_at) of a topic-model input: one row."""
    return documents.agg(F.count(F.lit(1)).alias("total_documents")).withColumn("generated_at", F.current_timestamp())


def load_topic_documents(df: DataFrame) -> DataFrame:
    """The texts of a topic-model input; empty ones go, blank ones stay."""
    return df.where("text is not null and text <> ''").select("text")


def group_questions(df: DataFrame, text: str = "original_text") -> DataFrame:
    """(question_id, text): every question's answers, by interview, joined by spaces."""
    return df.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("interview_id", text))), lambda s: s[text]), " ").alias("text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one lower-cased word per line of every file."""
    return spark.read.text(path).select(F.lower(X.strip(F.col("value"))).alias("word")).where("word <> ''").distinct()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of files; a missing path gives no row."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
        return spark.createDataFrame([], "name string, size long, sha256 string")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def duplicate_files(spark: SparkSession, first: str, second: str, names: list[str]) -> DataFrame:
    """(name, first_exists, second_exists, byte_identical) of files that two folders should share."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    side = lambda folder, tag: file_digests(spark, f"{folder}/*").select("name", F.col("sha256").alias(tag))
    both = wanted.join(side(first, "a"), "name", "left").join(side(second, "b"), "name", "left")
    return both.select("name", F.col("a").isNotNull().alias("first_exists"), F.col("b").isNotNull().alias("second_exists"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("byte_identical"))


def result_files(spark: SparkSession, folder: str, prefix: str = "topic_results_") -> DataFrame:
    """(name, algorithm): result files by their name's third word."""
    files = file_digests(spark, f"{folder}/{prefix}*.json")
    return files.select("name", F.split_part(F.replace(F.col("name"), F.lit(".json"), F.lit("")), F.lit("_"), F.lit(3)).alias("algorithm"))


def write_json(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def result_name(kind: str, scope: Column, block: Column, question: Column, algorithm: Column) -> Column:
    """File name of a result by its scope."""
    tail = F.when(scope == "question_block", F.concat(F.lit("block_"), block)).when(scope == "individual_question", F.concat(F.lit("q_"), question)).otherwise("all")
    return F.concat(F.lit(f"{kind}_results_"), algorithm, F.lit("_"), tail, F.lit(".json"))


def scope(files: Column) -> Column:
    return F.when(files.contains("block"), "question_block").when(files.contains("question"), "individual_question").otherwise("all_interviews")


def write_results(df: DataFrame, path: str) -> None:
    """Topic or sentiment results, a folder per scope and algorithm."""
    df.write.mode("overwrite").partitionBy(*(c for c in ("scope", "algorithm") if c in df.columns)).json(path)


def topic_result_rows(df: DataFrame) -> DataFrame:
    """A topic result document to (topic, words, scores, count, topic_group)."""
    one = df.select(F.explode("topics").alias("topic", "t"))
    return one.select("topic", "t.words", "t.scores", "t.count", F.col("t.group").alias("topic_group"))


def newest_first(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows numbered within their key, newest first."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at))))


def without_words(tokens: DataFrame, listed: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is not on the list."""
    return tokens.join(listed.select(F.col("word").alias(word)), word, "left_anti")
