"""The command line and the small HTTP entry: thin wrappers over the operators."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas as S
from quern.models import CopyTranslator, LanguageDetector, Translator
from quern.operators import audit, evaluation, language, memory, process, report, segments, sentiment, topics, translate
from quern.sources import transcripts

BRIDGE_VERSION = 1
#: Fixed value: the corpus of two interviews that a smoke run takes.
SMOKE = [("smoke_ca", "1", "Tenim una granja petita i les vaques pasturen als camps cada dia."), ("smoke_es", "1", "Tenemos una granja pequeña y las vacas pastan en los campos cada día.")]


def session(name: str = "quern") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def analyse(spark: SparkSession, request: dict) -> list[dict]:
    """``{type: topics or sentiment, texts, algorithm, n_topics, stopwords}`` to rows; texts are told apart by their place."""
    rows = spark.createDataFrame(list(enumerate(request.get("texts") or [])), "doc long, text string")
    if request.get("type") == "sentiment":
        out: DataFrame = sentiment.analyse(rows)
    elif request.get("type") == "topics":
        words = tuple(request.get("stopwords") or topics.STOPWORDS)
        out = topics.extract_topics(rows, request.get("algorithm", "cluster"), request.get("n_topics"), stopwords=words).topics
    else:
        raise ValueError(f"unknown type: {request.get('type')}")
    return [json.loads(x) for x in out.toJSON().collect()]


def load_corpus(spark: SparkSession, corpus: str, questions: list[str] | None = None) -> DataFrame:
    """A corpus file, a folder of transcripts, or ``smoke``."""
    if corpus == "smoke":
        rows = spark.createDataFrame(SMOKE, S.RESPONSES_IN)
    else:
        rows = transcripts.read_corpus(spark, corpus) if corpus.endswith(".json") else transcripts.parse_map(transcripts.read_transcripts(spark, corpus))
    return transcripts.only_questions(rows, questions) if questions else rows


def preflight(spark: SparkSession, rows: DataFrame, memory_path: str, translator: Translator | None = None, detector: LanguageDetector | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """What a run would ask of the memory: total, hits, misses, coverage, first_missing. Nothing is translated."""
    model = translator or CopyTranslator()
    found = language.detected(process.routed(rows).where("status = 'OK'"), detector)
    told = language.response_languages(found, language.primary_languages(found))
    if frozen is not None:
        told = process.with_frozen(told, frozen)
        cut = frozen.where("sentence_id is not null").select("response_id", "sentence_id", "text_source")
    else:
        cut = segments.numbered(told).select("response_id", "sentence_id", "text_source")
    asked = cut.join(told.select("response_id", "source_language"), "response_id").where(F.col("source_language") != S.TARGET_LANGUAGE)
    return memory.coverage(memory.keyed(asked, "text_source", F.col("source_language"), model.name, S.GENERATION_VERSION), memory.load(spark, memory_path))


def run_corpus(
    spark: SparkSession, corpus: str, out: str, memory_path: str, questions: list[str] | None = None, warm: bool = False,
    translator: Translator | None = None, detector: LanguageDetector | None = None, frozen_path: str | None = None,
) -> bool:
    """Process a corpus; write responses, sentences and the report, and what was translated to the memory; tell whether all gates hold.

    With ``warm`` the run stops before any work unless the memory holds every sentence. The bridge and its manifest,
    which names the digests of what it was made of, are written for a valid run only.
    """
    rows = load_corpus(spark, corpus, questions)
    report.require(audit.duplicates(rows, "interview_id", "question_id").isEmpty(), "a question occurs twice in an interview")
    frozen = spark.read.parquet(f"{frozen_path}/sentences") if frozen_path else None
    known = memory.load(spark, memory_path)
    if warm:
        report.require(not preflight(spark, rows, memory_path, translator, detector, frozen).first()["misses"], "texts are not in the translation memory")
    if frozen is not None:
        problems = segments.frozen_problems(frozen, spark.read.json(f"{frozen_path}/manifest"), process.routed(rows).where("status = 'OK'"), corpus_digest(rows)).where("kind <> 'missing_response'")
        report.require(problems.isEmpty(), "the frozen segmentation does not fit the corpus")

    def settle(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(table.schema).parquet(f"{out}/{name}")

    done = process.process(rows, known, frozen, translator, detector, settle=settle)
    memory.append(translate.memory_rows(done.translated, translator), memory_path)
    responses, sentences = settle(done.responses, "responses"), settle(done.sentences, "sentences")
    done = process.Processed(responses, sentences, done.translated, done.expected, done.fatal)
    told = report.judged(done, rows.count())
    transcripts.write_json(told, f"{out}/report")
    transcripts.write_json(report.warnings(responses, sentences, done.fatal), f"{out}/warnings")
    valid = bool(told.first()["valid"])
    if valid:
        settle(process.bridge(responses, sentences), "bridge")
        transcripts.write_json(transcripts.topic_stats(settle(transcripts.topic_documents(responses), "topic_input")), f"{out}/topic_stats")
        digests = {"input_sha256": corpus_digest(rows), "responses_sha256": corpus_digest(responses.select("interview_id", "question_id", F.col("text_es").alias("original_text")))}
        head = told.select(F.lit(BRIDGE_VERSION).alias("schema_version"), "valid", *(F.lit(v).alias(k) for k, v in digests.items()), F.current_timestamp().alias("created_at"))
        transcripts.write_json(head, f"{out}/manifest")
    return valid


def corpus_digest(rows: DataFrame) -> str:
    """One digest of all (interview, question, text), whatever their order."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("interview_id", "question_id", "original_text"), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("s")).select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("s", F.lit(0)).cast("string")), 256).alias("d"))
    return told.first()["d"]


def bridge_is_fresh(spark: SparkSession, corpus: str, out: str, questions: list[str] | None = None) -> bool:
    """Whether the bridge in ``out`` was made of this very corpus."""
    head = transcripts.read_json(spark, f"{out}/manifest", "schema_version int, valid boolean, input_sha256 string, responses_sha256 string")
    told = report.bridge_fresh(head, BRIDGE_VERSION, {"input_sha256": corpus_digest(load_corpus(spark, corpus, questions))}).first()
    return bool(told and told["fresh"])


def freeze_corpus(spark: SparkSession, corpus: str, out: str, detector: LanguageDetector | None = None) -> int:
    """Write the frozen segmentation of a corpus: its sentences and, last, its manifest; refuse one that loses words. The number of sentences."""
    rows = load_corpus(spark, corpus)
    found = language.detected(process.routed(rows).where("status = 'OK'"), detector)
    told = language.response_languages(found, language.primary_languages(found))
    frozen = segments.freeze(told, segments.numbered(told))
    report.require(segments.reconstruction_problems(told, frozen.where("sentence_id is not null")).isEmpty(), "the sentences don't add up to their responses")
    frozen.write.mode("overwrite").parquet(f"{out}/sentences")
    frozen = spark.read.parquet(f"{out}/sentences")
    transcripts.write_json(segments.manifest(frozen, corpus_digest(rows)), f"{out}/manifest")
    return frozen.where("sentence_id is not null").count()


def audit_run(spark: SparkSession, corpus: str, run: str, out: str) -> bool:
    """The assertions over a run's tables, as JSON and Markdown; whether all hold."""
    rows, responses = load_corpus(spark, corpus), spark.read.parquet(f"{run}/responses")
    documents = spark.read.parquet(f"{run}/topic_input")
    stats = spark.read.schema("total_documents long").json(f"{run}/topic_stats")
    raw = rows if corpus == "smoke" or corpus.endswith(".json") else transcripts.parse_list(transcripts.read_transcripts(spark, corpus))
    usable = responses.where("status = 'OK'").withColumn("text", F.col("topic_text_es_clean"))
    told = audit.run_assertions(audit.Stages(raw, usable, audit.topic_keys(documents), stats, None, spark.read.parquet(f"{run}/bridge"), None, None)).drop("run")
    stages = audit.stage_table({"input": (rows, "original_text"), "responses": (responses, "text_es"), "topic_input": (audit.topic_keys(spark.read.parquet(f"{run}/topic_input")), None)})
    transcripts.write_json(told, f"{out}/assertions")
    transcripts.write_json(stages, f"{out}/stages")
    text = audit.markdown(stages, "Stages") + "\n" + audit.markdown(told, "Assertions")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/markdown")
    return bool(audit.all_pass(told).first()["all_passed"])


def evaluate(spark: SparkSession, documents: DataFrame, out: str, k: int = S.TOPIC_WORDS, algorithms: tuple[str, ...] = ("cluster", "lda", "nmf", "svd"), seeds: tuple[int, ...] = S.EVALUATION_SEEDS) -> DataFrame:
    """Diversity, both coherences and the stability over seeds of each algorithm's topics, as JSON and as CSV with a header."""
    told = evaluation.compare(documents, k, algorithms, seeds)
    transcripts.write_json(told, f"{out}/evaluation_json")
    told.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/evaluation_csv")
    return spark.read.schema(told.schema).json(f"{out}/evaluation_json")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    commands = parser.add_subparsers(dest="command", required=True)
    corpus = commands.add_parser("process", help="process a corpus")
    corpus.add_argument("corpus", help="a JSON file, a folder of transcripts, or smoke")
    corpus.add_argument("out")
    corpus.add_argument("--memory", required=True)
    corpus.add_argument("--mode", choices=("full", "preflight"), default="full")
    corpus.add_argument("--frozen")
    corpus.add_argument("--questions", nargs="*")
    corpus.add_argument("--require-warm-memory", action="store_true")
    for name, text in (("freeze", "freeze a corpus's sentences"), ("audit", "check a run's tables"), ("evaluate", "evaluate topic models")):
        one = commands.add_parser(name, help=text)
        one.add_argument("corpus", help="a corpus, or for evaluate a Parquet folder of texts")
        if name == "audit":
            one.add_argument("run")
        one.add_argument("out")
    one = commands.add_parser("analyse", help="analyse texts given as JSON")
    one.add_argument("request", type=json.loads)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "process" and args.mode == "preflight":
        told = preflight(spark, load_corpus(spark, args.corpus, args.questions), args.memory)
        print(told.toJSON().first())
        return 0
    if args.command == "process":
        return 0 if run_corpus(spark, args.corpus, args.out, args.memory, args.questions, args.require_warm_memory, frozen_path=args.frozen) else 1
    if args.command == "freeze":
        print(freeze_corpus(spark, args.corpus, args.out))
    elif args.command == "audit":
        return 0 if audit_run(spark, args.corpus, args.run, args.out) else 1
    elif args.command == "evaluate":
        evaluate(spark, spark.read.parquet(args.corpus).select("text"), args.out).show()
    else:
        print(json.dumps(analyse(spark, args.request), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
