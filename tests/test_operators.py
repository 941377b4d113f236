"""Operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schemas as S
from quern.models import CopyTranslator
from quern.operators import audit, evaluation, language, memory, process, report, segments, sentiment, topics, translate, vectors
from quern.plans import flows
from quern.schemas import MEMORY
from quern.sources import transcripts
from quern.streaming import incremental

LONG_CA = "aquest és un text molt llarg que parla dels camps i també de les vaques perquè són importants"
LONG_ES = "este es un texto muy largo que habla de los campos y también de las vacas porque son importantes"


class Failing(CopyTranslator):
    def translate(self, text, source, target, retry=False):
        return F.when(F.lit(retry) | ~text.contains("FALLA"), F.upper(text))


def corpus(spark):
    rows = [("i1", "1", LONG_CA), ("i1", "2", "No."), ("i2", "1", LONG_ES), ("i2", "2", "  "), ("i3", "1", None)]
    return spark.createDataFrame(rows, "interview_id string, question_id string, original_text string")


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("-.Pregunta 1.1.-\n[00:00:01.000 --> 00:00:05.000]   Sí.\n-.Pregunta 1.2a.-No. -.Pregunta 1.1.- Altra")
    raw = transcripts.read_transcripts(spark, str(tmp_path))
    listed = transcripts.parse_list(raw).orderBy("position").collect()
    assert [(r.question_id, r.original_text) for r in listed] == [("1.1", "Sí."), ("1.2a", "No."), ("1.1", "Altra")]
    assert {(r.question_id, r.original_text) for r in transcripts.parse_map(raw).collect()} == {("1.2a", "No."), ("1.1", "Altra")}


def test_corpus_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"i1": {"q1": "a", "q2": ""}, "i2": {}}')
    assert {tuple(r) for r in transcripts.read_corpus(spark, str(tmp_path / "c.json")).collect()} == {("i1", "q1", "a"), ("i1", "q2", "")}
    assert transcripts.read_corpus(spark, str(tmp_path / "none.json")).count() == 0


def test_process_accounts_for_every_row(spark):
    done = process.process(corpus(spark), spark.createDataFrame([], MEMORY), translator=Failing())
    rows = {r.response_id: r for r in done.responses.collect()}
    assert len(rows) == 5
    assert rows["i2::2"].status == "EXCLUDED" and rows["i3::1"].quality is None
    assert rows["i1::1"].source_language == "ca" and rows["i1::1"].text_es_status == "TRANSLATED" and rows["i1::1"].text_es == LONG_CA.upper()
    assert rows["i1::2"].language_detection_method == "interview_fallback_short" and rows["i1::2"].source_language == "ca"
    assert rows["i2::1"].text_es_status == "IDENTITY_COPY" and rows["i2::1"].text_es == LONG_ES
    told = report.judged(done, 5).first()
    assert told.structurally_valid and told.complete and told.output_valid and told.expected_topic_documents == 3 and told.sanity_status == "REVIEW"


def test_retry_and_memory(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "ca", "FALLA"), ("s2", "ca", "bé"), ("s3", "es", "hola"), ("s4", "ca", "bé")], "sentence_id string, source_language string, text_source string")
    path = str(tmp_path / "memory")
    first = translate.sentences(rows, memory.load(spark, path), Failing())
    got = {r.sentence_id: (r.text_es, r.translation_provenance) for r in first.collect()}
    assert got == {"s1": ("FALLA", "RETRY_OK"), "s2": ("BÉ", "FRESH_OK"), "s3": ("hola", "SOURCE_ES"), "s4": ("BÉ", "FRESH_OK")}
    made = translate.translate(rows.where("source_language = 'ca'"), memory.load(spark, path), Failing())
    memory.append(translate.memory_rows(translate.made(made), Failing()), path)
    assert memory.load(spark, path).count() == 1
    again = translate.sentences(rows, memory.load(spark, path), Failing())
    assert {r.sentence_id: r.translation_provenance for r in again.collect()}["s2"] == "CACHE_HIT"
    asked = memory.keyed(rows.where("source_language = 'ca'"), "text_source", F.col("source_language"), "copy", "1")
    assert memory.coverage(asked, memory.load(spark, path)).first()["hits"] == 2
    with pytest.raises(ValueError):
        memory.require_warm(asked, memory.load(spark, path))


def test_vote_breaks_ties(spark):
    rows = spark.createDataFrame([("i", True, "es"), ("i", True, "ca"), ("i", False, "es"), ("k", True, "en")], "interview_id string, long_enough boolean, detected_lang string")
    got = {r.interview_id: r for r in language.primary_languages(rows).collect()}
    assert got["i"].interview_primary_language == "ca" and got["i"].tie_broken
    assert got["k"].interview_primary_language == "ca" and got["k"].fallback_used


def test_statuses(spark):
    cases = [(False, 0, 0, 0, "IDENTITY_COPY"), (True, 0, 0, 0, "WARNING_TRANSLATION_FAILED"), (True, 3, 3, 0, "WARNING_TRANSLATION_FAILED"), (True, 3, 1, 2, "PARTIAL_TRANSLATION_FAILURE"), (True, 3, 0, 3, "CACHE_HIT"), (True, 3, 0, 2, "TRANSLATED")]
    rows = spark.createDataFrame(cases, "r boolean, t int, f int, h int, want string")
    assert rows.where(process.response_status(F.col("r"), F.col("t"), F.col("f"), F.col("h")) != F.col("want")).count() == 0


@pytest.mark.parametrize("n,k", [(100, 10), (7, 3), (5, 5), (5, 9), (10, 0), (1000, 7)])
def test_evenly_spaced(spark, n, k):
    rows = spark.range(n)
    want = list(range(n)) if k >= n else sorted({int(i * (n / k)) for i in range(k)}) if k else []
    assert sorted(r[0] for r in process.evenly_spaced(rows, "id", k).collect()) == want


def test_frozen_segmentation(spark):
    told = corpus(spark).where("question_id = '1' and original_text is not null").withColumn("response_id", F.concat_ws("::", "interview_id", "question_id")).withColumn("source_language", F.lit("ca"))
    cut = segments.numbered(told)
    assert segments.reconstruction_problems(told, cut).count() == 0
    frozen = segments.freeze(told, cut)
    head = segments.manifest(frozen, "abc")
    assert segments.frozen_problems(frozen, head, told, "abc").count() == 0
    changed = told.withColumn("original_text", F.concat("original_text", F.lit("!")))
    assert {r.kind for r in segments.frozen_problems(frozen, head, changed, "other").collect()} == {"input_sha256", "changed_text"}


def test_streaks(spark):
    rows = spark.createDataFrame([("u", i, bad) for i, bad in enumerate([True, True, False, True, True, True])] + [("v", 0, False)], "u string, i int, bad boolean")
    got = {r.u: (r.longest_streak, r.aborts) for r in report.failure_streaks(rows, ["u"], "i", F.col("bad"), 3).collect()}
    assert got == {"u": (3, True), "v": (0, False)}


def test_recurring_phrases(spark):
    rows = spark.createDataFrame([("q", i, t) for i, t in [(1, "Molt bé."), (2, "molt bé"), (3, "no"), (4, "una frase massa llarga per comptar")]], "question_id string, interview_id int, t string")
    from quern.functions import text as X

    got = audit.recurring_phrases(rows, X.normal_sentence(F.col("t"))).collect()
    assert [(r.phrase, r.n_with_phrase, r.n_interviews, r.coverage) for r in got] == [("molt bé", 2, 4, 0.5)]


def test_sentiment_rollup(spark):
    rows = spark.createDataFrame([("i", "q", "muy bueno y bien"), ("i", "q", "tengo duda"), ("i", "q", "malo")], "interview_id string, question_id string, text string")
    told = sentiment.analyse(rows)
    assert [r.sentiment for r in told.collect()] == ["VERY_POSITIVE", "NEUTRAL", "NEGATIVE"]
    got = sentiment.by_question(told, "interview_id", "question_id").first()
    assert got.score == pytest.approx(10 / 3) and got.confusion_percentage == pytest.approx(100 / 3)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        cost = rng.random((n, m))
        got = evaluation.assign(cost)
        assert len(got) == min(n, m) == len({a for a, _ in got}) == len({b for _, b in got})
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert sum(cost[a, b] for a, b in got) == pytest.approx(best)


def test_stability():
    assert evaluation.stability([["a", "b"], ["c"]], [["c"], ["a", "b"]]) == 1.0
    assert evaluation.stability([["a"]], [["a"], ["b"]]) == 0.5
    assert evaluation.stability([], [["a"]]) == 0.0


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None), (98, [0.0] * 5)], "id int, v array<double>").repartition(3)
    got = {}
    for r in vectors.nearest(rows, "id", "v", 3, block=17).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    assert {i: [g[k] for k in (1, 2, 3)] for i, g in got.items()} == {i: np.argsort(-score[i])[:3].tolist() for i in range(60)}


@pytest.mark.parametrize("algorithm", ["lda", "nmf", "svd", "cluster"])
def test_topic_models(spark, algorithm):
    texts = [f"granja vaca llet camp pastura {k % 3}" for k in range(15)] + [f"sensor dada xarxa robot mesura {'xarxa' if k % 2 else 'robot'}" for k in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    found = topics.extract_topics(docs, algorithm, 2, n_words=4)
    rows = found.topics.collect()
    assert 1 <= len(rows) <= 2 and all(len(r.words) <= 4 and r.scores == sorted(r.scores, reverse=True) for r in rows)
    assert found.documents.count() == 30
    if algorithm in ("nmf", "svd"):
        assert len({r.topic for r in found.documents.collect()}) == 2


@pytest.mark.parametrize("algorithm", ["nmf", "svd"])
def test_spread_and_blocks_agree(spark, algorithm, monkeypatch):
    texts = [f"granja vaca llet camp pastura {k % 3}" for k in range(15)] + [f"sensor dada xarxa robot mesura {'xarxa' if k % 2 else 'robot'}" for k in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")

    def run():
        found = topics.extract_topics(docs, algorithm, 2, n_words=4)
        return {r.topic: [round(x, 3) for x in r.scores] for r in found.topics.collect()}, sorted(map(tuple, found.documents.collect()))

    first = run()
    monkeypatch.setattr(topics, "BROADCAST", 0)
    assert run() == first


def test_terms_are_all_kept(spark):
    """Two documents share each of 21,000 words, in an order of their own: every word is a term, and no pair of words."""
    words = [f"w{''.join(chr(97 + int(c)) for c in f'{i:05d}')}" for i in range(21_000)]
    texts = [" ".join(words[k::10]) for k in range(10)] + [" ".join(reversed(words[k::10])) for k in range(10)] + ["sol unic"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    weighed, named = topics.tfidf(topics.prepared(docs))
    assert named.count() == 21_000 and {r.word for r in named.collect()} == set(words)
    told = weighed.groupBy("doc").agg(F.count("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("length")).collect()
    assert {r.doc: r.n for r in told} == {k: 2100 for k in range(20)} and all(abs(r.length - 1) < 1e-9 for r in told)


def test_topic_guards(spark):
    few = spark.createDataFrame([(1, "a b")], "doc long, text string")
    with pytest.raises(ValueError):
        topics.extract_topics(few, "cluster")
    with pytest.raises(ValueError):
        topics.extract_topics(few, "lda")


def test_stream_ingestion(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "in"))
    places = incremental.Places(*(str(tmp_path / n) for n in ("memory", "responses", "sentences", "checkpoint")))
    incremental.ingest(incremental.read_responses(spark, str(tmp_path / "in")), places).awaitTermination()
    assert spark.read.parquet(places.responses).count() == 5
    incremental.ingest(incremental.read_responses(spark, str(tmp_path / "in")), places).awaitTermination()
    assert spark.read.parquet(places.responses).count() == 5


class Counting(CopyTranslator):
    """Fails on anything, so that only a memory can translate."""

    def translate(self, text, source, target, retry=False):
        return F.lit(None).cast("string")


def test_memory_fills(spark, tmp_path):
    """A second run over the same corpus has hits only; it never needs the model, and the warm gate lets it pass."""
    from quern import api

    (tmp_path / "c.json").write_text('{"i1": {"1": "%s", "2": "FALLA aquí. Bé."}, "i2": {"1": "%s"}}' % (LONG_CA, LONG_ES))
    place = lambda n: str(tmp_path / n)
    run = lambda out, model, warm: api.run_corpus(spark, place("c.json"), place(out), place("m"), warm=warm, translator=model)
    with pytest.raises(ValueError):
        run("early", Failing(), True)
    assert not (tmp_path / "early").exists()  # the gate comes before any work
    run("first", Failing(), False)
    told = {r.text_source: r.translation_provenance for r in spark.read.parquet(place("first/sentences")).collect()}
    assert told["FALLA aquí."] == "RETRY_OK" and told["Bé."] == "FRESH_OK"
    assert memory.load(spark, place("m")).count() == 3
    run("second", Counting(), False)
    again = {r.text_source: (r.translation_provenance, r.text_es) for r in spark.read.parquet(place("second/sentences")).collect()}
    assert again["Bé."] == ("CACHE_HIT", "BÉ.") and again["FALLA aquí."][1] == "FALLA AQUÍ."
    api.preflight(spark, api.load_corpus(spark, place("c.json")), place("m")).first()
    (tmp_path / "d.json").write_text('{"i1": {"1": "%s"}}' % LONG_CA)
    api.run_corpus(spark, place("d.json"), place("warm"), place("m"), warm=True, translator=Counting())


def test_stream_fills_the_memory(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "in"))
    places = incremental.Places(*(str(tmp_path / n) for n in ("memory", "responses", "sentences", "checkpoint")))
    incremental.ingest(incremental.read_responses(spark, str(tmp_path / "in")), places, Failing()).awaitTermination()
    assert memory.load(spark, places.memory).count() == 2
    corpus(spark).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.ingest(incremental.read_responses(spark, str(tmp_path / "in")), places, Counting()).awaitTermination()
    assert {r.translation_provenance for r in spark.read.parquet(places.sentences).where("batch = 1").collect()} == {"CACHE_HIT", "SOURCE_ES"}


def test_exact_sentence_ids(spark):
    done = process.process(corpus(spark), spark.createDataFrame([], MEMORY), translator=Failing())
    other = done.sentences.withColumn("sentence_id", F.when(F.col("sentence_id") == "i1::2::s000", "x").otherwise(F.col("sentence_id")))
    swapped = process.Processed(done.responses, other, done.translated, done.expected, done.fatal)
    told = report.judged(swapped, 5).first()
    assert told.sentence_ids == told.sentences and not told.structurally_valid and told.sanity_status == "REVIEW"
    got = {r.side: r.first for r in report.sentence_ids(done.expected, other).collect()}
    assert got == {"left": ["i1::2::s000"], "right": ["x"]}


def test_missing_frozen_response_is_fatal(spark):
    told = corpus(spark).where("original_text is not null and trim(original_text) <> ''").withColumn("response_id", F.concat_ws("::", "interview_id", "question_id")).withColumn("source_language", F.lit("es"))
    frozen = segments.freeze(told, segments.numbered(told)).where("response_id <> 'i1::2'")
    done = process.process(corpus(spark), spark.createDataFrame([], MEMORY), frozen, translator=Failing())
    assert [tuple(r) for r in done.fatal.collect()] == [("i1::2", "missing_from_frozen_segmentation")]
    assert not report.judged(done, 5).first().structurally_valid
    assert {(r.id, r.reason) for r in report.warnings(done.responses, done.sentences, done.fatal).collect()} >= {("i1::1", "frozen_language_differs"), ("i1::2", "missing_from_frozen_segmentation")}


def test_freeze_audit_and_bridge(spark, tmp_path):
    from quern import api

    (tmp_path / "c.json").write_text('{"i1": {"1": "%s", "2": "No."}, "i2": {"1": "%s"}}' % (LONG_CA, LONG_ES))
    place = lambda n: str(tmp_path / n)
    assert api.main(["freeze", place("c.json"), place("frozen")]) == 0
    api.run_corpus(spark, place("c.json"), place("run"), place("m"), translator=Failing(), frozen_path=place("frozen"))
    assert api.main(["audit", place("c.json"), place("run"), place("audit")]) == 0
    assert spark.read.json(place("audit/assertions")).count() == 10 and api.bridge_is_fresh(spark, place("c.json"), place("run"))
    (tmp_path / "c.json").write_text('{"i1": {"1": "%s"}}' % LONG_CA)
    assert not api.bridge_is_fresh(spark, place("c.json"), place("run"))
    with pytest.raises(ValueError):
        api.run_corpus(spark, place("c.json"), place("other"), place("m"), translator=Failing(), frozen_path=place("frozen"))
    assert api.main(["process", "smoke", place("smoke"), "--memory", place("m2"), "--mode", "preflight"]) == 0


def test_coherences(spark):
    docs = spark.createDataFrame([("a b c d",), ("a b x y",), ("c d x y",), ("a b c z",)] * 3, "text string")
    found = spark.createDataFrame([("good", ["a", "b"]), ("bad", ["b", "x"])], "topic string, words array<string>")
    from quern.functions import text as X

    for told in (evaluation.coherence_v(found, docs, X.words(F.col("text")), 3), evaluation.coherence(found, docs, X.words(F.col("text")), 2)):
        got = {r[0]: r[1] for r in told.collect()}
        assert got["good"] > got["bad"]


def test_evaluation(spark, tmp_path):
    from quern import api

    texts = [f"granja vaca llet camp pastura {k % 3}" for k in range(15)] + [f"sensor dada xarxa robot mesura {'xarxa' if k % 2 else 'robot'}" for k in range(15)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r.algorithm: r for r in api.evaluate(spark, docs, str(tmp_path / "e"), 2, ("nmf", "svd"), (0, 42)).collect()}
    assert rows["nmf"].topics == 2 and 0 < rows["nmf"].diversity <= 1 and rows["nmf"].stability_mean > 0.5
    assert spark.read.option("header", True).csv(str(tmp_path / "e/evaluation_csv")).count() == 2
    with pytest.raises(ValueError):
        evaluation.preconditions(docs, 30, 2, 30)


def test_stored_results_are_checked(spark):
    made = lambda name, k, n: (name, "all", "all_interviews", (n,) if n is not None else None, None, {f"Topic {i}": (["a"], [1.0], 1, "all") for i in range(k)})
    stored = spark.createDataFrame([made("lda", 2, 3), made("nmf", 3, 3), made("svd", 2, 4), made("other", 2, None)], S.TOPIC_RESULT)
    told = evaluation.stored_problems(stored, spark.range(3), 2, ("lda", "nmf", "svd", "other", "cluster")).collect()
    assert sorted(map(tuple, told)) == [("cluster", "missing"), ("nmf", "topics"), ("svd", "documents")]


def test_each_planted_fault_is_told(spark):
    told = flows.q76_run_assertions(spark, "/root/testdata/sf0.001").collect()
    assert len(told) == 110 and {(r.run, audit.ASSERTIONS.index(r.name) + 1) for r in told if not r.passed} - {(7, 6)} == {(k, k) for k in range(1, 11)}


def test_key_difference(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    got = {r.side: (r.n, r.first) for r in report.key_difference(a, b, ["k"]).collect()}
    assert got == {"left": (1, ["1"]), "right": (2, ["3", "4"])}


def test_token_limit(spark):
    from quern.functions import text as X

    got = spark.createDataFrame([("a b c d e f g",)], "t string").select(segments.within_tokens(F.array("t"), X.word_count, 2).alias("p")).first().p
    assert all(len(x.split()) <= 2 for x in got) and " ".join(got) == "a b c d e f g"


def test_round_trip(spark):
    done = process.process(corpus(spark), spark.createDataFrame([], MEMORY), translator=Failing())
    got = process.round_trip(done.responses, spark.createDataFrame([], MEMORY), CopyTranslator()).first()
    assert got.n == 2 and got.p05 > 0.99


def test_stopwords(spark):
    from quern.functions import text as X

    rows = spark.createDataFrame([("El ser de la casa 12!",)], "t string")
    kept = X.legacy_topic_text(F.col("t"), lambda w: F.transform(w, F.lower), ("el", "de", "la", "ser"))
    assert rows.select(kept).first()[0] == "ser casa"


def test_command_line_and_request(spark, tmp_path):
    from quern import api

    (tmp_path / "c.json").write_text('{"i1": {"1": "%s", "2": "No."}, "i2": {"1": "%s"}}' % (LONG_CA, LONG_ES))
    args = ["process", str(tmp_path / "c.json"), str(tmp_path / "out"), "--memory", str(tmp_path / "m")]
    code = api.main(args)
    report_row = spark.read.json(str(tmp_path / "out" / "report")).first()
    assert code == (0 if report_row.valid else 1) and report_row.structurally_valid and report_row.responses == 3
    told = api.analyse(spark, {"type": "sentiment", "texts": ["bueno", "malo"]})
    assert [r["sentiment"] for r in told] == ["POSITIVE", "NEGATIVE"]
    with pytest.raises(ValueError):
        api.analyse(spark, {"type": "other"})


def test_streams_of_events(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    stamp = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [(1, 0, 7, "error"), (2, 10, 7, "error"), (3, 50, 7, "error"), (4, 51, 8, "view"), (5, 300, 8, "view")]
    df = spark.createDataFrame([(i, stamp(m), u, k) for i, m, u, k in rows], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "events"))

    def run(out, mode, name):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    streaks = run(incremental.failure_streaks(stream()), "update", "streaks")
    assert {(r.user_id, r.streak, r.aborts) for r in streaks.collect()} == {(7, 3, True), (8, 0, False)}
    closed = run(incremental.sessions(stream()), "append", "closed")  # what the watermark has not passed stays open
    assert {(r.user_id, r.n) for r in closed.collect()} == {(7, 2), (7, 1), (8, 1)}
    hours = run(incremental.windowed_counts(stream()), "append", "hours")
    assert {(r.event_type, r.n) for r in hours.collect()} == {("error", 3), ("view", 1)}
