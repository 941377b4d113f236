"""The processing flow works each step once, and each sentence comes out once."""

import pytest
from pyspark.sql import functions as F

from quern.operators import memory, process, report, translate
from quern.operators.scratch import settled
from quern.plans import flows

DATA = "/root/testdata/sf0.001"


def test_each_step_works_once(spark):
    plans = {}

    def settle(table, name):
        assert name not in plans
        plans[name] = table._jdf.queryExecution().optimizedPlan().toString()
        return settled(table, name)[0]

    done = process.process(flows._corpus(spark, DATA), memory.none(spark), None, flows.Marking(), flows.ByLength(), settle=settle)
    assert sum(p.count("Window ") for p in plans.values()) == plans["cut"].count("Window ")  # sentences are cut in one table
    assert sum(p.count("Join ") for p in plans.values()) <= 5  # languages, sentences with their response, three passes of the model
    assert "Join" not in done.sentences._jdf.queryExecution().optimizedPlan().toString()
    told = done.sentences.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sentence_id").alias("ids")).first()
    assert told.n == told.ids == done.expected.count()


def test_repeated_sentence_ids_stay_as_many(spark):
    looping = flows.LOOP  # 107 characters: translated as they are, repaired under the retry settings
    rows = spark.createDataFrame([("s1", "ca", "bon dia a tots"), ("s1", "ca", "adéu"), ("s1", "es", "hola"), ("s2", None, "?"), ("s3", "ca", "a" * 10), ("s4", "ca", "a" * 7), ("s4", "ca", "a" * 14)], "sentence_id string, source_language string, text_source string")
    told = translate.repair_repetition(translate.sentences(rows, memory.none(spark), flows.Marking()), memory.none(spark), flows.Marking())
    got = sorted((r.sentence_id, r.text_source, r.text_es, r.translation_provenance, r.repetition_fallback_retry and r.repetition_fallback_retry.resolved) for r in told.collect())
    assert got == sorted([
        ("s1", "bon dia a tots", looping, "FRESH_OK", False), ("s1", "adéu", "» adéu", "FRESH_OK", None), ("s1", "hola", "hola", "SOURCE_ES", None), ("s2", "?", None, "FAILED", None),
        ("s3", "a" * 10, None, "FAILED", None), ("s4", "a" * 7, "» aaaaaaa", "REPETITION_REPAIRED", True), ("s4", "a" * 14, looping, "FRESH_OK", False),
    ])


def test_differing_keys(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "sentence_id string")
    for left, right in ((keys("a", "a", "b"), keys("b", "c", "d")), (keys("a"), keys("a", "a")), (keys(), keys()), (keys(None, "a"), keys(None, None, "b")), (keys("a"), keys())):
        assert report.differing(left, right, "sentence_id").first().n == report.sentence_ids(left, right).agg(F.sum("n")).first()[0]


def test_reviews_of_some_kinds(spark):
    done = process.process(flows._corpus(spark, DATA).limit(40), memory.none(spark), None, flows.Marking(), flows.ByLength(), settle=lambda t, n: settled(t, n)[0])
    every = {tuple(r) for r in report.review_ids(done.responses, done.sentences).collect()}
    for kinds in (("sentence_language",), ("language", "sentence_language"), ("length_ratio", "low_similarity")):
        some = report.review_ids(done.responses, done.sentences, kinds)
        assert {tuple(r) for r in some.collect()} == {r for r in every if r[0] in kinds}
    with pytest.raises(ValueError):
        report.review_ids(done.responses, done.sentences, ("none",))


def test_checks_work_each_measure_once(spark):
    from quern.functions import quality as Q

    row = spark.createDataFrame([("a", "b")], "s string, t string")
    plan = row.select(Q.degenerate(F.col("s"), F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 1  # runs of words are counted in one place
