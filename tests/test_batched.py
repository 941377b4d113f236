"""The batched model boundary: batches, retries, limits, a result a row, the stop, and progress."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import batched, segments


class Model:
    """Upper-cases; a call is a line in ``log``. ``broken`` texts fail their batch, ``shy`` ones its first try only."""

    token_limit = 6

    def __init__(self, log: Path, batch_size: int = 4, broken: str = "BROKEN", wait: float = 0) -> None:
        self.log, self.batch_size, self.broken, self.wait, self.tried = str(log), batch_size, broken, wait, set()

    def count_tokens(self, text: str, source: str) -> int:
        return sum(1 + len(w) // 8 for w in text.split())

    def translate_batch(self, texts, source, target):
        with open(self.log, "a") as f:
            f.write(f"{source} {len(texts)} {max(self.count_tokens(t, source) for t in texts)}\n")
        time.sleep(self.wait)
        if any(self.broken in t for t in texts):
            raise RuntimeError("out of memory")
        if any("shy" in t for t in texts) and tuple(texts) not in self.tried:
            self.tried.add(tuple(texts))
            raise RuntimeError("once")
        return [None if "mute" in t else f"{t.upper()}" for t in texts]


def calls(log: Path) -> list[list[str]]:
    return [line.split() for line in log.read_text().splitlines()] if log.exists() else []


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, ["ca", "en"][i % 2]) for i, t in enumerate(texts)], "sentence_id long, text_source string, source_language string")


def test_rows_do_not_depend_on_the_batch_size(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["granja", "vaca", "shy", "mute", "llet", "extraordinàriament"]) for _ in range(rng.randint(1, 40))) for _ in range(120)] + [None, "", "  ", "x" * 60, "ok " + "y" * 90]
    found = []
    for size in (2, 8):
        log = tmp_path / f"calls{size}"
        told = batched.translate(corpus(spark, texts), Model(log, size))
        assert told.columns == ["sentence_id", "text_source", "source_language", "translated_text", "model_status", "batch", "attempts"]
        found.append({r.sentence_id: (r.translated_text, r.model_status) for r in told.collect()})
        made = calls(log)
        assert made and all(int(n) <= size and int(tokens) <= 6 for _, n, tokens in made)
    assert found[0] == found[1]
    for i, t in enumerate(texts):
        want = ("FAILED" if "mute" in (t or "mute") or not t.strip() else "OVERSIZED") if t is None or "mute" in t or not t.strip() or len(max(t.split(), key=len)) > 40 else "TRANSLATED"
        assert found[0][i] == (" ".join(t.upper().split()) if want == "TRANSLATED" else None, want)


def test_a_failed_batch_fails_its_rows_only(spark, tmp_path):
    told = batched.translate(corpus(spark, ["BROKEN"] + ["fine"] * 9).withColumn("source_language", F.lit("ca")), Model(tmp_path / "calls", 1), lane=F.lit(0)).collect()
    assert {(r.sentence_id, r.model_status, r.attempts) for r in told} == {(0, "FAILED", 2)} | {(i, "TRANSLATED", 1) for i in range(1, 10)}


def test_three_failed_batches_stop_the_run(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("sentence_id"), F.concat(F.lit("BROKEN "), F.col("id").cast("string")).alias("text_source"), F.lit("ca").alias("source_language"))
    marked = batched.translate(rows, Model(tmp_path / "one", 5), lane=F.lit(0), stop=False)
    assert {(r.model_status, r["count"]) for r in marked.groupBy("model_status").count().collect()} == {("FAILED", 15), ("ABORTED", 385)}
    assert len(calls(tmp_path / "one")) == 6  # three batches, each tried twice, and none after
    with pytest.raises(batched.SystemicFailure):
        batched.translate(rows, Model(tmp_path / "all", 5))
    # lanes of one broken and many slow working tasks: the driver cancels the others
    mixed = rows.withColumn("text_source", F.when(F.col("sentence_id") < 20, F.col("text_source")).otherwise(F.concat(F.lit("slow "), F.col("sentence_id").cast("string"))))
    with pytest.raises(batched.SystemicFailure):
        batched.translate(mixed, Model(tmp_path / "mixed", 1, wait=0.2), lane=F.when(F.col("sentence_id") < 20, 0).otherwise(F.col("sentence_id") % 7 + 1))
    time.sleep(4)  # Spark gives a cancelled task's Python worker two seconds
    soon = len(calls(tmp_path / "mixed"))
    time.sleep(1)
    assert soon < 200 and len(calls(tmp_path / "mixed")) == soon  # of 380 calls and more


def test_a_success_ends_the_streak(spark, tmp_path):
    texts = ["BROKEN aa", "BROKEN bb", "fine cc dd ee", "BROKEN fff ggg hhh", "BROKEN iiii jjjj kkk"]
    rows = spark.createDataFrame([(i, t, "ca") for i, t in enumerate(sorted(texts, key=len))], "sentence_id long, text_source string, source_language string")
    assert {r.model_status for r in batched.translate(rows, Model(tmp_path / "calls", 1), lane=F.lit(0)).collect()} == {"FAILED", "TRANSLATED"}


def test_progress_is_told(spark, tmp_path):
    seen = []
    batched.translate(corpus(spark, ["fine", "mute"] * 50), Model(tmp_path / "calls", 4, wait=0.05), progress=lambda done, failed: seen.append((done, failed)))
    assert seen == sorted(seen) and seen[-1] == (100, 50)


def test_no_rows_no_calls(spark, tmp_path):
    assert batched.translate(corpus(spark, ["x"]).where("false"), Model(tmp_path / "calls")).count() == 0 and not calls(tmp_path / "calls")


@pytest.mark.parametrize("limit", [1, 2, 7, 5000])
def test_within_tokens_fits_whatever_the_length(spark, limit):
    text = " ".join(f"w{i}" for i in range(3000))
    rows = spark.createDataFrame([([text, "a b c"],), ([],), (["one"],)], "parts array<string>")
    got = rows.select(segments.within_tokens(F.col("parts"), lambda p: F.size(F.split(p, " ")), limit).alias("p")).collect()
    assert all(len(p.split()) <= limit for r in got for p in r.p) and " ".join(got[0].p) == f"{text} a b c" and got[1].p == [] and got[2].p == ["one"]
    assert got[0].p == [x for p in (text, "a b c") for x in batched.fitting(p, lambda t: len(t.split()), limit)]


def test_trained_languages(spark):
    from quern.operators import language, ngrams

    cat, spa = "tenim una granja petita i les vaques pasturen als camps cada dia amb els gossos", "tenemos una granja pequeña y las vacas pastan en los campos cada día con los perros"
    known = spark.createDataFrame([(cat, "ca"), (spa, "es"), ("what", None)], "text string, lang string")
    detector = ngrams.TrainedDetector(known)
    rows = spark.createDataFrame([(1, f"{cat} i vaques"), (2, f"y {spa} vacas"), (3, "curt"), (4, None)], "id long, original_text string")
    told = {r.id: r.detected_lang for r in language.detected(rows, detector).collect()}
    assert told == {1: "ca", 2: "es", 3: None, 4: None}
    plain = {r.id: (r.detected_lang, r.detected_confidence) for r in ngrams.detect(spark.createDataFrame([(1, "123 !"), (2, None), (2, ""), (3, "els gossos")], "id long, text string"), detector.model).collect()}
    assert plain[1] == plain[2] == (None, 0.0) and plain[3][0] == "ca"
    nothing = ngrams.trained(known.where("false"))
    assert ngrams.detect(known, nothing).where("detected_lang is null").count() == 3


class Translating(Model):
    """A batched model for the whole flow; ``hard`` texts come out only under the retry settings."""

    name, engine, engine_version = "batched", "test", "1"
    token_limit = 1000

    def __init__(self, log: Path, patient: bool = False) -> None:
        super().__init__(log, 3)
        self.patient = patient

    def for_retry(self):
        return Translating(Path(self.log), True)

    def translate_batch(self, texts, source, target):
        return [None if "HARD" in (t or "") and not self.patient else t for t in super().translate_batch(texts, source, target)]


def test_the_flow_takes_a_batched_model(spark, tmp_path):
    from quern import schemas as S
    from quern.operators import translate

    rows = spark.createDataFrame([(1, "ca", "bon dia"), (2, "ca", "bon dia"), (3, "es", "buenos días"), (4, "ca", "hard un"), (5, "ca", "mute dos")], "sentence_id long, source_language string, text_source string")
    model = Translating(tmp_path / "calls")
    done = translate.sentences(rows, spark.createDataFrame([], S.MEMORY), model)
    told = {r.sentence_id: (r.text_es, r.translation_provenance) for r in done.collect()}
    assert told == {1: ("BON DIA", "FRESH_OK"), 2: ("BON DIA", "FRESH_OK"), 3: ("buenos días", "SOURCE_ES"), 4: ("HARD UN", "RETRY_OK"), 5: (None, "FAILED")}
    known = translate.memory_rows(done.where("made is not null").select("made.*"), model)
    again = translate.translate(rows.where("sentence_id < 3"), known, model).collect()
    assert [(r.hit, r.translated_text) for r in again] == [(True, "BON DIA")] * 2
