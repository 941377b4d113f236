"""Text and quality functions at their boundaries."""

import pytest
from pyspark.sql import functions as F

from quern.functions import quality as Q
from quern.functions import text as X
from quern.operators import segments


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "function,given,want",
    [
        (X.clean, "[00:00:01.000 --> 00:00:05.000] Hola, 2009 món! col·laboració", "Hola, món! col laboració"),
        (X.clean_keeping_marks, "l'Anna col·laboració 12 -sí", "l'Anna col·laboració -sí"),
        (X.drop_stamps, "[00:00:01.000 --> 00:00:05.000]   Sí", "Sí"),
        (X.topic_text, "l'any 2009, 7 bé", "lany 2009 bé"),
        (X.normal_sentence, " --Sí, és  així. ", "sí és  així"),
        (X.normal_term, " Gran Granja ", "gran_granja"),
        (X.drop_punctuation, "¿Qué? (sí)!", "Qué sí"),
        (X.drop_lone_punctuation, "a . 12 b -", "a b"),
        (X.bare_word, "...Hola!?", "hola"),
    ],
)
def test_strings(spark, function, given, want):
    assert value(spark, function(F.col("t")), t=given) == want


def test_words_of_blank_and_null(spark):
    rows = spark.createDataFrame([("",), (" \t\n",), (None,), ("a  b",)], "t string")
    assert [r[0] for r in rows.select(X.words(F.col("t"))).collect()] == [[], [], None, ["a", "b"]]
    assert [r[0] for r in rows.select(X.is_blank(F.col("t"))).collect()] == [True, True, True, False]


def test_long_enough_needs_both(spark):
    exact = "aaaaaa bbbbbb cccccc dddddd eeeeee ffffff gggggg h"
    assert len(exact) == 50
    assert value(spark, X.long_enough(F.col("t")), t=exact) is True
    assert value(spark, X.long_enough(F.col("t")), t=exact[:-1] + "") is False
    assert value(spark, X.long_enough(F.col("t")), t="a" * 60) is False


def test_sentence_ids_pad_but_do_not_cut(spark):
    rows = spark.createDataFrame([("r", 7), ("r", 1234)], "r string, i int")
    assert [x[0] for x in rows.select(X.sentence_id(F.col("r"), F.col("i"))).collect()] == ["r::s007", "r::s1234"]


def test_topic_tokens(spark):
    assert value(spark, X.topic_tokens(F.col("t")), t="El niño a1b és x gran_casa 22") == ["el", "niño", "és", "gran_casa"]
    assert value(spark, X.with_bigrams(X.topic_tokens(F.col("t"))), t="uno dos tres") == ["uno", "uno_dos", "dos", "dos_tres", "tres"]
    assert value(spark, X.bigrams(X.words(F.col("t"))), t="uno") == []


def test_question_order(spark):
    rows = spark.createDataFrame([("2.10",), ("2.9",), ("1.3a",), ("10",)], "q string")
    assert [r[0] for r in rows.orderBy(X.question_parts(F.col("q")), "q").collect()] == ["1.3a", "2.9", "2.10", "10"]


@pytest.mark.parametrize("times,flagged", [(5, False), (6, True)])
def test_repetition_boundary(spark, times, flagged):
    text = " ".join(["uno dos tres"] * times)
    got = value(spark, Q.degenerate(F.lit("x"), F.col("t")), t=text)
    assert got["repetition_flag"] is flagged
    if flagged:
        assert got["repetition_detail"]["count"] == 6 and got["repetition_detail"]["ngram"] == "uno dos tres"


def test_lengths(spark):
    got = value(spark, Q.lengths(F.col("a"), F.col("b")), a="", b="x")
    assert got["char_ratio"] is None and got["length_ratio_outlier"] is False
    assert value(spark, Q.lengths(F.col("a"), F.col("b")), a="x" * 10, b="y" * 4)["length_ratio_outlier"] is False
    assert value(spark, Q.lengths(F.col("a"), F.col("b")), a="x" * 10, b="y" * 3)["length_ratio_outlier"] is True


def test_identical_short_text_is_sound(spark):
    assert value(spark, Q.degenerate(F.col("a"), F.col("b")), a="Sí.", b="Sí.")["flagged"] is False
    long = "una frase que es prou llarga perquè es pugui saber la llengua"
    assert value(spark, Q.degenerate(F.col("a"), F.col("b")), a=long, b=long)["is_identical_to_source_fatal"] is True
    assert value(spark, Q.degenerate(F.col("a"), F.col("b")), a="x", b=" ")["is_empty"] is True


def test_distribution_of_one_and_none(spark):
    one = Q.distribution(spark.createDataFrame([(0.4,)], "v double"), "v").first()
    assert (one["n"], one["stdev"], one["p05"], one["n_below"]) == (1, 0.0, 0.4, 1)
    none = Q.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert none["n"] == 0 and none["mean"] is None and none["stdev"] is None
    five = Q.distribution(spark.createDataFrame([(float(k),) for k in range(5)], "v double"), "v").first()
    assert (five["p05"], five["p25"]) == (0.2, 1.0)


def test_packing(spark):
    assert value(spark, segments.pack_words(F.col("t"), 10), t="aaaa bbbb cccc " + "d" * 12) == ["aaaa bbbb", "cccc", "d" * 12]
    got = value(spark, segments.chunks(F.array(F.col("a"), F.col("b"), F.col("c")), 3), a="1 2", b="3 4", c="5 6 7 8")
    assert got["chunks"] == ["1 2", "3 4", "5 6 7", "8"] and got["hard_splits"] == 2


def test_chain_of_three_fragments(spark):
    rows = spark.createDataFrame([("r", 0, "sensors..."), ("r", 1, "-...de camions..."), ("r", 2, "- enviat."), ("r", 3, "Nova.")], "response_id string, sentence_index int, text_source string")
    got = segments.merge_continuations(rows).orderBy("sentence_index").collect()
    assert [r["text_source"] for r in got] == ["sensors de camions enviat.", "Nova."]
