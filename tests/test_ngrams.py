"""Language profiles: n-grams as numbers, and no row for each n-gram of a text."""

from collections import Counter

import pyarrow as pa

from quern.operators import ngrams


def cut(text):
    """The n-grams of one plain text, as the definition has them."""
    t = f" {text.strip(' ')} " if text and text.strip(" ") else ""
    return Counter(t[i : i + n] for n in ngrams.SIZES for i in range(len(t) - n + 1) if t[i : i + n] != " ")


def test_codes_are_the_n_grams():
    texts = ["els gossos ", "", None, " ", "a", "語言 𐐨𐐩 ñu", "a a a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["ca", "ca", "es", "es", "es", "ca", "ca"]), pa.array(texts)], ["lang", "plain"])
    (counted,) = [pa.Table.from_batches(ngrams._spelt(ngrams._counted(iter([batch]))))]
    got = {(r["lang"], r["gram"]): r["n"] for r in counted.to_pylist()}
    want = Counter()
    for lang, t in zip(["ca", "ca", "es", "es", "es", "ca", "ca"], texts):
        want.update({(lang, g): n for g, n in cut(t).items()})
    assert got == want
    grams, of = ngrams.codes(texts)
    assert all(Counter(grams[of == k].tolist()) == {ngrams.code(g): n for g, n in cut(t).items()} for k, t in enumerate(texts))


def test_no_row_for_each_n_gram(spark):
    texts = spark.range(5_000).selectExpr("'tenim una granja petita i les vaques pasturen' as text", "if(id % 2 = 0, 'ca', 'es') as lang")
    batches = texts.coalesce(1).select("lang", ngrams.plain(texts["text"]).alias("plain")).mapInArrow(ngrams._counted, "lang string, code long, n long")
    assert batches.count() <= 3 * 2 * 130  # stretches, languages, distinct n-grams; there are 640,000 n-grams
    model = ngrams.trained(texts)
    told = ngrams.detect(texts, model)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert {(r.detected_lang, round(r.detected_confidence, 9)) for r in told.distinct().collect()} == {("ca", 0.5)}
