"""Sentences: splitting, ellipsis repair, packing into chunks, and the frozen segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X

#: After a sentence mark and any closing quotes, where white space follows.
_BOUNDARY = r"""(?<=[.!?…])(?=\s)|(?<=[.!?…]["'’”)])(?=\s)|\n+"""


def split_sentences(c: Column) -> Column:
    """Sentences of a text by punctuation and line ends; blank text has none. A model's segmenter may replace this."""
    return F.filter(F.transform(F.split(c, _BOUNDARY), X.strip), lambda s: s != "")


def pack_words(c: Column, most: int = S.SENTENCE_CHARS) -> Column:
    """Words packed greedily into stretches of at most ``most`` characters; a longer word stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, w: Column) -> Column:
        full = (acc["size"] + F.length(w) > most) & (acc["size"] > 0)
        out = F.when(full, F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])
        now = F.when(full | (acc["size"] == 0), w).otherwise(F.concat(acc["now"], F.lit(" "), w))
        return F.struct(out.alias("out"), now.alias("now"), (F.when(full, 0).otherwise(acc["size"]) + F.length(w) + 1).alias("size"))

    end = lambda acc: F.when(acc["size"] > 0, F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])
    return F.aggregate(X.words(c), start, step, end)


def split_or_pack(c: Column, most: int = S.SENTENCE_CHARS) -> Column:
    """Sentences, unless there is none, or one that is too long: then packed words."""
    poor = lambda found: (F.size(found) == 0) | ((F.size(found) == 1) & (F.length(F.get(found, F.lit(0))) > most))
    return X.let(split_sentences(c), lambda found: F.when(poor(found), pack_words(c, most)).otherwise(found))


def chunks(sentences: Column, most: int = S.CHUNK_WORDS) -> Column:
    """(chunks, hard_splits): sentences packed greedily up to ``most`` words; a longer sentence is cut every ``most`` words."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("now"), F.lit(0).alias("n"), F.lit(0).alias("hard"))

    def step(acc: Column, s: Column) -> Column:
        return X.let(F.struct(X.words(s).alias("w"), s.alias("s")), lambda x: take(acc, x["w"], x["s"]))

    def take(acc: Column, w: Column, s: Column) -> Column:
        n = F.size(w)
        flushed = F.when(F.size(acc["now"]) > 0, F.array_append(acc["out"], F.array_join(acc["now"], " "))).otherwise(acc["out"])
        cuts = F.transform(F.sequence(F.lit(0), F.ceil(n / most).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))
        hard = F.struct(F.concat(flushed, cuts).alias("out"), empty.alias("now"), F.lit(0).alias("n"), (acc["hard"] + F.size(cuts)).alias("hard"))
        fresh = F.struct(flushed.alias("out"), F.array(s).alias("now"), n.alias("n"), acc["hard"].alias("hard"))
        more = F.struct(acc["out"].alias("out"), F.array_append(acc["now"], s).alias("now"), (acc["n"] + n).alias("n"), acc["hard"].alias("hard"))
        full = (acc["n"] + n > most) & (F.size(acc["now"]) > 0)
        return F.when(n > most, hard).when(full, fresh).otherwise(more)

    def end(acc: Column) -> Column:
        out = F.when(F.size(acc["now"]) > 0, F.array_append(acc["out"], F.array_join(acc["now"], " "))).otherwise(acc["out"])
        return F.struct(out.alias("chunks"), acc["hard"].alias("hard_splits"))

    tidy = F.filter(F.transform(sentences, X.strip), lambda s: s != "")
    return F.aggregate(tidy, start, step, end)


def within_tokens(parts: Column, count_tokens, limit: int = S.CHUNK_TOKENS) -> Column:
    """Parts halved by words until each has at most ``limit`` tokens by ``count_tokens``; one word is never cut.

    A part of n words needs at most log2(n), rounded up, halvings, and parts that fit need none.
    """

    def halve(part: Column) -> Column:
        half = lambda w: F.floor(F.size(w) / 2).cast("int")
        cut = lambda w: F.when((count_tokens(part) > limit) & (F.size(w) > 1), F.array(F.array_join(F.slice(w, F.lit(1), half(w)), " "), F.array_join(F.slice(w, half(w) + 1, F.size(w)), " "))).otherwise(F.array(part))
        return X.let(X.words(part), cut)

    words = F.coalesce(F.array_max(F.transform(F.filter(parts, lambda p: count_tokens(p) > limit), lambda p: F.size(X.words(p)))), F.lit(1))
    rounds = F.ceil(F.log2(F.greatest(words, F.lit(1)))).cast("int")
    each = F.filter(F.sequence(F.lit(0), rounds), lambda r: r > 0)
    return F.aggregate(each, parts, lambda now, _: F.flatten(F.transform(now, halve)))


def explode_sentences(responses: DataFrame, sentences: Column) -> DataFrame:
    """``responses`` with a row per sentence: sentence_index from 0 and text_source."""
    return responses.select("*", F.posexplode(sentences).alias("sentence_index", "text_source"))


def merge_continuations(sentences: DataFrame, by: tuple[str, ...] = ("response_id",), index: str = "sentence_index", text: str = "text_source") -> DataFrame:
    """Sentences that trail off join with the ones that go on from them: gaps and islands within a response.

    Gives ``by``, a new index from 0, the merged text and ``fragments``, the texts that it was made of.
    """
    order = W.partitionBy(*by).orderBy(index)
    joins = F.coalesce(X.ends_in_ellipsis(F.lag(text).over(order)) & X.continues(F.col(text)), F.lit(False))
    islands = sentences.withColumn("_joins", joins).withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = islands.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("_parts"))
    last = F.size("_parts") - 1

    def fragment(p: Column, k: Column) -> Column:
        head = F.when(k < last, X.drop_trailing_ellipsis(p["t"])).otherwise(p["t"])
        return F.when(k > 0, X.drop_leading_marks(head)).otherwise(head)

    merged = F.when(last > 0, X.strip(F.array_join(F.transform("_parts", fragment), " "))).otherwise(F.get("_parts", F.lit(0))["t"])
    return parts.select(*by, (F.col("_island") - 1).cast("int").alias(index), merged.alias(text), F.transform("_parts", lambda p: p["t"]).alias("fragments"))


def numbered(responses: DataFrame, sentences: Column | None = None) -> DataFrame:
    """(response_id, sentence_id, sentence_index, text_source) of every response, repaired; a text that no splitter cuts is one sentence."""
    found = sentences if sentences is not None else split_sentences(F.col("original_text"))
    found = F.when(F.size(found) > 0, found).otherwise(F.array("original_text"))
    merged = merge_continuations(explode_sentences(responses.select("response_id", "original_text"), found))
    return merged.withColumn("sentence_id", X.sentence_id(F.col("response_id"), F.col("sentence_index")))


def reconstruction_problems(responses: DataFrame, sentences: DataFrame) -> DataFrame:
    """Responses whose sentences, in order, don't have the response's words and numbers."""
    whole = sentences.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "text_source"))), lambda s: s["text_source"]), " ").alias("_joined"))
    both = responses.join(whole, "response_id")
    return both.where(X.lexical_tokens(F.col("original_text")) != X.lexical_tokens(F.col("_joined"))).select("response_id")


def freeze(responses: DataFrame, sentences: DataFrame) -> DataFrame:
    """The frozen segmentation: a row per sentence with its response's language and text."""
    own = responses.select("response_id", "source_language", "original_text")
    return own.join(sentences.select("response_id", "sentence_id", "sentence_index", "text_source"), "response_id", "left")


def manifest(frozen: DataFrame, input_sha256: str, version: int = 2) -> DataFrame:
    return frozen.agg(F.lit(version).alias("schema_version"), F.lit(input_sha256).alias("input_sha256"), F.count_distinct("response_id").alias("response_count"), F.count("sentence_id").alias("total_sentence_count"))


def frozen_problems(frozen: DataFrame, header: DataFrame, responses: DataFrame, input_sha256: str, version: int = 2) -> DataFrame:
    """(kind, detail): everything that keeps a frozen segmentation from being used with ``responses``."""
    facts = frozen.agg(F.count_distinct("response_id").alias("_r"), F.count("sentence_id").alias("_s")).crossJoin(header)  # two one-row tables
    tell = lambda kind, wrong, detail: facts.where(wrong).select(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    kept = frozen.select("response_id", F.col("original_text").alias("_frozen")).distinct()
    missing = responses.join(kept, "response_id", "left_anti").select(F.lit("missing_response").alias("kind"), F.col("response_id").alias("detail"))
    extra = kept.join(responses, "response_id", "left_anti").select(F.lit("extra_response").alias("kind"), F.col("response_id").alias("detail"))
    changed = responses.join(kept, "response_id").where(~F.col("original_text").eqNullSafe(F.col("_frozen"))).select(F.lit("changed_text").alias("kind"), F.col("response_id").alias("detail"))
    repeated = frozen.where("sentence_id is not null").groupBy("sentence_id").count().where("count > 1").select(F.lit("repeated_sentence_id").alias("kind"), F.col("sentence_id").alias("detail"))
    checks = [
        tell("schema_version", F.col("schema_version") != version, F.col("schema_version")),
        tell("input_sha256", F.col("input_sha256") != input_sha256, F.col("input_sha256")),
        tell("response_count", F.col("response_count") != F.col("_r"), F.col("_r")),
        tell("total_sentence_count", F.col("total_sentence_count") != F.col("_s"), F.col("_s")),
        missing, extra, changed, repeated,
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
