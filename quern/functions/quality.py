"""Quality diagnostics of a (source, target) pair of texts, as struct columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X


def lengths(source: Column, target: Column) -> Column:
    """Characters and words of both sides, and their ratios; a zero denominator gives null and no outlier."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    count = lambda c: F.when(c.isNull(), 0).otherwise(X.word_count(c))
    seen = F.struct(size(source).alias("s"), size(target).alias("t"), count(source).alias("sw"), count(target).alias("tw"))

    def told(x: Column) -> Column:
        ratio = F.try_divide(x["t"], x["s"])
        outlier = F.coalesce((ratio < S.RATIO_LOW) | (ratio > S.RATIO_HIGH), F.lit(False))
        return F.struct(
            x["s"].alias("source_chars"), x["t"].alias("target_chars"), x["sw"].alias("source_tokens"), x["tw"].alias("target_tokens"),
            ratio.alias("char_ratio"), F.try_divide(x["tw"], x["sw"]).alias("token_ratio"), outlier.alias("length_ratio_outlier"),
        )

    return X.let(seen, told)


def runs(c: Column, n: int = S.REPEAT_SIZE) -> Column:
    """Every run of n words, in order."""
    none = F.array().cast("array<string>")
    return X.let(X.words(c), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(none))


def worst_run(c: Column, n: int = S.REPEAT_SIZE, least: int = S.REPEAT_LEAST) -> Column:
    """(ngram, count) of the most frequent run of n words, the earliest on a tie; null unless it recurs ``least`` times.

    Sorted runs put equal ones side by side, so one pass over them counts: no square of the text's length. A text with
    fewer repeats in all than ``least`` asks of one run is not sorted.
    """
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit("").alias("r"))
    start = F.struct(F.lit("").alias("r"), F.lit(0).alias("n"), F.lit(0).alias("i"), none.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        same = (acc["r"] == x["r"]) & (acc["n"] > 0)
        count = F.when(same, acc["n"] + 1).otherwise(1)
        first = F.when(same, acc["i"]).otherwise(x["i"])
        now = F.struct(count.alias("n"), (-first).alias("i"), x["r"].alias("r"))
        return F.struct(x["r"].alias("r"), count.alias("n"), first.alias("i"), F.greatest(acc["best"], now).alias("best"))

    told = lambda best: F.when(best["n"] >= least, F.struct(best["r"].alias("ngram"), best["n"].alias("count")))
    numbered = lambda r: F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("r"), i.alias("i"))))
    repeats = lambda r: F.size(r) - F.size(F.array_distinct(r))
    worst = lambda r: F.when(repeats(r) >= least - 1, X.let(F.aggregate(numbered(r), start, step)["best"], told))
    return F.when(X.word_count(c) >= n * least, X.let(runs(c, n), worst))


def degenerate(source: Column, target: Column) -> Column:
    """Empty, unchanged though long, or repeating itself."""
    seen = F.struct(X.strip(target).alias("t"), X.strip(source).alias("s"), worst_run(target).alias("detail"))  # a blank text has no run

    def told(x: Column, empty: Column, same: Column, fatal: Column) -> Column:
        return F.struct(
            empty.alias("is_empty"), F.coalesce(same, F.lit(False)).alias("is_identical_to_source"), fatal.alias("is_identical_to_source_fatal"),
            x["detail"].isNotNull().alias("repetition_flag"), x["detail"].alias("repetition_detail"), (empty | fatal | x["detail"].isNotNull()).alias("flagged"),
        )

    def judged(x: Column) -> Column:
        empty = F.coalesce(F.length(x["t"]) == 0, F.lit(True))
        same = ~empty & (x["t"] == x["s"])
        return X.let(F.coalesce(same & X.long_enough(x["t"]), F.lit(False)), lambda fatal: told(x, empty, same, fatal))

    return X.let(seen, judged)


def language_check(text: Column, detected: Column, confidence: Column, expected: str = S.TARGET_LANGUAGE) -> Column:
    """passed is true, false or, for texts too short to tell, null: compare it with ``<=>``."""
    assessed = F.coalesce(X.long_enough(text), F.lit(False))
    seen = F.when(assessed, F.struct(detected.alias("lang"), confidence.alias("confidence")))
    return X.let(seen, lambda x: F.struct(
        x["lang"].alias("detected_language"), x["confidence"].alias("confidence"),
        F.when(x.isNotNull(), F.coalesce(x["lang"] == expected, F.lit(False))).alias("passed"), F.when(x.isNotNull(), "ASSESSED").otherwise("NOT_ASSESSED_SHORT_TEXT").alias("status"),
    ))


def distribution(df: DataFrame, value: str, *by: str, bound: float = S.SIMILARITY_BOUND) -> DataFrame:
    """count, mean, median, stdev (0 for one value), p05, p25, min and the count below ``bound``; nulls don't count."""
    v = F.col(value).cast("double")
    n = F.count(v)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stdev"),
        F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.25)).alias("p25"), F.min(v).alias("min"), F.count_if(v < bound).alias("n_below"),
    )
