"""The translation memory: a versioned, keyed table that grows by appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X

KEYS = ["model", "generation_version", "source_language", "target_language", "source_hash"]


def none(spark: SparkSession) -> DataFrame:
    """A memory without a row, which a plan knows to be empty."""
    return spark.createDataFrame([], S.MEMORY).where(F.lit(False))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The memory at ``path``; none yet: no row. Of rows with one key the newest counts."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return none(spark)
    rows = spark.read.schema(S.MEMORY).parquet(path)
    values = [c for c in rows.columns if c not in KEYS]
    newest = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "created_at").alias("_v"))
    return newest.select(*KEYS, *(F.col(f"_v.{c}").alias(c) for c in values)).select(*rows.columns)


def keyed(texts: DataFrame, text: str, source: Column, model: str, version: str, target: str = S.TARGET_LANGUAGE) -> DataFrame:
    """``texts`` with the memory's key columns."""
    return texts.withColumns({"model": F.lit(model), "generation_version": F.lit(version), "source_language": source, "target_language": F.lit(target), "source_hash": X.digest(F.col(text))})


def look_up(keyed_texts: DataFrame, memory: DataFrame) -> DataFrame:
    """``keyed_texts`` with translated_text and hit."""
    known = memory.select(*KEYS, "translated_text", F.lit(True).alias("hit"))
    return keyed_texts.join(known, KEYS, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(keyed_texts: DataFrame, memory: DataFrame) -> DataFrame:
    """The texts to translate, each key once."""
    return keyed_texts.join(memory.select(*KEYS), KEYS, "left_anti").dropDuplicates(KEYS)


def append(rows: DataFrame, path: str) -> None:
    """Usable translations only; Spark's commit makes the new files appear at once or not at all."""
    rows.where(~X.is_blank(F.col("translated_text"))).write.mode("append").parquet(path)


def coverage(units: DataFrame, memory: DataFrame, unit: str = "sentence_id", most: int = 50) -> DataFrame:
    """(total, hits, misses, coverage, first_missing): of units, not of distinct keys."""
    found = look_up(units, memory)
    return found.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.try_divide(F.count_if("hit"), F.count(F.lit(1))).alias("coverage"),
    ).crossJoin(found.where("not hit").select(unit).distinct().orderBy(unit).limit(most).agg(F.array_sort(F.collect_list(unit)).alias("first_missing")))


def require_warm(units: DataFrame, memory: DataFrame) -> None:
    """Stop unless every unit is in the memory."""
    if n := coverage(units, memory).first()["misses"]:
        raise ValueError(f"{n} texts are not in the translation memory")


def statistics(found: DataFrame, memory: DataFrame) -> DataFrame:
    """hits, misses, writes (the distinct new translations) and entries."""
    new = F.count_distinct(F.when(F.col("fresh"), F.struct(*KEYS)))
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), new.alias("writes")).crossJoin(memory.agg(F.count(F.lit(1)).alias("entries")))  # two one-row tables


def batches(rows: DataFrame, size: int, order: str, *by: str) -> DataFrame:
    """``rows`` with batch, their number in stretches of ``size`` in order, within each of ``by``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size))


def progress(done: DataFrame, order: str, *by: str) -> DataFrame:
    """``done`` with finished and total: how many of each of ``by`` were done up to each row."""
    part = Window.partitionBy(*by)
    return done.withColumns({"finished": F.count(F.lit(1)).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), "total": F.count(F.lit(1)).over(part)})
