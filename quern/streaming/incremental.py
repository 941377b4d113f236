"""Incremental ingestion: new responses are translated as they arrive, into the same memory and tables as in batch.

The stream's checkpoint makes a run resumable; each micro-batch appends what it made, and a batch that is run again
finds its translations in the memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern import schemas as S
from quern.models import LanguageDetector, Translator
from quern.operators import memory, process, translate


@dataclass
class Places:
    """Where a stream keeps its tables."""

    memory: str
    responses: str
    sentences: str
    checkpoint: str


def read_responses(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of (interview_id, question_id, original_text)."""
    return spark.readStream.schema(S.RESPONSES_IN).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def ingest(rows: DataFrame, places: Places, translator: Translator | None = None, detector: LanguageDetector | None = None) -> StreamingQuery:
    """Process what there is and stop; call again, or on a schedule, for what comes later.

    An interview's language vote sees the responses of its own micro-batch, so an interview should arrive in one piece.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession

        def settle(table: DataFrame, name: str) -> DataFrame:
            path = f"{places.checkpoint}-{name}/run={number}"
            table.write.mode("overwrite").parquet(path)
            return spark.read.schema(table.schema).parquet(path)

        out = process.process(df, memory.load(spark, places.memory), translator=translator, detector=detector, settle=settle)
        memory.append(translate.memory_rows(out.translated, translator), places.memory)
        sent = {"batch": F.lit(number)}
        # a repeated batch replaces its own folder
        out.responses.withColumns(sent).write.mode("overwrite").parquet(f"{places.responses}/run={number}")
        out.sentences.withColumns(sent).write.mode("overwrite").parquet(f"{places.sentences}/run={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", places.checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(user_id, session, n) of a stream or table of events; an NTZ time is taken as session time before the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n) over tumbling windows, closed by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


_STREAK_OUT = "user_id long, streak int, aborts boolean"


def failure_streaks(events: DataFrame, most: int = S.MOST_FAILED_BATCHES) -> DataFrame:
    """(user_id, streak, aborts) after each micro-batch: failures in a row, kept per user across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("event_id")
        for failed in (rows["event_type"] == "error").tolist():
            run = run + 1 if failed else 0
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [run], "aborts": [run >= most]})

    return events.groupBy("user_id").applyInPandasWithState(step, _STREAK_OUT, "run int", "update", "NoTimeout")
