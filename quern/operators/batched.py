"""A model that takes batches: token-bounded pieces, retries, a result for each row, and a stop when batches keep failing.

Rows are dealt to lanes, and a lane's rows go to one task in order of length, so
that a batch holds texts of about one length. A text over the token limit is
halved at word ends until every piece fits; a single word over the limit is
refused without a call. Batches hold at most ``batch_size`` pieces of one lane
and language; the rows' results don't depend on that size, as long as the model
treats each text of a batch on its own. A batch that fails is tried once more;
then its rows have failed. After ``S.MOST_FAILED_BATCHES`` failed batches in a row a
lane makes no more calls, its other rows are ``ABORTED``, and the run is stopped:
its task makes no more calls for other lanes either and ends, saying so in an
accumulator, and the driver cancels what else is running.

Defined results: a null or blank text fails without a call; a blank answer
fails its row; rows keep their columns; repeated rows are translated each (the
memory sends every text once); no rows, no calls.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.operators.scratch import remove, shared_dir, ship

TRANSLATED, FAILED, OVERSIZED, ABORTED = "TRANSLATED", "FAILED", "OVERSIZED", "ABORTED"
RETRIES = 1
#: Lanes for each shuffle partition, unless the caller names a lane.
LANES = 4
WATCH_SECONDS = 0.2
_TOLD = "translated_text string, model_status string, batch int, attempts int"


class BatchModel(Protocol):
    """Sent to the tasks; heavy parts are loaded there, at first use."""

    batch_size: int
    token_limit: int

    def count_tokens(self, text: str, source: str) -> int: ...

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str | None]:
        """One answer for each text; raises if the batch as a whole fails."""


class SystemicFailure(RuntimeError):
    """Too many batches in a row failed."""


def fitting(text: str, count: Callable[[str], int], limit: int) -> list[str]:
    """Pieces of ``text`` of at most ``limit`` tokens, halved at word ends; a single word stays whole."""
    todo, out = [text], []
    while todo:
        piece = todo.pop()
        words = piece.split() if count(piece) > limit else []
        if len(words) > 1:
            todo += [" ".join(words[len(words) // 2 :]), " ".join(words[: len(words) // 2])]
        else:
            out.append(piece)
    return out


class _Lane:
    """Batches of one lane and language: rows wait until all their pieces are done, and leave in order."""

    def __init__(self, model: BatchModel, target: str, most_failed: int, final: bool) -> None:
        self.model, self.target, self.most_failed, self.final = model, target, most_failed, final
        self.key: tuple | None = None
        self.rows: dict[int, list[dict]] = {}
        self.pieces: list[tuple[dict, int, str]] = []
        self.streak = self.number = 0

    def start(self, key: tuple) -> None:
        # the streak goes on through the languages of a lane, and past it where it ends the run
        if self.key is None or key[0] != self.key[0]:
            self.streak, self.number = self.streak if self.final and self.stopped else 0, 0
        self.key = key

    @property
    def stopped(self) -> bool:
        return self.streak >= self.most_failed

    def add(self, of: int, text: str | None) -> None:
        """A row of Arrow batch number ``of``."""
        row = {"of": of, "parts": [], "status": TRANSLATED, "batch": None, "attempts": 0}
        self.rows[of].append(row)
        limit, count = self.model.token_limit, lambda t: self.model.count_tokens(t, self.key[1])
        pieces = fitting(text, count, limit) if text and text.strip() and not self.stopped else []
        if self.stopped:
            row["status"] = ABORTED
        elif not pieces:
            row["status"] = FAILED
        elif any(count(p) > limit for p in pieces):
            row["status"] = OVERSIZED
        else:
            row["parts"] = [None] * len(pieces)
            for k, p in enumerate(pieces):
                self.pieces.append((row, k, p))
                if len(self.pieces) >= self.model.batch_size:
                    self.run()

    def run(self) -> None:
        batch, self.pieces = self.pieces, []
        if not batch:
            return
        if self.stopped:
            for row, _, _ in batch:
                row["status"] = ABORTED
            return
        answers, tries = None, 0
        while answers is None and tries <= RETRIES:
            tries += 1
            try:
                answers = self.model.translate_batch([p for _, _, p in batch], self.key[1], self.target)
            except Exception:  # whatever a model raises fails its batch, never the task
                answers = None
        self.streak = 0 if answers is not None else self.streak + 1
        for (row, k, _), answer in zip(batch, answers or [None] * len(batch)):
            row["parts"][k] = answer
            row["batch"], row["attempts"] = self.number if row["batch"] is None else row["batch"], max(tries, row["attempts"])
            if not (answer or "").strip():
                row["status"] = FAILED
        self.number += 1

    def finished(self) -> list[tuple[int, list[tuple]]]:
        """The Arrow batches, by number, none of whose rows waits for a call."""
        first = self.pieces[0][0]["of"] if self.pieces else None
        out = [(of, rows) for of, rows in self.rows.items() if first is None or of < first]
        for of, _ in out:
            del self.rows[of]
        return [(of, [(" ".join(r["parts"]) if r["status"] == TRANSLATED else None, r["status"], r["batch"], r["attempts"]) for r in rows]) for of, rows in out]


def _run(model: BatchModel, target: str, most_failed: int, final: bool, text: str, counts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lane, (done, failed, broken), held = _Lane(model, target, most_failed, final), counts, {}

    def answered() -> Iterator[pa.RecordBatch]:
        for of, told in lane.finished():
            batch = held.pop(of)
            done.add(len(told))
            failed.add(sum(t[1] != TRANSLATED for t in told))
            own = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n not in ("_lane", "_language")]
            columns = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in own), *columns], [*(n for _, n in own), *(x.split()[0] for x in _TOLD.split(", "))])

    for of, batch in enumerate(batches):
        held[of] = batch
        lane.rows[of] = []
        for number, language, body in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_lane", "_language", text))):
            if lane.key != (number, language):
                lane.run()
                if lane.stopped and (lane.key or (None,))[0] != number:
                    broken.add(1)
                lane.start((number, language))
            lane.add(of, body)
        yield from answered()
    lane.run()
    yield from answered()
    if lane.stopped:
        broken.add(1)


def translate(
    rows: DataFrame, model: BatchModel, text: str = "text_source", language: str = "source_language", key: str = "sentence_id", lane: Column | None = None,
    target: str = S.TARGET_LANGUAGE, progress: Callable[[int, int], None] | None = None, stop: bool = True, most_failed: int = S.MOST_FAILED_BATCHES,
) -> DataFrame:
    """``rows`` with translated_text, model_status, batch (its number in the lane) and attempts, written to the shared folder.

    ``progress`` is told how many rows are done, and how many of these failed, whenever a task ends. A lane that stops
    ends the run with ``SystemicFailure``, unless ``stop`` is unset: then its rows come back as ``ABORTED``.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    ship(spark)
    rows = rows.drop(*(x.split()[0] for x in _TOLD.split(", ")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_lane", (F.pmod(F.xxhash64(text), F.lit(LANES * tasks)) if lane is None else lane).cast("long")).withColumn("_language", F.col(language))
    dealt = dealt.repartition(tasks, "_lane").sortWithinPartitions("_lane", "_language", F.length(text), key)
    counts = tuple(sc.accumulator(0) for _ in range(3))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), _TOLD])
    told = dealt.mapInArrow(partial(_run, model, target, most_failed, stop, text, counts), schema)
    path, tag = f"{shared_dir(spark)}/quern/batches-{uuid.uuid4().hex}", f"batches-{uuid.uuid4().hex}"
    over = threading.Event()

    def watch() -> None:
        seen = 0
        while not over.wait(WATCH_SECONDS):
            if progress and counts[0].value > seen:
                seen = counts[0].value
                progress(seen, counts[1].value)
            if stop and counts[2].value:
                sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    sc.addJobTag(tag)
    try:
        told.write.parquet(path)
    except Exception as failure:
        if stop and counts[2].value:
            remove(spark, path)
            raise SystemicFailure(f"{most_failed} batches in a row failed") from failure
        raise
    finally:
        sc.removeJobTag(tag)
        over.set()
        watcher.join()
    if stop and counts[2].value:
        remove(spark, path)
        raise SystemicFailure(f"{most_failed} batches in a row failed")
    if progress:
        progress(counts[0].value, counts[1].value)
    return spark.read.schema(schema).parquet(path)
