"""Exact nearest neighbours by blocks of a query set against all rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.scratch import shared_dir

#: Query vectors that are broadcast at a time.
BLOCK = 4096


def nearest(rows: DataFrame, key: str, vector: str, k: int = 5, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(key, neighbour, cosine, rank): the ``k`` rows with the largest cosine to each query, itself left out; ties by key.

    Queries (all rows, unless given) go out in blocks of ``block`` vectors, so what is broadcast has a fixed size;
    each task keeps ``k`` candidates for each query, and a window over those few picks the best. A block's result is
    written before the next block is read, so the driver never holds two. Null and zero vectors are nobody's neighbours.
    """
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/quern/nearest-{uuid.uuid4().hex}"
    asked = (rows if queries is None else queries).select(key, vector).where(F.col(vector).isNotNull())
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("neighbour", rows.schema[key].dataType), T.StructField("cosine", T.DoubleType())])

    def best(names: list, matrix: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top_s = np.full((len(names), k), -np.inf)
            top_k = np.full((len(names), k), None, object)
            for frame in batches:
                frame = frame[frame[vector].notna()]
                if frame.empty:
                    continue
                m = np.stack(frame[vector].to_numpy()).astype(float)
                size = np.linalg.norm(m, axis=1)
                frame, m = frame[size > 0], m[size > 0] / size[size > 0, None]
                own = frame[key].to_numpy()
                scores = np.round(matrix @ m.T, 12)
                scores[np.equal.outer(np.array(names, object), own.astype(object))] = -np.inf
                for i in range(len(names)):
                    s, o = np.r_[top_s[i], scores[i]], np.r_[top_k[i], own]
                    order = sorted(range(len(s)), key=lambda j: (-s[j], o[j] is None, o[j] if o[j] is not None else 0))[:k] if len(s) <= 64 else _few(s, o, k)
                    top_s[i], top_k[i] = s[order], o[order]
            found = [(names[i], top_k[i, j], top_s[i, j]) for i in range(len(names)) for j in range(k) if np.isfinite(top_s[i, j])]
            yield pd.DataFrame(found, columns=[key, "neighbour", "cosine"])

        return run

    held: list[tuple] = []

    def flush() -> None:
        nonlocal held
        m = np.array([v for _, v in held], float)
        size = np.linalg.norm(m, axis=1)
        keep = size > 0
        found = rows.select(key, vector).mapInPandas(best([n for (n, _), x in zip(held, keep) if x], m[keep] / size[keep, None]), schema)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cosine"), "neighbour")))
        ranked.where(F.col("rank") <= k).write.mode("append").parquet(path)
        held = []

    for r in asked.toLocalIterator(prefetchPartitions=False):
        held.append((r[0], r[1]))
        if len(held) >= block:
            flush()
    if held:
        flush()
    told = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    told.write.mode("append").parquet(path)
    return spark.read.schema(told.schema).parquet(path)


def _few(s: np.ndarray, o: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by name: the k-th score bounds what needs sorting."""
    bound = np.partition(s, len(s) - k)[len(s) - k]
    some = np.flatnonzero((s >= bound) & np.isfinite(s))
    some = sorted(some.tolist(), key=lambda j: (-s[j], o[j]))[:k]
    return np.array(some + np.flatnonzero(~np.isfinite(s)).tolist()[: k - len(some)], int)
