"""Helpers that the training-data operators share.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every
executor sees, so a lost executor never takes the only copy of anything.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it: once per session, as a zip file."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    found = any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if getattr(sc, "_quern_shipped", False) or (found and sc.master.startswith("local")):  # workers of this machine inherit the path
        return
    path = Path(tempfile.mkdtemp()) / "quern.zip"  # the driver serves this file to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "quern").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._quern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is set, a local one serves a session of this machine; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder. Every operator asks for one or reads a table first, so the package is shipped here."""
    ship(spark)
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run of an operator, in a folder of their own that goes when the run is done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.made = spark, fresh_path(spark, name), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        self.made += 1
        return materialize(df, name, f"{self.folder}/{self.made:03d}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        remove(self.spark, self.folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo n: the split into training and held-out rows."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """At most ``rows`` rows, the ones with the smallest hash of ``key``; every row if there are fewer.

    A first pass keeps a hash range that holds the bound with a wide margin, so
    the ordered limit never sees more than a few times ``rows``.
    """
    n = df.count()
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    if n > 4 * rows:
        top = int((2.0 * rows / n) * 2**63)
        df = df.where(F.pmod(h, F.lit(2**63 - 1)) < top)
    return df.orderBy(h, key).limit(rows)
