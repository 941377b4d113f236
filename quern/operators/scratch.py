"""Intermediate tables in the folder that the session shares with its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a local one serves a session of this machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or "/tmp/checkpoints").rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers of other machines import this package: once per session, as a zip file that the driver serves."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False) or sc.master.startswith("local["):  # workers of this process inherit its path
        return
    root, path = Path(__file__).resolve().parents[2], os.path.join(tempfile.mkdtemp(), "quern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "quern").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._quern_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str = "table", old: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written and read again, which cuts its lineage; and where. ``old`` goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if old:
        remove(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Tables of one run of an operator, in a folder of their own that goes when the run is done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``df`` written and read again."""
        self.made += 1
        path = f"{self.folder}/{self.made:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, condition: str, name: str = "table") -> tuple[DataFrame, int]:
        """The same, and how many rows meet ``condition``, counted as they are written."""
        seen = Observation()
        return self.table(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name), seen.get["n"]

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *failure) -> None:
        remove(self.spark, self.folder)
