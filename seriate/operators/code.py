"""Sending this package's code to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def package() -> str:
    """This package's code as a zip file on the driver."""
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="seriate-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    name = Path(package()).name
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(package())


@lru_cache(maxsize=1)
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="seriate-scratch-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path, as Python opens it, in the folder that driver and executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or _own_scratch()).removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt for costly work on each: adaptive execution would put them into few tasks for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
