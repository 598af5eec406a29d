"""Shared-folder tables, used to cut lineage and to survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and
    all runs on one machine, as in tests, a temporary folder is chosen and
    remembered; elsewhere executors would not see one another's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written by this process and not removed since.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or for files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "lz4") -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder; return it reread, and its path.

    Unlike ``checkpoint()`` this runs the plan a single time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read, to give its disk back."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def made() -> list[str]:
    """The tables written so far that still stand."""
    return list(_MADE)


def remove_since(spark: SparkSession, before: list[str], *keep: str) -> None:
    """Delete the tables written after ``before = made()``, once nothing reads them any more."""
    for path in made():
        if path not in before and path not in keep:
            remove(spark, path)


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; every read goes through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
