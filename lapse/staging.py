"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lapse.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lapse-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage (a lost executor costs one stage, not the whole
    iteration), gives the planner real sizes to choose joins by, and forgets
    how the rows were dealt out, so that a join deals both sides anew and
    adaptive execution can split a hot key."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._lapse_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lapse_path", None)
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
