"""File sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lapse.staging import staged

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver test table: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Holds the line that did not fit the schema.
BAD_LINE = "_bad_line"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, bad_lines: str = "fail") -> DataFrame:
    """CSV scan with a header row.  Pass an explicit schema at scale: schema
    inference reads the data twice.  Raw measures that may hold blanks
    should be declared as strings and parsed with ``try_cast`` (S3).

    ``bad_lines``: what becomes of lines with another number of fields than the
    schema, or with values that are not of its types: 'fail' raises an error,
    'null' keeps what can be read."""
    if bad_lines not in ("fail", "null"):
        raise ValueError("bad_lines must be 'fail' or 'null'; see read_csv_checked")
    mode = "FAILFAST" if bad_lines == "fail" else "PERMISSIVE"
    reader = spark.read.option("header", str(header).lower()).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    return reader.csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of one CSV scan: the lines that fit the schema,
    and (line) as they stand those that don't.  Every line but the headers and
    empty ones is in one of the two, which are read from one staged table."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_line = StructType([*schema.fields, StructField(BAD_LINE, StringType())])
    reader = spark.read.schema(with_line).option("header", str(header).lower()).option("mode", "PERMISSIVE")
    # Pruning would leave unread fields, and what is wrong with them, out.
    both = staged(reader.option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", "false").csv(path), "csv")
    bad = F.col(BAD_LINE).isNotNull()
    return both.where(~bad).drop(BAD_LINE), both.where(bad).select(F.col(BAD_LINE).alias("line"))


def read_any(spark: SparkSession, path: str, fmt: str | None = None,
             schema: StructType | str | None = None) -> DataFrame:
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    if fmt == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def write_ledger(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Export a (filtered, sorted) ledger.  CSV with a header, or JSON lines.
    Written in parallel, one file per partition; sort order holds within
    and across the part files of a range-partitioned sort."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported ledger format {fmt!r}")
