"""Cleaning (S2-S9) as one projection chain plus a counters aggregate.

Every step is a column expression: the whole chain fuses into one
whole-stage-codegen stage; only the final full-row dedupe shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from lapse.functions.text import strip_ws
from lapse.spec import Spec, require_columns


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip blanks, tabs and line ends from every string column (driven
    by the schema)."""
    return df.select(*[
        strip_ws(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def safe_numeric(df: DataFrame, column: str, to: str = "double") -> DataFrame:
    """S3: non-numeric or blank text becomes NULL (``try_cast``; a plain
    cast raises under ANSI mode), and so does a NaN."""
    value = F.col(column).try_cast(to)
    return df.withColumn(column, F.when(~F.isnan(value.cast("double")), value))


def nan_to_null(df: DataFrame) -> DataFrame:
    """A NaN in a floating column is a missing value."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def required_int(column: str):
    """Cast to int; a missing value is an error."""
    c = F.col(column)
    return F.when(c.isNull(), F.raise_error(F.lit(f"{column} is missing in a row that is kept"))).otherwise(c).cast("int")


@dataclass(frozen=True)
class CleanPlan:
    """What to clean.  ``measure`` is the raw text measure (TotalCharges),
    imputed to ``impute_value`` where ``tenure_col`` is 0 and then required;
    ``int_cols`` are cast to int (S6)."""
    measure: str
    tenure_col: str
    int_cols: tuple[str, ...] = ()
    impute_value: float = 0.0


def _steps(raw: DataFrame, spec: Spec, plan: CleanPlan) -> DataFrame:
    require_columns(raw, [plan.measure, plan.tenure_col, spec.target_col, *plan.int_cols])
    df = nan_to_null(trim_strings(raw))
    df = safe_numeric(df, plan.measure)
    impute = (F.col(plan.tenure_col) == 0) & F.col(plan.measure).isNull()
    return df.withColumn("_imputed", impute).withColumn(
        plan.measure, F.when(impute, F.lit(plan.impute_value)).otherwise(F.col(plan.measure))
    )


def clean(raw: DataFrame, spec: Spec, plan: CleanPlan) -> DataFrame:
    """S2-S8 in the reference's order: trim, safe cast, conditional impute,
    drop rows still missing the measure, int casts, binary label, full-row
    dedupe (null-safe: two missing values are equal).  A missing value in an
    ``int_cols`` column of a row that is kept is an error."""
    df = _steps(raw, spec, plan).drop("_imputed")
    df = df.where(F.col(plan.measure).isNotNull())
    for c in plan.int_cols:
        df = df.withColumn(c, required_int(c))
    df = df.withColumn(spec.label_col, spec.positive_flag().cast("int"))
    return df.dropDuplicates()


def clean_report(raw: DataFrame, spec: Spec, plan: CleanPlan) -> DataFrame:
    """Input rows, imputed, dropped, duplicate rows removed, output rows.
    Two aggregates (the duplicates need the grouped count) joined as one row."""
    staged = _steps(raw, spec, plan)
    counts = staged.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(F.col("_imputed")).alias("n_imputed"),
        F.count_if(F.col(plan.measure).isNull()).alias("n_dropped"),
    )
    kept = staged.drop("_imputed").where(F.col(plan.measure).isNotNull())
    for c in plan.int_cols:
        kept = kept.withColumn(c, required_int(c))
    dups = kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
        F.count(F.lit(1)).alias("n_output"),
    )
    return counts.select("*", dups.select("n_duplicates").scalar().alias("n_duplicates"),
                         dups.select("n_output").scalar().alias("n_output"))


def clean_observed(raw: DataFrame, spec: Spec, plan: CleanPlan) -> tuple[DataFrame, Observation]:
    """``clean`` and S9 in one read: the cleaned rows and an observation whose
    ``get`` has the counters of ``clean_report`` once a write (or another action
    over all rows) has run.

    Equal rows are counted while they are grouped, rows that go are one group of
    their own, and the counters are observed after that shuffle, in the stage
    that writes: there each task counts once, even if an executor is lost and
    earlier stages run again."""
    df = _steps(raw, spec, plan)
    gone = F.col(plan.measure).isNull()
    kept = [c for c in df.columns if c != "_imputed"]

    def value(c: str) -> Column:
        return required_int(c) if c in plan.int_cols else F.col(c)

    rows = df.select(gone.alias("_gone"), "_imputed", *[F.when(~gone, value(c)).alias(c) for c in kept])
    groups = rows.groupBy("_gone", *kept).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_imputed").alias("_n_imputed"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    seen = Observation("clean")
    out = groups.observe(
        seen, total(F.col("_n")).alias("n_input"), total(F.col("_n_imputed")).alias("n_imputed"),
        total(F.when(F.col("_gone"), F.col("_n"))).alias("n_dropped"),
        total(F.when(~F.col("_gone"), F.col("_n") - 1)).alias("n_duplicates"),
        F.count_if(~F.col("_gone")).alias("n_output"))
    out = out.where(~F.col("_gone")).select(*kept)
    return out.withColumn(spec.label_col, spec.positive_flag().cast("int")), seen
