"""Profiling (P1-P7): every measure of every column in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.exprs import pct
from lapse.spec import Spec, is_numeric, require_columns


def get_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def column_kinds(df: DataFrame) -> list[tuple[str, str, str]]:
    """(name, dtype, kind) from the schema; no job."""
    return [
        (f.name, f.dataType.simpleString(), "numeric" if is_numeric(df, f.name) else "categorical")
        for f in df.schema.fields
    ]


def _distinct_counts(df: DataFrame, columns, batch: int = 8) -> DataFrame:
    """(name, n): exact distinct non-missing values.  Values are stacked
    long-form and made distinct on the map side, ``batch`` columns a read, so
    a row is never repeated once for each column of a wide table."""
    out = None
    for at in range(0, len(columns), batch):
        stacked = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns[at : at + batch]])))
        part = stacked.where("value is not null").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def get_columns(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Name, dtype, kind, distinct non-missing values (exact, or by
    HyperLogLog++ with ``approx``), missing count."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"_m{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(c, rsd).alias(f"_u{i}"))
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("name"), F.lit(dtype).alias("dtype"), F.lit(kind).alias("kind"),
            (F.col(f"_u{i}") if approx else F.lit(0)).cast("long").alias("n_unique"), F.col(f"_m{i}").alias("n_missing"),
        )
        for i, (name, dtype, kind) in enumerate(column_kinds(df))
    ]
    out = wide.select(F.inline(F.array(*rows)))
    if approx:
        return out
    found = _distinct_counts(df, df.columns)
    return out.join(found, "name", "left").select("name", "dtype", "kind", F.coalesce("n", F.lit(0)).alias("n_unique"), "n_missing")


def get_missing_values(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"))
            for i, c in enumerate(df.columns)]
    return wide.select(F.inline(F.array(*rows))).where(F.col("n_missing") > 0)


def get_rate(df: DataFrame, spec: Spec) -> DataFrame:
    """Total rows (missing outcome included), positive, negative, rate."""
    out = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(spec.target_col) == spec.positive).alias("positive"),
        F.sum(spec.negative_flag()).alias("_neg"),
    )
    return out.select(
        "total", "positive", F.coalesce("_neg", F.lit(0)).cast("long").alias("negative"),
        pct(F.col("positive"), F.col("total")).alias("rate_pct"),
    )


def dataset_info(df: DataFrame, spec: Spec, with_duplicates: bool = True) -> DataFrame:
    """P5: one row of dataset facts, with the missing values of each column
    that has some and the numeric and text columns.  ``n_cols`` counts the derived binary
    label.  Duplicate rows = rows - distinct rows, computed as a grouped
    count over all columns (one shuffle, no collect)."""
    require_columns(df, [spec.id_col, spec.target_col])
    labelled = spec.with_label(df)
    each = {c: F.count_if(F.col(c).isNull()) for c in labelled.columns}
    missing = sum(each.values(), F.lit(0))
    by_column = F.create_map(*[x for c, n in each.items() for x in (F.lit(c), n)])
    numeric = [c for c in labelled.columns if is_numeric(labelled, c)]
    text = [f.name for f in labelled.schema.fields if f.dataType.simpleString() == "string"]
    main = labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(labelled.columns)).alias("n_cols"),
        F.count_if(F.col(spec.target_col) == spec.positive).alias("n_positive"),
        F.sum(spec.negative_flag()).cast("long").alias("n_negative"),
        missing.cast("long").alias("n_missing_total"),
        F.map_filter(by_column, lambda k, v: v > 0).alias("missing_columns"),
        F.count_distinct(spec.id_col).alias("_ids"),
    ).select(
        "n_rows", "n_cols", "n_positive", F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
        pct(F.col("n_positive"), F.col("n_rows")).alias("rate_pct"),
        "n_missing_total", "missing_columns",
        F.array(*map(F.lit, numeric)).cast("array<string>").alias("numeric_columns"),
        F.array(*map(F.lit, text)).cast("array<string>").alias("categorical_columns"),
        (F.col("_ids") == F.col("n_rows")).alias("id_unique"),
    )
    if not with_duplicates:
        return main
    dups = (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicate_rows"))
    )
    return main.select("*", dups.scalar().alias("n_duplicate_rows"))


def kpi_row(df: DataFrame, spec: Spec) -> DataFrame:
    """Customers, outcome rate, retention = 100 - rate."""
    r = get_rate(df, spec)
    return r.select(
        F.col("total").alias("customers"),
        "rate_pct",
        F.round(F.lit(100.0) - F.col("rate_pct"), 2).alias("retention_pct"),
        F.col("positive").alias("churned"),
        F.col("negative").alias("retained"),
    )
