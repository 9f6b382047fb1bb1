"""Sort, top-k, lookups and the risk ledger.

Top-k is ``orderBy(...).limit(n)``, which Catalyst plans as
TakeOrderedAndProject: each task keeps its own n best rows, only n rows
per task reach the final merge.  Enrichment joins run *after* the top-k,
so the broadcast side has at most n rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.functions.exprs import risk_level
from lapse.functions.text import strip_ws
from lapse.spec import Spec, SpecError, require_columns
from lapse.staging import staged

MAX_TOP = 100


def _order(col: str, ascending: bool) -> Column:
    return F.asc_nulls_last(col) if ascending else F.desc_nulls_last(col)


def top_n_records(df: DataFrame, sort_col: str, n: int = 10, ascending: bool = False,
                  columns=None, tie_break: str | None = None) -> DataFrame:
    """Missing values last in both directions; ``tie_break`` (the id)
    makes ties deterministic."""
    cols = list(columns) if columns else list(df.columns)
    require_columns(df, [sort_col, tie_break, *cols])
    if sort_col not in cols:
        raise SpecError(f"projected columns must include sort column '{sort_col}'")
    order = [_order(sort_col, ascending)]
    if tie_break:
        order.append(F.asc(tie_break))
    proj = cols + ([tie_break] if tie_break and tie_break not in cols else [])
    out = df.select(*proj).orderBy(*order).limit(int(n))
    return out.select(*cols)


def lookup_ids(df: DataFrame, spec: Spec, ids) -> DataFrame:
    """Rows whose id matches one of ``ids``, whatever its case and the white
    space around it.  ``ids`` is a list or a one-column DataFrame of requested
    ids, under one rule; the bulk form is an equi-join on the normalised id (no
    driver loop).  Null ids match nothing."""
    if isinstance(ids, DataFrame):
        req = ids.select(_norm(F.col(ids.columns[0])).alias(STORE_KEY)).distinct()
        return df.join(req, _norm(F.col(spec.id_col)) == F.col(STORE_KEY), "left_semi")
    keys = [_norm(F.lit(None if i is None else str(i))) for i in ids]
    return df.where(_norm(F.col(spec.id_col)).isin(*keys)) if keys else df.limit(0)


def _norm(c: Column) -> Column:
    """The rule under which ids are equal."""
    return F.upper(strip_ws(c.cast("string")))


STORE_KEY = "__lookup_key"


def write_lookup_store(df: DataFrame, spec: Spec, table: str, buckets: int, path: str | None = None) -> None:
    """T2 for a base that is looked up again and again: ``df`` as a table in
    buckets of its normalised id, sorted by it within each file.  ``lookup_store``
    then reads the buckets and row groups of a list of ids only, or joins a table
    of ids without moving the base.  Rows without id are not stored.

    ``path`` puts the files elsewhere than in the warehouse.  The rows are dealt
    out by bucket first, so there is one file a bucket."""
    if STORE_KEY in df.columns:
        raise SpecError(f"column '{STORE_KEY}' is the store's own")
    keyed = df.withColumn(STORE_KEY, _norm(F.col(spec.id_col))).where(F.col(STORE_KEY).isNotNull())
    writer = keyed.repartition(buckets, STORE_KEY).write.bucketBy(buckets, STORE_KEY).sortBy(STORE_KEY).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lookup_store(spark: SparkSession, table: str, ids) -> DataFrame:
    """The rows of a lookup store whose id is one of ``ids`` (a list or a
    one-column DataFrame), as ``lookup_ids`` finds them."""
    base = spark.table(table)
    if isinstance(ids, DataFrame):
        req = ids.select(_norm(F.col(ids.columns[0])).alias(STORE_KEY)).distinct()
        # the merge join keeps the base where it lies: its buckets are the partitions of the join
        found = base.join(req.hint("merge"), STORE_KEY, "left_semi").select(*base.columns)
    else:
        # normalised beforehand, for the scan prunes by plain values; upper-case and white space as in _norm
        asked = [_norm(F.lit(None if i is None else str(i))) for i in ids]
        keys = [k for k in spark.range(1).select(F.array(*asked)).first()[0] if k is not None] if asked else []
        found = base.where(F.col(STORE_KEY).isin(keys)) if keys else base.limit(0)
    return found.drop(STORE_KEY)


def tier_counts(scores: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """T4: rows per risk tier."""
    return scores.groupBy(risk_level(F.col(score_col)).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("count")
    )


def top_risk(scores: DataFrame, base: DataFrame, spec: Spec, n: int = 10,
             enrich=(), score_col: str = "risk_score", max_n: int | None = MAX_TOP) -> DataFrame:
    """The n highest scores, then a left join to the base table for a few
    attributes.  n is brought into 1..``max_n`` (None: no upper bound).  The
    base table is first cut to those ids by a semi-join with the at most n ids
    (broadcast up to ``MAX_TOP``), so it is never shuffled."""
    n = max(1, int(n) if max_n is None else min(int(n), max_n))
    top = (
        scores.select(spec.id_col, score_col)
        .orderBy(F.desc_nulls_last(score_col), F.asc(spec.id_col))
        .limit(n)
        .withColumn("risk_level", risk_level(F.col(score_col)))
    )
    if not enrich:
        return top
    top = staged(top, "top")
    ids = top.select(spec.id_col)
    attrs = base.select(spec.id_col, *enrich).join(F.broadcast(ids) if n <= MAX_TOP else ids, spec.id_col, "left_semi")
    return top.join(attrs, spec.id_col, "left").select(spec.id_col, score_col, "risk_level", *enrich)


def ledger(scores: DataFrame, spec: Spec, tiers=("High", "Medium", "Low"),
           search: str | None = None, score_col: str = "risk_score") -> DataFrame:
    """T5: filter by tier list and a case-insensitive regex on the id,
    sorted by score descending (range-partitioned sort, not one task)."""
    out = scores.withColumn("risk_level", risk_level(F.col(score_col))).where(
        F.col("risk_level").isin(list(tiers))
    )
    if search and search.strip():
        out = out.where(F.col(spec.id_col).cast("string").rlike("(?i)" + search.strip()))
    return out.orderBy(F.desc_nulls_last(score_col), F.asc(spec.id_col))
