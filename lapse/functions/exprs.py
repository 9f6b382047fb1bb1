"""Column expressions with the reference's scalar semantics (section X).

All built-in, JVM-side expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from lapse.spec import SpecError

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains")


def compare(df: DataFrame, column: str, value, operator: str = "eq", literal: bool = False) -> Column:
    """Predicate for ``filter_and_count``.

    eq/gt/gte/lt/lte: a missing value never matches.  ne: a missing value
    *does* match (pandas ``!=``).  contains: case-insensitive regular
    expression on the string form, missing never matches; ``literal=True``
    does a plain substring test instead.  A number against a string column
    (or the reverse) is rejected up front for the ordering operators.
    """
    if operator not in OPERATORS:
        raise SpecError(f"operator must be one of: {list(OPERATORS)}")
    if column not in df.columns:
        raise SpecError(f"there is no column {column} among {', '.join(sorted(df.columns))}")
    c = F.col(column)
    if operator == "contains":
        s = c.cast("string")
        if literal:
            return F.coalesce(F.lower(s).contains(str(value).lower()), F.lit(False))
        return F.coalesce(s.rlike("(?i)" + str(value)), F.lit(False))
    dtype = df.schema[column].dataType
    is_num_col = isinstance(dtype, NumericType)
    is_num_val = isinstance(value, (int, float)) and not isinstance(value, bool)
    if is_num_col != is_num_val and not (isinstance(dtype, StringType) and isinstance(value, str)):
        raise SpecError(
            f"Cannot compare column '{column}' ({dtype.simpleString()}) with {value!r}"
        )
    v = F.lit(value)
    if operator == "eq":
        return F.coalesce(c == v, F.lit(False))
    if operator == "ne":
        return ~c.eqNullSafe(v)
    op = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[operator]
    return F.coalesce(op, F.lit(False))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """round(100 * part / whole, digits); 0.0 when whole is 0 (ANSI-safe)."""
    return F.coalesce(
        F.round(F.try_divide(F.lit(100.0) * part, whole), digits), F.lit(0.0)
    )


def pearson(x: str, y: str) -> Column:
    """Pairwise-complete Pearson r that is NULL (not an error) for a constant
    column: covar_pop over rows where both are present, divided by the
    population std of each taken over the same rows.  Constant means equal
    extremes: the std of equal values, added up by parts, may differ from 0."""
    cx, cy = F.col(x), F.col(y)
    both = cx.isNotNull() & cy.isNotNull()
    px, py = F.when(both, cx), F.when(both, cy)
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(varies, F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(px) * F.stddev_pop(py)))


# Risk tiers.  Fixed values: High [0.70, 1.01), Medium [0.40, 0.70),
# Low [0.0, 0.40); anything else is High.
RISK_TIERS = (("High", 0.70, 1.01), ("Medium", 0.40, 0.70), ("Low", 0.0, 0.40))
DEFAULT_THRESHOLD = 0.50


def risk_level(score: Column) -> Column:
    expr = None
    for name, lo, hi in RISK_TIERS:
        cond = (score >= F.lit(lo)) & (score < F.lit(hi))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("High")


def prediction_label(score: Column, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= t, "Likely to churn").otherwise("Unlikely to churn")
