"""Table contract shared by every operator.

A ``Spec`` names the id, the yes/no outcome and the feature columns of a
table, so that the same operators run on any customer-like table instead
of on one hard-coded file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    id_col: str
    target_col: str
    positive: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    tenure_col: str | None = None
    charge_col: str | None = None
    negative: str | None = None
    label_col: str = "label"
    # bucket edges for the tenure trend: first bucket is closed [b0, b1],
    # the others are (b_i, b_i+1]; values outside [b0, b_last] are dropped
    tenure_bounds: tuple[int, ...] = (0, 12, 24, 36, 48, 60, 72)

    @property
    def features(self) -> list[str]:
        return list(self.numeric) + list(self.categorical)

    def positive_flag(self) -> Column:
        """1 when the target equals the positive value, else 0 (missing -> 0)."""
        return F.when(F.col(self.target_col) == F.lit(self.positive), 1).otherwise(0)

    def negative_flag(self) -> Column:
        t = F.col(self.target_col)
        if self.negative is not None:
            return F.when(t == F.lit(self.negative), 1).otherwise(0)
        return F.when(t.isNotNull() & (t != F.lit(self.positive)), 1).otherwise(0)

    def with_label(self, df: DataFrame) -> DataFrame:
        if self.label_col in df.columns:
            return df
        return df.withColumn(self.label_col, self.positive_flag().cast("int"))


class SpecError(ValueError):
    pass


def require_columns(df: DataFrame, cols, what: str = "operation") -> None:
    """Raise eagerly (schema only, no job) when columns are missing."""
    have = set(df.columns)
    missing = [c for c in cols if c is not None and c not in have]
    if missing:
        raise SpecError(f"{what}: there is no column {', '.join(missing)} among {', '.join(sorted(have))}")


def is_numeric(df: DataFrame, col: str) -> bool:
    from pyspark.sql.types import NumericType

    return isinstance(df.schema[col].dataType, NumericType)


def require_numeric(df: DataFrame, col: str) -> None:
    require_columns(df, [col])
    if not is_numeric(df, col):
        raise SpecError(
            f"Column '{col}' is not numeric (type={df.schema[col].dataType.simpleString()})"
        )
