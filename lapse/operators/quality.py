"""Result-table checks (Q1-Q4, Q10): rule violations counted in one
aggregate per table, returned long-form (rule, severity, violations,
passed).  Checks read every row (the reference inspects 20 list items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, VariantType


def _rules_frame(df: DataFrame, rules) -> DataFrame:
    """rules: [(name, severity, violation_predicate)]"""
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.coalesce(pred, F.lit(False))).alias(f"_v{i}") for i, (_, _, pred) in enumerate(rules)])
    rows = [F.struct(F.lit("empty_result").alias("rule"), F.lit("warning").alias("severity"),
                     F.when(F.col("_n") == 0, 1).otherwise(0).cast("long").alias("violations"))]
    rows += [F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(f"_v{i}").alias("violations"))
             for i, (n, s, _) in enumerate(rules)]
    out = agg.select(F.inline(F.array(*rows)))
    # warnings never fail a check (an empty result passes with a warning)
    return out.withColumn("passed", (F.col("violations") == 0) | (F.col("severity") == "warning"))


def prediction_checks(scores: DataFrame, score_col: str = "risk_score",
                      required=("risk_score", "risk_level", "prediction"),
                      delta_fields=()) -> DataFrame:
    """Q1/Q3: required fields present, score within [0, 1], what-if delta
    fields present, plus the empty-result warning."""
    rules = [(f"missing_{c}", "error", F.col(c).isNull()) for c in required]
    s = F.col(score_col)
    rules.append(("score_out_of_range", "error", (s < 0) | (s > 1)))
    rules += [(f"missing_{c}", "error", F.col(c).isNull()) for c in delta_fields]
    return _rules_frame(scores, rules)


def _is_bad(c: Column) -> Column:
    return F.isnan(c) | c.isin(float("inf"), float("-inf"))


def numeric_sanity(df: DataFrame, severity: str = "error") -> DataFrame:
    """Q2: NaN / +-Inf count of every floating column; an analysis result
    with any fails (``severity="warning"`` only reports them)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    rules = [(f"nan_or_inf_{c}", severity, _is_bad(F.col(c))) for c in cols]
    return _rules_frame(df, rules).where(F.col("rule") != "empty_result")


def _shape_of(df: DataFrame, name: str) -> str | None:
    """Type of all that a variant column holds; None if it holds nothing."""
    found = df.agg(F.schema_of_variant_agg(F.col(f"`{name}`")).alias("t")).first()["t"]
    return found.replace("OBJECT<", "STRUCT<").replace("VOID", "VARIANT") if found and found != "VOID" else None


def bad_paths(value: Column, kind: DataType, path: Column) -> Column | None:
    """The paths below ``path`` at which a value holds NaN or an infinity, as an
    array; None if its type can hold none.  Names are joined by dots, places in
    a list (from 0) in brackets, as are map keys that are no strings."""
    here = F.array(path)
    none = F.array().cast("array<string>")
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(_is_bad(value), here).otherwise(none)
    if isinstance(kind, VariantType):  # where values of several types meet
        return F.when(_is_bad(F.try_variant_get(value, "$", "double")), here).otherwise(none)
    if isinstance(kind, StructType):
        parts = [bad_paths(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(none) if parts else None
    if isinstance(kind, ArrayType):
        if bad_paths(value, kind.elementType, path) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: bad_paths(
            x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if isinstance(kind, MapType):
        if bad_paths(value, kind.valueType, path) is None:
            return None
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), lambda e: bad_paths(
            e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))), none)
    return None


def bad_numbers(df: DataFrame, keep=()) -> DataFrame:
    """Q2 in nested results: (keep..., path), one row per NaN or infinity at any
    depth of structs, lists, maps and variants.  The walk follows the schema
    (a variant's is gathered in one aggregate); rows are not multiplied, only
    what is found comes out.  Every list item is looked at."""
    parts = []
    for f in df.schema.fields:
        value, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, VariantType):
            shape = _shape_of(df, f.name)
            if shape is None:
                continue
            kind = StructType.fromDDL(f"x {shape}")["x"].dataType
            value = F.try_variant_get(value, "$", shape)
        part = bad_paths(value, kind, F.lit("$." + f.name))
        if part is not None:
            parts.append(part)
    found = F.concat(*parts) if parts else F.array().cast("array<string>")
    return df.select(*keep, F.explode(found).alias("path"))


def grounding(df: DataFrame, answer: str = "answer", evidence: str = "evidence", floor: float = 10.0,
              keep=()) -> DataFrame:
    """Q4: numbers above ``floor`` in the answer that the evidence does
    not contain."""
    from lapse.functions.text import numbers_over, ungrounded_numbers

    ung = ungrounded_numbers(F.col(answer), F.col(evidence), floor)
    return df.select(*keep, F.size(numbers_over(F.col(answer), floor)).alias("n_numbers"),
                     F.size(ung).alias("n_ungrounded"), (F.size(ung) == 0).alias("grounded"))


def plan_checks(plans: DataFrame, text_col: str = "plan_json", keep=()) -> DataFrame:
    """Q10: per plan document: intent present, steps present and a list,
    steps without a tool (an error) or params (a warning), and whether an empty step list is allowed (only
    for intent 'unanswerable')."""
    v = F.try_parse_json(F.col(text_col))
    intent = F.try_variant_get(v, "$.intent", "string")
    steps = F.try_variant_get(v, "$.steps", "array<variant>")
    has_steps_key = F.try_variant_get(v, "$.steps", "variant").isNotNull()
    n_no_tool = F.size(F.filter(steps, lambda s: F.try_variant_get(s, "$.tool", "variant").isNull()))
    n_no_params = F.size(F.filter(steps, lambda s: F.try_variant_get(s, "$.params", "variant").isNull()))
    n_steps = F.size(steps)
    out = plans.select(
        *keep,
        v.isNotNull().alias("parsed"),
        intent.isNotNull().alias("has_intent"),
        has_steps_key.alias("has_steps"),
        steps.isNotNull().alias("steps_is_list"),
        F.when(steps.isNotNull(), n_steps).alias("n_steps"),
        F.when(steps.isNotNull(), n_no_tool).alias("n_steps_without_tool"),
        F.when(steps.isNotNull(), n_no_params).alias("n_steps_without_params"),
        (steps.isNotNull() & (n_steps == 0) & (F.coalesce(intent, F.lit("")) != "unanswerable"))
        .alias("empty_plan_warning"),
    )
    return out.withColumn(
        "passed", F.col("has_intent") & F.col("has_steps") & F.col("steps_is_list")
        & (F.coalesce(F.col("n_steps_without_tool"), F.lit(0)) == 0))
