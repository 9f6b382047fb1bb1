"""Text expressions for the agent's data checks (Q4-Q9, Q11).

Regular expressions stay in the subset shared by Java and RE2 (classes,
alternation, lazy quantifiers, inline flags; no look-around), so the
oracle SQL can say the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Question routing keywords, in rule order (first match wins).
ID_PATTERN = r"\b([A-Z0-9]{4}-[A-Z0-9]{5})\b"
WHAT_IF_WORDS = ["hypothetical", "what if", "changes", "switch", "change"]
CORRELATION_WORDS = ["correlation", "corr", "heatmap", "relationship", "relate", "association", "associated"]
MODEL_WORDS = ["model", "feature importance", "important feature", "metrics", "roc", "auc", "accuracy"]
TENURE_TREND_WORDS = ["trend", "bucket", "range", "over time", "length", "duration"]
TOP_RISK_WORDS = ["high risk", "highest risk", "top risk", "most likely to churn", "at risk"]
COUNT_WORDS = ["how many", "count", "total customers", "number of"]
SEGMENT_WORDS = [
    ("contract", "Contract"), ("payment", "PaymentMethod"), ("internet", "InternetService"),
    ("gender", "gender"), ("senior", "SeniorCitizen"), ("partner", "Partner"),
    ("dependents", "Dependents"), ("tech support", "TechSupport"), ("online security", "OnlineSecurity"),
    ("paperless", "PaperlessBilling"),
]
RATE_WORDS = ["churn rate", "churn %", "percentage churn", "churn percentage"]
AVERAGE_WORDS = ["average", "mean", "monthly charges"]
AVERAGE_SPLIT_WORDS = ["churn", "churned", "vs", "difference"]

# Scenario phrases: (feature, [(phrases, value), ...]) first match wins.
SCENARIO_RULES = [
    ("Contract", [(["two year", "two-year", "twoyear", "2 year", "2-year"], "Two year"),
                  (["one year", "one-year", "oneyear", "1 year", "1-year"], "One year"),
                  (["month-to-month", "month to month", "monthtomonth"], "Month-to-month")]),
    ("PaymentMethod", [(["bank transfer"], "Bank transfer (automatic)"),
                       (["credit card"], "Credit card (automatic)"),
                       (["electronic check"], "Electronic check"),
                       (["mailed check"], "Mailed check")]),
    ("InternetService", [(["fiber"], "Fiber optic"), (["dsl"], "DSL")]),
]
ADDON_RULES = [
    ("TechSupport", ["tech support", "techsupport"]),
    ("OnlineSecurity", ["online security", "onlinesecurity"]),
    ("OnlineBackup", ["online backup", "onlinebackup"]),
    ("DeviceProtection", ["device protection", "deviceprotection"]),
]
ACTION_WORDS = ["add", "added", "yes", "get", "got", "switch", "with", "enable", "buy", "include", "included"]

# Answer clean-up.
DISCLAIMER_PATTERNS = [
    r"\(as returned by the model\)",
    r"\(as returned by model\)",
    r"Source:\s*`?[a-zA-Z_]+`?\s*result\.?",
    r"These figures come directly from standard tool computations\.?",
    r"These figures come directly from the `?[a-zA-Z_]+`? result\.?",
    r"The tool returned only these [a-zA-Z0-9\s]+ entries[\s\S]*?\.",
]
FINAL_CHECK_PATTERN = r"Final check of the text:\s*[\"“]([\s\S]+?)[\"”]"
CUTOFF_PATTERNS = [
    r"\n\s*Check against rules\s*:",
    r"\n\s*Constraints check\s*:",
    r"\n\s*Self-correction\s*:",
    r"\n\s*Matches all constraints\s*\.",
]
SECTION_MARKER = r"(?:Final Polish|Final Answer|Final Response|Refined Answer|Draft)\s*:\s*"
THINKING_STARTERS = [
    "the user", "i need to", "i should", "tool 1", "tool 2", "tool 3",
    "wait,", "actually,", "let's check", "i'll keep it", "this follows all rules",
    "no inner monologue", "direct answer", "grounded in", "is there any other",
    "i will state", "or i can just", "the prompt says", "the tool results",
    "user question:", "context:", "tool results:", "analyze tool data:",
    "extract key information", "synthesize the answer:", "refine language:",
    "draft the response:", "refine the response", "opening:", "details:",
    "factors:", "profile:", "customer features:", "draft:", "let's craft",
    "count, but", "rule", "check against rules", "matches all constraints",
    "proceeds. i will output", "final check of the text", "respond immediately?",
    "acknowledge insufficient", "no extra numbers?", "source:",
]
RULE_BULLET_WORDS = ["base answer", "quote specific", "no inner", "conversational", "tool results",
                     "respond immediately", "extra numbers"]
META_PHRASES = ["this follows all rules", "no inner monologue", "direct answer", "grounded in tool",
                "let's craft", "matches all constraints", "i will just output the answer"]
THINK_PATTERN = r"<think>[\s\S]*?</think>"

# Numbers in answers; JSON blocks.
NUMBER_PATTERN = r"\b\d+\.?\d*\b"
THOUSANDS_PATTERN = r"(\d+),(\d+)"
FENCE_PATTERN = r"```(?:json)?\s*([\s\S]+?)\s*```"
BRACES_PATTERN = r"\{[\s\S]+\}"

# Intents, operations and charts of the routing rules, by rule.
ROUTE_TARGETS = {
    "what_if": ("hypothetical", "predict_hypothetical", None),
    "id": ("prediction", "predict_customer_risk", None),
    "correlation": ("eda", "correlation", "correlation_heatmap"),
    "model": ("model_info", "get_model_info", "feature_importance"),
    "tenure_trend": ("eda", "tenure_trend", "tenure_trend"),
    "top_risk": ("aggregate", "get_top_risk_customers", "top_risk_customers"),
    "count": ("dataset_info", "get_dataset_info", None),
    "segment": ("eda", "group_by_churn", "churn_by_column"),
    "rate": ("eda", "get_churn_rate", "churn_distribution"),
    "average_split": ("eda", "average_by_churn", "monthly_charges_by_churn"),
    "average": ("eda", "get_average", "monthly_charges_by_churn"),
    "default": ("dataset_info", "get_dataset_info", None),
}
AVERAGE_COLUMN = "MonthlyCharges"
# Words of a correlation question and the pair of columns they name.
CORRELATION_PAIRS = [
    (("tenure", "monthly"), "tenure", "MonthlyCharges"),
    (("tenure", "total"), "tenure", "TotalCharges"),
    (("monthly", "total"), "MonthlyCharges", "TotalCharges"),
]
# ---------------------------------------------------------------- end of fixed values


def contains_any(col: Column, words) -> Column:
    expr = None
    for w in words:
        e = col.contains(w)
        expr = e if expr is None else (expr | e)
    return expr if expr is not None else F.lit(False)


def _literal_alternation(words, anchored: bool = False) -> str:
    """One Java regex matching any of ``words`` literally (\\Q...\\E)."""
    body = "|".join("\\Q" + w + "\\E" for w in words)
    return ("^" if anchored else "") + "(?:" + body + ")"


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


# ---------------------------------------------------------------- Q4 grounding



def numbers_over(text: Column, floor: float = 10.0) -> Column:
    """Distinct numbers in ``text`` (one thousands comma removed per match),
    rounded to 2 dp, keeping those above ``floor``."""
    cleaned = F.regexp_replace(text, THOUSANDS_PATTERN, "$1$2")
    nums = F.transform(F.regexp_extract_all(cleaned, F.lit(NUMBER_PATTERN), 0),
                       lambda s: F.round(s.try_cast("double"), 2))
    return F.array_distinct(F.filter(nums, lambda x: x > F.lit(floor)))


def ungrounded_numbers(answer: Column, evidence: Column, floor: float = 10.0) -> Column:
    return F.array_except(numbers_over(answer, floor), numbers_over(evidence, -1.0))


# ---------------------------------------------------------------- Q5 routing / Q6 ids

def customer_id(text: Column) -> Column:
    """Q6: first id-shaped token of the upper-cased text, NULL if none."""
    return F.nullif(F.regexp_extract(F.upper(text), ID_PATTERN, 1), F.lit(""))


def route_steps(df: DataFrame, text: str, keep=()) -> DataFrame:
    """Q5/Q6: (intent, operation, column, customer_id, chart, col1, col2,
    changes) from keyword rules in order; the first rule that fires wins.
    chart: the chart of the plan's second step; col1, col2: the pair of a
    correlation; changes: the features that a what-if question changes.  The lowered text and the id are
    computed once, in their own projection."""
    pre = df.select(*dict.fromkeys([*keep, text]), F.regexp_replace(F.lower(F.col(text)), "-", " ").alias("_q"),
                    customer_id(F.col(text)).alias("customer_id"))
    q = F.col("_q")
    has_id = F.col("customer_id").isNotNull()
    rules = [
        (has_id & contains_any(q, WHAT_IF_WORDS), "what_if", None),
        (has_id, "id", None),
        (contains_any(q, CORRELATION_WORDS), "correlation", None),
        (contains_any(q, MODEL_WORDS), "model", None),
        (q.contains("tenure") & contains_any(q, TENURE_TREND_WORDS), "tenure_trend", None),
        (contains_any(q, TOP_RISK_WORDS), "top_risk", None),
        (contains_any(q, COUNT_WORDS), "count", None),
    ]
    rules += [(q.contains(k), "segment", col) for k, col in SEGMENT_WORDS]
    rules += [
        (contains_any(q, RATE_WORDS), "rate", None),
        (contains_any(q, AVERAGE_WORDS) & contains_any(q, AVERAGE_SPLIT_WORDS), "average_split", AVERAGE_COLUMN),
        (contains_any(q, AVERAGE_WORDS), "average", AVERAGE_COLUMN),
    ]
    # the index of the first rule that fires, then lookups by it
    first = None
    for i, (cond, *_rest) in enumerate(rules):
        first = F.when(cond, i) if first is None else first.when(cond, i)
    pre = pre.withColumn("_rule", first)

    def pick(of, default):
        e = F.lit(default).cast("string")
        for i, (_, target, column) in enumerate(rules):
            e = F.when(F.col("_rule") == i, F.lit(of(ROUTE_TARGETS[target], column)).cast("string")).otherwise(e)
        return e

    kinds = [target for _, target, _ in rules]
    pair = None
    for words, one, two in CORRELATION_PAIRS:
        hit = q.contains(words[0]) & q.contains(words[1])
        value = F.struct(F.lit(one).alias("one"), F.lit(two).alias("two"))
        pair = F.when(hit, value) if pair is None else pair.when(hit, value)
    pair = F.when(F.col("_rule") == kinds.index("correlation"), pair)
    changes = F.when(F.col("_rule") == kinds.index("what_if"), scenario_map(F.col(text)))
    default = ROUTE_TARGETS["default"]
    return pre.select(*keep, pick(lambda t, c: t[0], default[0]).alias("intent"),
                      pick(lambda t, c: t[1], default[1]).alias("operation"),
                      pick(lambda t, c: c, None).alias("column"), "customer_id",
                      pick(lambda t, c: t[2], default[2]).alias("chart"),
                      pair["one"].alias("col1"), pair["two"].alias("col2"), changes.alias("changes"))


# ---------------------------------------------------------------- Q7 scenarios

def scenario_columns(text: Column) -> list[Column]:
    """Q7: one column per feature the rules can change (NULL = no change)."""
    q = F.lower(text)
    out = []
    for feature, options in SCENARIO_RULES:
        e = None
        for phrases, value in options:
            cond = contains_any(q, phrases)
            e = F.when(cond, value) if e is None else e.when(cond, value)
        out.append(e.alias(feature))
    act = contains_any(q, ACTION_WORDS)
    for feature, phrases in ADDON_RULES:
        out.append(F.when(contains_any(q, phrases) & act, "Yes").alias(feature))
    return out


def scenario_map(text: Column) -> Column:
    """Q7 as a map<string,string> of changed features (feeds what-if)."""
    cols = scenario_columns(text)
    names = [f for f, _ in SCENARIO_RULES] + [f for f, _ in ADDON_RULES]
    m = F.create_map(*[x for n, c in zip(names, cols) for x in (F.lit(n), c)])
    return F.map_filter(m, lambda k, v: v.isNotNull())


# ---------------------------------------------------------------- Q9 clean-up

def _ci(p: str) -> str:
    return "(?i)" + p


def clean_answer_steps(df: DataFrame, text: str, out: str = "cleaned", starters=THINKING_STARTERS,
                       drop_yes_no_bullets: bool = False) -> DataFrame:
    """Q9: remove think blocks and disclaimers, keep a quoted final check,
    cut at self-review markers, keep what follows a final-answer marker,
    drop meta-reasoning lines, strip outer quotes; the text before the line
    filter is returned when everything was removed.

    Each step is its own projection over a named column: a single nested
    expression would repeat the previous step two or three times per step
    and grow exponentially."""
    t = F.col("_t")
    step = df.withColumn("_t", strip_ws(F.regexp_replace(F.col(text), _ci(THINK_PATTERN), "")))
    for p in DISCLAIMER_PATTERNS:
        step = step.withColumn("_t", F.regexp_replace(t, _ci(p), ""))
    fc = F.regexp_extract(t, _ci(FINAL_CHECK_PATTERN), 1)
    step = step.withColumn("_t", F.when(t.rlike(_ci(FINAL_CHECK_PATTERN)), strip_ws(fc)).otherwise(t))
    # cut at the first self-review pattern (in list order) that leaves more
    # than 10 characters before it
    pres = [f"_pre{i}" for i in range(len(CUTOFF_PATTERNS))]
    step = step.select("*", *[strip_ws(F.regexp_extract(t, _ci(r"^([\s\S]*?)" + p), 1)).alias(n)
                              for p, n in zip(CUTOFF_PATTERNS, pres)])
    cut = t
    for p, n in reversed(list(zip(CUTOFF_PATTERNS, pres))):
        cut = F.when(t.rlike(_ci(p)) & (F.length(F.col(n)) > 10), F.col(n)).otherwise(cut)
    step = step.withColumn("_t", cut).drop(*pres)
    step = step.withColumn("_post", strip_ws(F.regexp_extract(t, _ci(r"^[\s\S]*" + SECTION_MARKER + r"([\s\S]*)$"), 1)))
    step = step.withColumn("_t", F.when(t.rlike(_ci(SECTION_MARKER)) & (F.length("_post") > 20), F.col("_post"))
                           .otherwise(t)).drop("_post")

    starts = _literal_alternation(starters, anchored=True)
    rule_words = _literal_alternation(RULE_BULLET_WORDS)
    meta = _literal_alternation(META_PHRASES)

    def keep(x):
        s = x["s"]  # the lowered, stripped line, computed once per line
        bullet = s.startswith("•") | s.startswith("-")
        drop = s.rlike(starts)
        if drop_yes_no_bullets:
            drop = drop | (bullet & (s.contains("?") | s.contains("yes") | s.contains("no")))
        drop = drop | ((s.startswith("- ") | s.startswith("• ")) & s.rlike(rule_words))
        drop = drop | s.rlike(meta)
        return (s == "") | ~drop

    lines = F.transform(F.split(t, "\n"), lambda ln: F.struct(ln.alias("l"), F.lower(strip_ws(ln)).alias("s")))
    kept = F.transform(F.filter(lines, keep), lambda x: F.when(x["s"] == "", "").otherwise(x["l"]))
    step = step.withColumn("_r", strip_ws(F.array_join(kept, "\n")))
    r = F.col("_r")
    step = step.withColumn("_r", F.when(r.startswith('"') & r.endswith('"'),
                                        strip_ws(F.regexp_extract(r, r'^"([\s\S]*)"$', 1))).otherwise(r))
    return step.withColumn(out, F.when(r == "", t).otherwise(r)).drop("_t", "_r")


# ---------------------------------------------------------------- Q11 JSON



def extract_json(text: Column):
    """Q11: parse the whole text, else the first fenced block, else the
    outermost braces.  Returns (variant, source)."""
    whole = F.try_parse_json(strip_ws(text))
    fence = F.try_parse_json(F.nullif(F.regexp_extract(text, FENCE_PATTERN, 1), F.lit("")))
    braces = F.try_parse_json(F.nullif(F.regexp_extract(text, BRACES_PATTERN, 0), F.lit("")))
    source = (F.when(whole.isNotNull(), "whole").when(fence.isNotNull(), "fence")
              .when(braces.isNotNull(), "braces"))
    return F.coalesce(whole, fence, braces), source
