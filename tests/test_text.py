"""Literal rows for the text jobs and checks (Q1-Q11)."""

from pyspark.sql import functions as F

from lapse.operators import quality as QC
from lapse.operators import textjobs as TJ


def test_grounding_answers(spark):
    rows = [(1, "There are 7,043 customers and a 26.54% rate.", "{'n_rows': 7043, 'churn_rate_pct': 26.54}"),
            (2, "About 99 of them left.", "{'n_rows': 7043}"),
            (3, "Only 3 of 5 matter.", "")]
    out = {r["aid"]: r for r in QC.grounding(spark.createDataFrame(rows, "aid long, answer string, evidence string"),
                                             keep=["aid"]).collect()}
    assert out[1]["grounded"] and out[1]["n_numbers"] == 2
    assert not out[2]["grounded"] and out[2]["n_ungrounded"] == 1
    assert out[3]["grounded"] and out[3]["n_numbers"] == 0  # numbers <= 10 are ignored


def test_routing_rules(spark):
    qs = [
        (1, "What if customer 7590-VHVEG switches to a two year contract?"),
        (2, "Predict risk for 7590-vhveg"),
        (3, "Is tenure correlated with monthly charges? Show the correlation"),
        (4, "Which model features matter?"),
        (5, "Show the tenure trend"),
        (6, "Who is at risk the most?"),
        (7, "How many customers do we have?"),
        (8, "Churn by payment method"),
        (9, "What is the churn rate?"),
        (10, "Average monthly charges churned vs not"),
        (11, "Average monthly charges"),
        (12, "Tell me something"),
        (13, "count of contract types"),  # matches two rules: count wins (earlier)
    ]
    df = spark.createDataFrame(qs, "qid long, text string")
    out = {r["qid"]: r for r in TJ.route_questions(df, keep=["qid"]).collect()}
    assert out[1]["intent"] == "hypothetical" and out[1]["customer_id"] == "7590-VHVEG"
    assert out[2]["intent"] == "prediction"
    assert out[3]["operation"] == "correlation"
    assert out[4]["intent"] == "model_info"
    assert out[5]["operation"] == "tenure_trend"
    assert out[6]["operation"] == "get_top_risk_customers"
    assert out[7]["intent"] == "dataset_info"
    assert (out[8]["operation"], out[8]["column"]) == ("group_by_churn", "PaymentMethod")
    assert out[9]["operation"] == "get_churn_rate"
    assert out[10]["operation"] == "average_by_churn"
    assert out[11]["operation"] == "get_average"
    assert out[12]["operation"] == "get_dataset_info"
    assert out[13]["operation"] == "get_dataset_info"


def test_scenario_extraction(spark):
    df = spark.createDataFrame([(1, "switch to a two-year contract paid by credit card with tech support"),
                                (2, "tech support only"), (3, "nothing here")], "qid long, text string")
    out = {r["qid"]: r for r in TJ.extract_scenarios(df, keep=["qid"]).collect()}
    assert out[1]["Contract"] == "Two year" and out[1]["PaymentMethod"] == "Credit card (automatic)"
    assert out[1]["TechSupport"] == "Yes" and out[1]["n_changes"] == 3
    assert out[2]["TechSupport"] is None  # add-ons need an action word
    assert out[3]["n_changes"] == 0


def test_recent_context(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t} " + "x" * (250 if t == 7 else 3))
             for t in range(10)] + [(2, 0, "user", "lonely question")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in TJ.recent_context(df).collect()}
    assert out[1]["n_pairs"] == 3
    ctx = out[1]["context"]
    assert ctx.startswith("Q: text 4") and ctx.count("\n\n") == 2 and ctx.endswith("...")
    assert out[2]["context"] == "No prior conversation."


def test_answer_cleanup(spark):
    rows = [
        (1, "<think>secret plan</think>The churn rate is 26.54%. (as returned by the model)"),
        (2, "Draft: something short\nFinal Answer: The churn rate is 26.54% across 7,043 customers."),
        (3, "The user wants numbers.\nI need to check.\nChurn is 26.54%.\n- 50 customers now"),
        (4, "The user asked."),
        (5, '"Quoted answer here"'),
        (6, "Answer body is long enough\nCheck against rules: fine"),
    ]
    df = spark.createDataFrame(rows, "aid long, text string")
    out = {r["aid"]: r["cleaned"] for r in TJ.clean_answers(df, keep=["aid"]).collect()}
    assert out[1] == "The churn rate is 26.54%."
    assert out[2] == "The churn rate is 26.54% across 7,043 customers."
    assert out[3] == "Churn is 26.54%.\n- 50 customers now"  # yes/no bullet rule is off by default
    assert out[4] == "The user asked."  # everything removed -> original kept
    assert out[5] == "Quoted answer here"
    assert out[6] == "Answer body is long enough"
    strict = {r["aid"]: r["cleaned"] for r in
              TJ.clean_answers(df, keep=["aid"], drop_yes_no_bullets=True).collect()}
    assert strict[3] == "Churn is 26.54%."


def test_json_extraction(spark):
    rows = [(1, '{"intent": "eda", "steps": []}'),
            (2, 'Here:\n```json\n{"intent": "x", "steps": [{"tool": "t"}]}\n```'),
            (3, 'prefix {"intent": "y", "steps": [{"params": {}}]} suffix'),
            (4, "{not json")]
    df = spark.createDataFrame(rows, "jid long, text string")
    out = {r["jid"]: r for r in TJ.extract_json_blocks(df, keep=["jid"]).collect()}
    assert [out[i]["source"] for i in (1, 2, 3, 4)] == ["whole", "fence", "braces", None]
    plans = TJ.extract_json_blocks(df, keep=["jid"]).select("jid", F.col("json").alias("plan_json"))
    chk = {r["jid"]: r for r in QC.plan_checks(plans, keep=["jid"]).collect()}
    assert chk[1]["empty_plan_warning"] and chk[1]["passed"]
    assert chk[2]["passed"]
    assert chk[3]["n_steps_without_tool"] == 1 and not chk[3]["passed"]
    assert not chk[4]["parsed"] and not chk[4]["passed"]


def test_prediction_checks_and_sanity(spark):
    rows = [(1, 0.5, "Medium", "Likely"), (2, 1.5, None, "Likely"), (3, None, "Low", None)]
    df = spark.createDataFrame(rows, "id long, risk_score double, risk_level string, prediction string")
    out = {r["rule"]: r for r in QC.prediction_checks(df).collect()}
    assert out["score_out_of_range"]["violations"] == 1
    assert out["missing_risk_level"]["violations"] == 1 and not out["missing_risk_level"]["passed"]
    assert out["empty_result"]["passed"]
    empty = QC.prediction_checks(df.limit(0))
    e = {r["rule"]: r for r in empty.collect()}
    assert e["empty_result"]["violations"] == 1 and e["empty_result"]["passed"]
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert QC.numeric_sanity(nan).first()["violations"] == 2
