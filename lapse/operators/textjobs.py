"""Text jobs over tables of conversations, questions and answers
(Q5-Q9, Q11).  Everything is column expressions or equi-joins; the only
per-conversation ranking is a row_number filtered to the last k, which
Spark plans with a partial group limit before the shuffle, and turns are paired
chunk by chunk, so a very long conversation never reaches one task whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.functions import text as TX


def route_questions(df: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """Q5/Q6: intent, operation and column per question, plus the id found."""
    return TX.route_steps(df, text, keep)


def plan_json(routed: DataFrame, keep=()) -> DataFrame:
    """The routed question as a plan document {intent, steps: [{tool, params},
    ...]}: the operation and, if there is one, its chart."""
    params = F.struct("column", "customer_id", "col1", "col2", "changes")
    step = F.to_json(F.struct(F.col("operation").alias("tool"), params.alias("params")))
    chart = F.to_json(F.struct(F.lit("generate_chart").alias("tool"),
                               F.struct(F.col("chart").alias("chart_type"), F.col("column")).alias("params")))
    steps = F.concat_ws(",", step, F.when(F.col("chart").isNotNull(), chart))
    return routed.select(*keep, F.concat(F.lit('{"intent":"'), "intent", F.lit('","steps":['), steps, F.lit("]}"))
                         .alias("plan_json"))


def extract_scenarios(df: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """Q7: one column per feature a phrase can change, and the map form."""
    cols = TX.scenario_columns(F.col(text))
    return df.select(*keep, *cols, F.size(TX.scenario_map(F.col(text))).alias("n_changes"))


def pair_turns(conv: DataFrame, first_role: str = "user", second_role: str = "assistant",
               chunk_turns: int = 1000) -> DataFrame:
    """Each ``first_role`` turn with the next ``second_role`` turn, whatever
    other roles stand between; unanswered (null) if another ``first_role``
    turn comes first.  Turns are looked at in chunks of a conversation, whose
    ends are matched with the beginning of the next chunk, so a very long
    conversation is spread over many tasks."""
    rows = conv.where(F.col("role").isin(first_role, second_role)).select(
        "conv_id", "turn", "role", "text", F.floor(F.col("turn") / chunk_turns).alias("_chunk"))
    within = Window.partitionBy("conv_id", "_chunk").orderBy("turn", "role")
    nxt = F.struct("turn", "role", "text")
    rows = rows.withColumn("_next", F.lead(nxt).over(within))
    heads = rows.groupBy("conv_id", "_chunk").agg(F.min(nxt).alias("_head")).withColumn(
        "_later", F.lead("_head").over(Window.partitionBy("conv_id").orderBy("_chunk"))).drop("_head")
    asked = rows.where(F.col("role") == first_role).join(heads, ["conv_id", "_chunk"])
    after = F.coalesce("_next", "_later")
    return asked.select("conv_id", "turn", F.col("text").alias("question"),
                        F.when(after["role"] == second_role, after["text"]).alias("answer"))


def recent_context(conv: DataFrame, last: int = 3, answer_chars: int = 200) -> DataFrame:
    """Q8: per conversation, the last ``last`` question/answer pairs as
    'Q: ...\\nA: <first 200 chars>...' blocks, oldest first, blank-line
    separated; 'No prior conversation.' when there is none."""
    pairs = pair_turns(conv).where(F.col("answer").isNotNull())
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    block = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "),
                     F.substring(F.col("answer"), 1, answer_chars), F.lit("..."))
    ctx = recent.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("_blocks"))
    convs = conv.select("conv_id").distinct()
    out = convs.join(ctx, "conv_id", "left")
    return out.select(
        "conv_id",
        F.coalesce(F.size("_blocks"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.array_join(F.transform("_blocks", lambda s: s["b"]), "\n\n"),
                   F.lit("No prior conversation.")).alias("context"),
    )


def clean_answers(df: DataFrame, text: str = "text", keep=(), drop_yes_no_bullets: bool = False) -> DataFrame:
    """Q9 over a table of generated answers."""
    out = TX.clean_answer_steps(df.select(*keep, text), text, "cleaned",
                                drop_yes_no_bullets=drop_yes_no_bullets)
    return out.select(*keep, "cleaned")


def extract_json_blocks(df: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """Q11: the parsed document (as JSON text) and where it was found."""
    v, source = TX.extract_json(F.col(text))
    return df.select(*keep, source.alias("source"), F.to_json(v).alias("json"))
