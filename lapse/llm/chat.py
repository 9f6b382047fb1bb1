"""Chat formatting of reply trees, all in column expressions and joins.

Messages answer a parent; a conversation is a tree (or several).  Self-joins
that double the reach each time give every message its depth and the score of
its branch, and list the messages of a path; a path of n messages takes
log2(n) of them.  The best branches of each tree are formatted as one
conversation each.

Template: ``<s>`` role, line end, text, ``</s>``.  The control strings <s>,
</s>, [INST], [/INST], <<SYS>> and <</SYS>> in a text or role get a backslash
after their first character (one more if they have some there already), so
none is left and taking one away gives the text back.  Line ends and
backslashes in a role are written as \\n and \\\\."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapse.llm.arrays import blocks_of, let, piece, running
from lapse.llm.common import drop_staged, is_empty, staged

OPEN, CLOSE = "<s>", "</s>"
#: What may follow the first character of a control string.
_REST = r"(?:/?s>|/?INST\]|</?SYS>>)"
_PLAIN = rf"([<\[])(?=\\*{_REST})"
_ESCAPED = rf"([<\[])\\(?=\\*{_REST})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role_out(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(one_line)


def _role_in(role: Column) -> Column:
    marks = F.replace(unescaped(role), F.lit("\\\\"), F.lit("\\\n"))  # a line end can't stand there yet
    return F.replace(F.replace(marks, F.lit("\\n"), F.lit("\n")), F.lit("\\\n"), F.lit("\\"))


def chain_by_turn(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Plain conversations as trees: each row answers the one before it in
    turn order (null first; ties by role, then text).  (conv, node, parent,
    role, text, score); null role and text are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return plain.withColumn("node", node).select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv, leaf, rank, at, node): the messages, from the root (at 0), of the
    ``top`` branches of each conversation.  A branch runs from a root to a
    leaf; it ranks by the mean score of its messages, then by length, then
    by the smaller leaf.

    ``nodes``: conv, node (unique in conv), parent, score.  A message whose
    parent is missing is a root.  Null scores count 0.  Messages in a circle
    of replies hang from no root and have no path.  Null conversations are
    one conversation."""
    base = staged(nodes.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    there = base.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    # up: the ancestor 2**level above (null beyond the root); total: of the scores below it.
    first = staged(base.join(there, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left")
                   .select("conv", "node", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"),
                           F.col("score").alias("total")), "jump")
    open_rows, closed = first.where("up is not null"), first.where("up is null")
    rooted, levels = [closed], []
    limit = max(1, base.count()).bit_length() + 1  # a circle never ends
    while len(levels) <= limit and not is_empty(open_rows):
        levels.append(open_rows.select("conv", "node", "up"))
        # Conversations without an open row are finished and take no part.
        convs = open_rows.select(F.col("conv").alias("oc")).distinct()
        closed = staged(closed.join(convs, F.col("conv").eqNullSafe(F.col("oc")), "left_semi"), "closed")
        above = open_rows.unionByName(closed).select(
            F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"),
            F.col("total").alias("t2"))
        moved = staged(
            open_rows.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))).select(
                "conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
                (F.col("total") + F.col("t2")).alias("total")), "jump")
        open_rows, arrived = moved.where("up is not null"), moved.where("up is null")
        rooted.append(arrived)
        closed = closed.unionByName(arrived)
    parents = base.where("parent is not null").select(F.col("conv").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = reduce(DataFrame.unionByName, rooted).join(
        parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    paths = staged(chosen.select("conv", F.col("node").alias("leaf"), "rank", "depth", "node", F.lit(0).cast("long").alias("back")),
                   "paths")
    for level in reversed(range(len(levels))):
        # Every message found so far finds the one 2**level above it; from the
        # longest step to the shortest, so that only long branches grow early.
        above = levels[level].select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        more = paths.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
            "conv", "leaf", "rank", "depth", F.col("up").alias("node"), (F.col("back") + 2**level).alias("back"))
        longer = staged(paths.unionByName(more), "paths")
        drop_staged(paths)
        paths = longer
    return paths.select("conv", "leaf", "rank", (F.col("depth") - 1 - F.col("back")).alias("at"), "node")


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans): one conversation per path.
    loss_spans holds the (start, end) code points, end exclusive, of the
    assistant's texts (as escaped) in ``formatted``."""
    n = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), _role_out(F.col("role")).alias("r"),
                     escaped(F.col("text")).alias("t"), (F.col("role") == "assistant").alias("loss"))
    rows = paths.join(n, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turns = rows.groupBy("conv", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct("at", "r", "t", "loss"))).alias("turns"))
    body = F.transform("turns", lambda x: F.concat(F.lit(OPEN), x["r"], F.lit("\n"), x["t"], F.lit(CLOSE)))
    sizes = F.transform("turns", lambda x: F.length(x["r"]) + F.length(x["t"]) + (len(OPEN) + 1 + len(CLOSE)))

    def place(x, before):
        start = before + F.length(x["r"]) + (len(OPEN) + 1)
        return F.struct(start.cast("bigint").alias("start"), (start + F.length(x["t"])).cast("bigint").alias("end"),
                        x["loss"].alias("loss"))

    placed = let(running(sizes, lambda a, b: a + b), lambda before: F.transform("turns", lambda x, i: place(x, before[i])))
    under = F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))
    return turns.select("conv", "leaf", "rank", F.array_join(body, "").alias("formatted"),
                        under.cast("array<struct<start:bigint,end:bigint>>").alias("loss_spans"))


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")

    def turn(x):
        inner = F.substring(x, len(OPEN) + 1, F.length(x))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_role_in(role).alias("role"),
                        unescaped(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    return F.transform(turns, turn)


def loss_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return let(blocks_of(formatted), lambda b: F.transform(loss_spans, lambda s: unescaped(piece(b, s["start"], s["end"]))))


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans) of the ``top`` branches of
    each conversation; see ``best_paths`` and ``format_paths``.

    ``nodes``: conv, node, parent, role, text, score.  Null role and text are
    empty.  A conversation without rows is none."""
    plain = staged(nodes.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}), "chat")
    return format_paths(plain, best_paths(plain, top))
