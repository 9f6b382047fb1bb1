"""Reply trees and the chat template."""

import random

import pytest
from pyspark.sql import functions as F

from lapse.llm import chat

SCHEMA = "conv long, node long, parent long, role string, text string, score double"


def slow_paths(rows, top):
    """Root-to-leaf paths by walking up, ranked."""
    by = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if r[2] is not None}
    found: dict = {}
    for (conv, node), _ in by.items():
        if (conv, node) in parents:
            continue
        path, at, seen = [], (conv, node), set()
        while at in by and at not in seen:
            seen.add(at)
            path.append(at[1])
            at = (conv, by[at][2])
        if at in seen:
            continue
        scores = [by[conv, n][5] or 0.0 for n in path]
        found.setdefault(conv, []).append((-sum(scores) / len(path), -len(path), node, path[::-1]))
    return {(c, p[2], i): p[3] for c, ps in found.items() for i, p in enumerate(sorted(ps)[:top], 1)}


@pytest.mark.parametrize("top", [1, 3])
def test_paths(spark, top):
    rng = random.Random(top)
    rows = []
    for conv in range(12):
        for node in range(rng.randint(1, 40)):
            parent = rng.choice([None, node - 1, node - 1, rng.randrange(node), 999]) if node else None
            rows.append((conv, node, parent, rng.choice(["user", "assistant"]), f"t{node}", rng.choice([0.0, 0.5, 1.0, None])))
    rows += [(50, 1, 2, "user", "circle", 1.0), (50, 2, 1, "user", "circle", 1.0), (50, 3, 2, "user", "off the circle", 1.0)]
    rows += [(60, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in chat.best_paths(df, top).orderBy("at").collect():
        assert r["at"] == len(got.setdefault((r.conv, r.leaf, r.rank), []))
        got[r.conv, r.leaf, r.rank].append(r.node)
    assert got == slow_paths(rows, top)


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def texts():
    rng = random.Random(8)
    parts = [*CONTROL, "\\", "<", "[", ">", "]", "/", "s", "INST", "<\\s>", "[\\\\/INST]", "<<", "SYS>>", "é😀", "\n", "$1", " "]
    return ["", "</s>[INST] ok [/INST]", "plain"] + ["".join(rng.choices(parts, k=rng.randint(1, 15))) for _ in range(500)]


def test_escape_is_reversible_and_complete(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    rows = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"),
                     chat._role_in(chat._role_out(F.col("t"))).alias("r"), chat._role_out(F.col("t")).alias("o")).collect()
    for r in rows:
        assert r.u == r.t and r.r == r.t
        assert not any(c in r.e or c in r.o for c in CONTROL) and "\n" not in r.o


def test_round_trip(spark):
    rng = random.Random(2)
    many = texts()
    convs = {c: [(rng.choice(["user", "assistant", "system", "a\nb\\n"]), rng.choice(many)) for _ in range(rng.randint(1, 9))] for c in range(80)}
    convs[500] = [("assistant", "x" * 200000), ("user", "")]
    rows = [(c, i * 3, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.format_trees(chat.chain_by_turn(df)).select(
        "*", chat.parsed_turns(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.conv: [(t.role, t.text) for t in r.turns] for r in out} == convs
    for r in out:
        assert r.loss == [t for role, t in convs[r.conv] if role == "assistant"]
        assert all(r.formatted[s.end:].startswith("</s>") for s in r.loss_spans)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "of no conversation"), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"conv": F.lit("x"), "node": F.lit(1), "score": F.lit("y")})
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.format_trees(chat.chain_by_turn(df)).select(
        "conv", chat.parsed_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("", "first"), ("user", ""), ("user", "")], None: [("assistant", "of no conversation")], 2: [("assistant", "")]}
    assert chat.format_trees(chat.chain_by_turn(df.limit(0))).count() == 0
