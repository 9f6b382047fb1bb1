"""Running totals and cuts against Python lists and slices."""

import random
import time

from pyspark.sql import functions as F

from lapse.llm import arrays, chat, secrets


def test_running(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-5, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 31, 32, 33, 1024, 1025, 33000])]
    df = spark.createDataFrame(rows, "i int, a array<int>")
    add = arrays.running(F.col("a"), lambda a, b: a + b)
    most = arrays.running(F.col("a"), F.greatest)
    for r in df.select("i", add.alias("s"), most.alias("m")).collect():
        total, top, sums, tops = 0, 0, [], []
        for x in rows[r.i][1]:
            sums.append(total)
            tops.append(top)
            total, top = total + x, max(top, x)
        assert r.s == sums and r.m == tops


def test_pieces(spark):
    rng = random.Random(2)
    size = arrays.BLOCK
    rows = []
    for n in (0, 1, size - 1, size, size + 1, 5 * size + 3):
        text = "".join(rng.choices("abé\U0001f600\n", k=n))
        cuts = [(a, b) for a, b in [(0, n), (0, 0), (n, n), (n // 2, n), (0, n // 2)] + [
            tuple(sorted((rng.randint(0, n), rng.randint(0, n)))) for _ in range(30)] + [(min(size, n), min(2 * size, n))]]
        rows.append((text, cuts))
    df = spark.createDataFrame(rows, "t string, c array<struct<a:bigint,b:bigint>>")
    got = arrays.let(arrays.blocks_of(F.col("t")), lambda b: F.transform("c", lambda x: arrays.piece(b, x["a"], x["b"])))
    for r in df.select("t", "c", got.alias("p")).collect():
        assert r.p == [r.t[x.a : x.b] for x in r.c]


def test_many_secrets_in_one_text(spark):
    """80,000 matches: in seconds, as they are all placed in one go."""
    n = 80_000
    text = ("0123456789abcdef" * 2 + " ") * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.scan(df.withColumn("text", F.lit("f" * 33))).collect()
    began = time.time()
    row = secrets.scan(df).select(F.size("secret_spans").alias("n"), F.element_at("secret_spans", -1).alias("last")).first()
    assert row.n == n and (row["last"].start, row["last"].end) == (33 * (n - 1), 33 * n - 1)
    got = secrets.redact(df).first().text
    assert got == "[SECRET] " * n
    assert time.time() - began < 40


def test_very_long_conversation(spark):
    n = 100_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    nodes = chat.chain_by_turn(turns)
    paths = nodes.select("conv", F.lit(n).cast("long").alias("leaf"), F.lit(1).alias("rank"), (F.col("node") - 1).alias("at"), "node")
    began = time.time()
    out = chat.format_paths(nodes, paths)
    row = out.select(F.size("loss_spans").alias("n"), F.size(chat.parsed_turns(F.col("formatted"))).alias("turns"),
                     F.element_at(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), -1).alias("last")).first()
    assert (row.n, row.turns, row["last"]) == (n // 2, n, f"t{n - 1}")
    assert time.time() - began < 60
