"""Benchmark decontamination: planted passages, clean documents, odd input."""

import random

import numpy as np
import pytest

from lapse.llm.latent import (_general_words, answer_words, benchmark_matches, lcs_length, right_vectors, window_size, words)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y and y else max(prev[j + 1], row[-1]))
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(1, 6) for _ in range(rng.randint(0, 40))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 80))]
        assert lcs_length(a, b) == slow_lcs(a, b)


def test_words_and_windows():
    assert words("A—b, C_d’e 1x Ü") == [b"a", b"b", b"c", b"d", b"e", b"1x", "ü".encode()]
    assert words(None) == [] and answer_words("One two. Three.", None) == [b"one", b"two", b"three"]
    assert [window_size(n) for n in (1, 8, 9, 13, 17, 25, 33, 50, 65)] == [8, 8, 12, 16, 24, 32, 48, 64, 96]


def test_right_vectors_are_those_of_an_svd():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 40)) * 3 + 0.01 * rng.standard_normal((300, 40))
    w = rng.standard_normal((40, 14))
    v = right_vectors(w, a.T @ (a @ w), 6)
    exact = np.linalg.svd(a, full_matrices=False)[2][:6]
    assert np.linalg.svd(exact @ v)[1].min() > 0.999


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    made = ["".join(rng.choices(["ba", "ti", "ko", "ren", "sul", "mi", "dor"], k=rng.randint(2, 4))) for _ in range(1500)]
    common = ["the", "of", "and", "to", "in", "is"]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.35 else rng.choice(made) for _ in range(n)]

    items = [(i, prose(rng.randint(15, 60))) for i in range(20)]
    docs, planted = [], set()
    for d in range(200):
        text = prose(rng.randint(20, 400))
        if d < 40:
            item, ws = items[d % 20]
            ws = list(ws)
            if d >= 20:  # reworded: a tenth of the words changed, order kept
                for k in rng.sample(range(len(ws)), len(ws) // 10):
                    ws[k] = rng.choice(made)
            at = rng.randint(0, len(text))
            text[at:at] = ws
            planted.add((d, item))
        docs.append((d, " ".join(text).capitalize() + "."))
    return docs, [(i, ", ".join(ws) + "!") for i, ws in items], planted


def test_planted(spark, corpus):
    docs, items, planted = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == planted
    in_blocks = benchmark_matches(d, b, item_block=6)
    assert {(r.doc_id, r.item_id) for r in in_blocks.collect()} == planted


def test_answers(spark, corpus):
    """A reworded question counts if the answer is there, and not without it."""
    rng = random.Random(9)
    background, items, _ = corpus
    text = items[0][1].replace("!", "").split(", ")
    half = [w if k % 5 < 3 else f"other{k}" for k, w in enumerate(text)]  # 60 % of the words
    answer = "forty two purple lanterns"
    docs = [(1, " ".join(half) + " " + answer), (2, " ".join(half)), (3, " ".join(rng.sample(text, len(text))))]
    docs += [(100 + i, t) for i, t in background[40:]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(text) + " " + answer, answer)], "item_id long, text string, answer string")
    assert {r.doc_id for r in benchmark_matches(d, b, answer_col="answer").collect()} == {1}


def test_odd_rows(spark, corpus):
    _, items, _ = corpus
    long = "filler words without sense " * 20000 + items[3][1]
    docs = [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (None, items[1][1]), (4, long), (5, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS ids", "2 AS cosine")
    b = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (93, items[0][1])],
                              "item_id long, text string").selectExpr("*", "1 AS doc_id", "'y' AS block", "3 AS n_chars")
    got = {(r.doc_id, r.item_id) for r in benchmark_matches(d, b).collect()}
    assert got == {(3, 0), (3, 93), (None, 1), (4, 3)}
    for a, c in ((d.limit(0), b), (d, b.limit(0)), (d.where("doc_id < 3"), b)):
        assert benchmark_matches(a, c).count() == 0


def test_query_finds_every_copied_item(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, ws in docs.items() for i, item in items.items()
            if b" " + b" ".join(item) + b" " in b" " + b" ".join(ws) + b" "}
    assert want
    got = {(r.doc_id, r.item_id): r for r in E.queries()["op9_latent_decontamination"](spark, sf).collect()}
    assert want <= set(got)
    for (d, i), r in got.items():
        assert slow_lcs([hash(w) | 1 for w in items[i]], [hash(w) | 1 for w in docs[d][r.first_word:r.last_word]]) >= 0.5 * len(items[i])


def test_one_rule_for_all_texts():
    for passage in ("हिन्दी में एक वाक्य यहाँ लिखा है", "cafe\u0301 au lait, déjà vu", "ein、zwei，drei", "今天天气很好", "ภาษาไทย"):
        assert words("x “—” \u00a0" + passage) == [b"x", *words(passage)]
    assert words("हिन्दी में") == ["हिन्दी".encode(), "में".encode()]
    assert words("cafe\u0301") == words("café") == ["café".encode()]
    assert words("GPT模型，好") == [b"gpt", *(c.encode() for c in "模型好")]
    assert words("ein，zwei") == [b"ein", b"zwei"]
    assert words("déjà 😀 vu \U00020000") == ["déjà".encode(), b"vu", "\U00020000".encode()]
    for c in range(0x300):  # the shorter way
        text = f"a{chr(c)}b é{chr(c)}"
        assert words(text) == _general_words(text.lower())


def test_leaks_in_any_script_and_of_few_words(spark, corpus):
    background, items, _ = corpus
    hindi = "भारत की राजधानी नई दिल्ली है और यहाँ की जनसंख्या बहुत अधिक है"
    chinese = "水在标准大气压下的沸点是一百摄氏度"
    leaks = [(1, "“quoted” — " + hindi), (2, "前言：" + chinese + "。后记"), (3, "Who wrote Faust? Goethe did."),
             (4, "wrote who Faust"), (5, "who wrote"), (6, "Faust – who wrote faust!"), (7, "the cafe\u0301 noir")]
    d = spark.createDataFrame([*((100 + i, t) for i, t in background[40:]), *leaks], "doc_id long, text string")
    b = spark.createDataFrame([*items, (70, hindi), (71, chinese), (72, "Who wrote Faust?"), (73, "café noir"), (74, "?"),
                               (75, "who wrote faust")], "item_id long, text string")
    want = {(1, 70), (2, 71), (3, 72), (3, 75), (6, 72), (6, 75), (7, 73)}
    got = benchmark_matches(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(r.first_word, r.last_word) for r in got if r.item_id == 72} == {(0, 3), (1, 4)}
    short = benchmark_matches(d, b.where("item_id > 71")).collect()
    assert {(r.doc_id, r.item_id) for r in short} == {x for x in want if x[1] > 71}
