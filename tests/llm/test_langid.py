"""Language identification: held-out accuracy and odd input."""

import random
import zlib

import numpy as np
import pytest

from lapse.llm import langid
from lapse.llm.langid import UNDETERMINED, Hierarchy, features, fit, identify

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    import __spark_entry__ as E

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op4_language_id"](spark, SF).collect()
    assert len(rows) == len(docs) and len({r.doc_id for r in rows}) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == UNDETERMINED) == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
    out = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in out]) >= 0.98


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF}/documents.parquet"), per_lang=100, max_iter=10)


def test_two_levels(model):
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.pair_rows) == {("de", "en"), ("es", "fr")}


def test_odd_rows(spark, model):
    long = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de'").first().text * 300
    rows = [(1, None), (2, ""), (3, "123 ... !"), (4, "der die und das ist nicht"), (4, "der die und das ist nicht"),
            (None, "le la les et que dans"), (5, long), (6, "日本語のテキスト"), (7, "😀 1"), (8, "𝒜𝒷")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS score", "'zz' AS lang_pred", "1 AS `a.b`")
    got = identify(df, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "a.b", "lang_pred", "score"}
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    for i in (1, 2, 3, 7):
        assert pred[i] == (UNDETERMINED, 0.0)
    assert pred[4][0] == pred[5][0] == "de" and pred[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in pred.values()) and pred[6][0] in model.langs and pred[8][0] in model.langs
    assert identify(df.limit(0), model).count() == 0


def test_only_the_text_counts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    a = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    b = identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source"), model).collect()
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in b}


def test_little_to_learn_from(spark):
    def learned(rows):
        return fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    for rows in ([], [(1, "a b", None)], [(1, None, "en")], [(1, "12", "en")]):
        assert learned(rows).predict("some text") == (UNDETERMINED, 0.0)
    assert learned([(1, "a b", "en")]).predict("some text") == ("en", 1.0)
    three = learned([(1, "aaa aab", "xx"), (2, "bbb bbc", "yy"), (3, "ccc ccd", "zz"), (3, "ccc ccd", "zz")])
    assert [three.predict(t)[0] for t in ("aaa", "bbb bbb", "ccc")] == ["xx", "yy", "zz"]


def test_features_of_a_long_text_in_chunks(monkeypatch):
    text = "Das ist ein längerer Text, der in Stücken gelesen wird. " * 50
    whole = features(text)
    monkeypatch.setattr("lapse.llm.langid.CHUNK", 700)
    assert features(text) @ whole > 0.99
    assert features("１２ ") is None and Hierarchy([]).predict("x") == (UNDETERMINED, 0.0)


#: Words of close languages of one script, of the same lengths pair by pair.
CLOSE = {
    ("ru", "uk"): [("что", "або"), ("был", "був"), ("язык", "мова"), ("если", "якщо"), ("город", "місто"), ("может", "треба"),
                   ("только", "тільки"), ("сейчас", "завжди"), ("человек", "людська"), ("хорошая", "зручний")],
    ("hi", "mr"): [("और", "आण"), ("यह", "वय"), ("घर", "मल"), ("नमक", "मठत"), ("शहर", "सरळ"), ("बहन", "बहण"), ("कलम", "लखण"),
                   ("अगर", "जरळ"), ("समझ", "आवड"), ("मगर", "परत")],
}


def test_close_languages_of_one_script(spark):
    rng = random.Random(6)

    def text(pairs, k):
        return " ".join(rng.choice(pairs)[k] for _ in range(30))

    rows = [(lang, text(pairs, k)) for langs, pairs in CLOSE.items() for k, lang in enumerate(langs) for _ in range(40)]
    model = fit(spark.createDataFrame(rows, "lang string, text string"), max_iter=10)
    assert model.families == {"slavic": ["ru", "uk"], "indic": ["hi", "mr"]}
    for langs, pairs in CLOSE.items():
        for k, lang in enumerate(langs):
            assert [model.predict(text(pairs, k))[0] for _ in range(20)] == [lang] * 20


def test_every_letter_has_its_own_code():
    for a, b in (("мова", "язык"), ("\u0915", "\u0916"), ("日", "本"), ("\U00010400", "\U00010401")):
        assert features(a) @ features(b) < 0.9
    assert features("МОВА") @ features("мова") > 0.999
    assert features("\U00010400") @ features("\U00010428") > 0.999


def test_sample_is_by_row(spark):
    """Repeated texts under ids of their own are drawn like other rows, a
    language is never lost, and none has more rows than asked for."""
    rows = [(i, "una frase italiana che si ripete", "it") for i in range(3000)]
    rows += [(5000 + i, f"an english sentence number {i}", "en") for i in range(300)] + [(9000, "solo una", "es")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.lang: r["count"] for r in langid.training_sample(df, "text", "lang", ["doc_id", "text"], 100).groupBy("lang").count().collect()}
    assert got == {"it": 100, "en": 100, "es": 1}
    assert langid.training_sample(df.limit(0), "text", "lang", ["doc_id"], 5).count() == 0
