"""Secret scans against Python's regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lapse.llm.secrets import RULES, Rule, candidates, build_index, redact, scan, spans_text
from lapse.llm.trigrams import trigram_query

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def slow(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def texts():
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "x.y", "AKIA",
             "ABCDEFGH12345678", "AKIAAKIA", "0123456789abcdef", "deadbeef" * 3, "é", "😀", "\n", "G", "tok", "ſecret", "toKen"]
    out = ["", None, "token=secret = abcdefgh1", "password: 'hunter2hunter2'", "AKIA" + "A" * 12, "AKIA" + "A" * 11,
           "f" * 32, "f" * 31, "f" * 100, "token==abcdefgh", "x" * 50000 + "secret=abcdefghijkl" + "y " * 50000]
    return out + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(600)]


def test_scan(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"secret_spans": F.lit(1), "rules": F.lit("x"), "id": F.lit(0)})
    got = {r.doc_id: r.s for r in scan(df).select("doc_id", spans_text(F.col("secret_spans")).alias("s")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == ",".join(slow(t)), t


def test_query_columns(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = E.queries()["op5_secret_scan"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = slow(docs[r.doc_id])
        assert r.spans == ",".join(spans) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in spans) for k in BASE]


def test_odd_rows(spark):
    hit = "my password = abcdefghij"
    rows = [(1, hit), (1, hit), (1, "nothing"), (None, hit), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "", len(r.secret_spans)) for r in scan(df).collect())
    assert got == sorted((str(i), t or "", int(t == hit)) for i, t in rows)
    assert scan(df.limit(0)).count() == 0


def test_redact(spark):
    text = "a token = 0123456789abcdef0123456789abcdef tail é " + "f" * 40
    rows = [(1, text, 90), (2, "clean", 5), (3, None, None), (4, "f" * 33 + "secret=abcdefgh", 48)]
    got = {r.doc_id: (r.text, r.n_chars) for r in redact(
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), length_col="n_chars").collect()}
    assert got[1] == ("a [SECRET] tail é [SECRET]", 26)
    assert got[2] == ("clean", 5) and got[3] == (None, None) and got[4] == ("[SECRET]", 8)


@pytest.mark.parametrize("pattern,query", [
    ("abcd", [{"abc", "bcd"}]), ("abc|xyz", [{"abc"}, {"xyz"}]), ("ab.cd", None), ("abc.*def", [{"abc", "def"}]),
    ("(abc)?xyz", [{"xyz"}]), ("(abc){2,}", [{"abc", "bca", "cab"}]), ("[Aa][Bb][Cc]", [{"abc"}]), ("[a-z]{5}", None),
    ("abc(x|y)", [{"abc", "bcx"}, {"abc", "bcy"}]), (r"^abc\b", [{"abc"}]), ("a+bcd", [{"bcd"}])])
def test_trigram_queries(pattern, query):
    got = trigram_query(pattern)
    assert (None if got is None else sorted(map(sorted, got))) == (None if query is None else sorted(map(sorted, query)))


def test_only_candidates_are_verified(spark):
    """The postings rule out what lacks a trigram, and nothing that matches."""
    rules = (*RULES, Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"))
    df = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY-----"), (2, "private"), (3, "my PASSWORD is"), (4, "akIA")],
                               "doc_id long, text string")
    got = {r.id: set(r.rules) for r in candidates(build_index(df, rules), rules).collect()}
    assert got == {1: {"pem"}, 3: {"assign"}, 4: {"access"}}
    assert [len(r.secret_spans) for r in scan(df, rules).orderBy("doc_id").collect()] == [1, 0, 0, 0]
