"""The pipeline's stages on each one's own input."""

import corpus_pipeline as P
import pytest

from lapse.llm.secrets import RULES
from tests.llm.test_secrets import slow as secrets_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_id_keeps_what_has_a_language(stages):
    kept = ids(stages["language_id"])
    for r in stages["documents"].collect():
        assert (r.doc_id in kept) == any(c.isalpha() for c in r.text or "")


def test_one_of_each_group_stays(spark, stages):
    from lapse.llm.simhash import simhash_components

    comp = {r.doc_id: r.component_id for r in simhash_components(stages["language_id"]).collect()}
    assert ids(stages["near_duplicates"]) == set(comp.values())
    assert stages["near_duplicates"].count() == len(set(comp.values()))


def test_contaminated_documents_go(spark, stages):
    from lapse.llm.latent import words

    items = [b" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ids(stages["near_duplicates"]), ids(stages["decontamination"])
    gone = {r.doc_id for r in stages["near_duplicates"].collect() if any(i in b" ".join(words(r.text)) for i in items)}
    assert gone and after == before - gone


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages["decontamination"].collect()}
    changed = 0
    for r in stages["secret_scans"].collect():
        old = before.pop(r.doc_id)
        if secrets_of(old.text):
            changed += 1
            assert not secrets_of(r.text) and "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == old
    assert changed and not before and len(RULES) == 3


def test_every_kept_document_is_packed(spark, stages):
    pieces = stages["packing"].collect()
    assert {r.doc_id for r in pieces} == ids(stages["secret_scans"])
    assert max(r.offset + r.length for r in pieces) <= 1024
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, `a.b` int, fp int, id string"


def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    german = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de'").first().text
    rows = [(1, german, "de"), (1, german, "de"), (2, german, None), (3, None, "de"), (4, "", None), (5, "12 34", "en"),
            (6, "some words " + leak + " more words", "en"), (None, "no id but words enough to be a text", "en"),
            (7, "a token = 0123456789abcdefghij here", None), (8, "the and of to in is " * 30000, "en")]
    rows = [(i, t, lang, None, None if t is None else len(t), "s", 1, 2, "x") for i, t, lang in rows]
    return spark.createDataFrame(rows, ODD)


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    columns = docs.columns
    found = {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        found[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect())
    assert found["language_id"] == [-1, 1, 1, 2, 6, 7, 8]
    assert found["near_duplicates"] == [-1, 1, 6, 7, 8]
    assert found["decontamination"] == found["secret_scans"] == [-1, 1, 7, 8]
    row = docs.where("doc_id = 7").first()
    assert row.text == "a [SECRET] here" and row.n_chars == 15 and row.lang in {"de", "en"} and row.score == "s"
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({(r.doc_id if r.doc_id is not None else -1) for r in pieces}) == [-1, 1, 7, 8]


def test_stages_on_no_rows(spark):
    for _, stage in P.STAGES:
        assert stage(spark, odd(spark).limit(0), SF).count() == 0


def test_contamination_is_dropped_by_id_and_text(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    held = "some words " + leak + " more words"
    rows = [(1, held), (1, "a clean text under the same id"), (None, held), (None, "clean without id"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in P.decontamination(spark, docs, SF).collect()), key=str)
    assert kept == sorted([r for r in rows if r[1] != held], key=str)
