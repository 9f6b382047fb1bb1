"""Corpus preparation: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes the documents that its predecessor kept and returns the
columns of ``documents``; the last one returns the packed pieces."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lapse.llm import langid, secrets  # noqa: E402
from lapse.llm.common import staged  # noqa: E402
from lapse.llm.latent import benchmark_matches  # noqa: E402
from lapse.llm.packing import pack_documents  # noqa: E402
from lapse.llm.queries import language_model  # noqa: E402
from lapse.llm.simhash import keep_one_per_component, simhash_components, text_key  # noqa: E402
from lapse.sources.tables import read_table  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go; a missing lang
    is filled in with the prediction, a given one stays.  Every row is judged
    by itself, repeated ones and those without id too; no rows give no rows,
    and without a labelled row, from which to learn, all rows go."""
    columns = docs.columns
    found = langid.identify(docs, language_model(docs), pred_col="__pred", score_col="__score")
    found = found.where(F.col("__pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "__pred")).select(*(f"`{c}`" for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id (null ids last,
    ties by a hash of the text).  Rows are told apart by id and text; null and
    empty texts are one group, repeated rows another each."""
    return keep_one_per_component(docs, staged(simhash_components(docs), "components"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, verbatim or reworded, go, by id and
    text: another text under the same id stays, and a null id protects nothing.
    Null and empty texts hold no item; without items all rows stay."""
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key")))
    matches = benchmark_matches(keyed, read_table(spark, sf_dir, "benchmark"), id_col="__row")
    found = staged(matches.select("__row.id", "__row.key").distinct().toDF("__id", "__key"), "contaminated")
    same = F.col("__row.id").eqNullSafe(F.col("__id")) & (F.col("__row.key") == F.col("__key"))
    # What goes grows with the documents: they are dealt out by id and text at every size.
    return keyed.join(found.hint("shuffle_hash"), same, "left_anti").drop("__row")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; the secrets in their texts are masked and n_chars
    follows.  Null and empty texts stay as they are."""
    return secrets.redact(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, with their ids, in sequences of at most
    1024 tokens.  A null text is an empty one: the end mark alone.  Every row is
    packed, whatever its id; no rows give no pieces."""
    return pack_documents(docs, cache_words=60_000)  # the workers hold what the other stages left, too


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: A fitted classifier, XXH64 fingerprints, an SVD and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
