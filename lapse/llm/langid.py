"""Hierarchical language identification.

A linear classifier first tells the language family, then linear support
vector machines, one for each pair of languages of the family, vote on the
language.  Features are counts of hashed runs of one to three letters (word
ends are a character of their own), square-rooted and scaled to unit length;
the classifiers are Spark ML ``LinearSVC`` models fitted on a bounded sample
of the labelled rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapse.llm.common import staged, tidy, worker_path

DIMS = 2048
#: Labelled rows per language that the classifiers are fitted on, at most.
TRAIN_ROWS = 800
UNDETERMINED = "und"
CHUNK = 1 << 20
#: Languages without an entry are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "uralic": "et fi hu".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if base in langs), lang)


def _code(point: int) -> int:
    """The code point of the lower-cased letter; 0 for all else."""
    ch = chr(point)
    return ord(ch.lower()[0]) if ch.isalpha() else 0


def _folded() -> np.ndarray:
    """Code point of the basic plane -> code of its letter."""
    return np.array([_code(c) for c in range(0x10000)], np.uint32)


_TABLE = None


def features(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Unit-length feature vector of a whole text; None without a letter."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _folded()
    if not text:
        return None
    counts, seen = np.zeros(dims, np.int64), False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), "<u4")
        codes = _TABLE[np.minimum(points, 0xFFFF)]
        if points.max() > 0xFFFF:
            for p in np.unique(points[points > 0xFFFF]):
                codes[points == p] = _code(int(p))
        seen = seen or bool(codes.any())
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]  # one space between words
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        for h in (one[codes > 0], two, three):
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(33 - dims.bit_length()), minlength=dims)
    if not seen:
        return None
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


class Hierarchy:
    """Fitted weights: one row (the last entry is the offset) per family
    against the others and per pair of languages of a family."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(langs)
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(self.families)
        self.family_rows: dict[str, np.ndarray] = {}
        self.pair_rows: dict[tuple[str, str], np.ndarray] = {}

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.langs else None
        if x is None:
            return UNDETERMINED, 0.0
        x = np.append(x, 1.0)
        family, score = self.names[0], 1.0
        if len(self.names) > 1:
            margins = {f: float(self.family_rows[f] @ x) for f in self.names}
            family = max(self.names, key=lambda f: margins[f])
            rest = max(m for f, m in margins.items() if f != family)
            score = _squash(margins[family] - rest)
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], score
        votes, margin = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            m = float(self.pair_rows[a, b] @ x)
            votes[a if m > 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        lang = max(langs, key=lambda k: (votes[k], margin[k]))
        return lang, score * _squash(2 * margin[lang] / (len(langs) - 1))


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def _feature_rows(rows: DataFrame) -> DataFrame:
    """(lang, x array<float>) of (lang, text) rows that have a letter."""

    def run(batches):
        for b in batches:
            langs, xs = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = features(text)
                if x is not None:
                    langs.append(lang)
                    xs.append(x.astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(xs, pa.list_(pa.float32()))], names=["lang", "x"])

    return rows.mapInArrow(tidy(run), "lang string, x array<float>")


def training_sample(docs: DataFrame, text_col: str, lang_col: str, salt: list[str], per_lang: int) -> DataFrame:
    """(lang, text): of each language the ``per_lang`` rows with the smallest
    hashes of the columns ``salt``, all if there are fewer.  Rows that agree
    in language and hash count once."""
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"),
                           F.xxhash64(*salt).alias("h")).where("lang is not null and text is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = labelled.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_lang)
    last = staged(least.groupBy("lang").agg(F.max("h").alias("last")), "sample")  # one row per language
    return labelled.join(last, "lang").where("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", salt: list[str] | None = None,
        per_lang: int = TRAIN_ROWS, max_iter: int = 25, reg: float = 1e-4) -> Hierarchy:
    """Fit on a sample of the rows with text and language, at most ``per_lang``
    of each language, drawn by a hash of the columns ``salt`` (a key of the
    rows; the text and language alone if none is given).  No such row: a model
    that answers ``und``."""
    worker_path(docs.sparkSession)
    sample = training_sample(docs, text_col, lang_col, salt or [text_col], per_lang)
    rows = staged(_feature_rows(sample), "langid").coalesce(8)  # a bounded sample
    model = Hierarchy([r["lang"] for r in rows.select("lang").distinct().collect()])
    ready = rows.select("lang", array_to_vector("x").alias("features")).persist()

    def svm(data: DataFrame, positive) -> np.ndarray:
        fitted = LinearSVC(maxIter=max_iter, regParam=reg, standardization=False, aggregationDepth=2).fit(
            data.withColumn("label", positive.cast("double")))
        return np.append(fitted.coefficients.toArray(), fitted.intercept)

    if len(model.names) == 2:
        a, b = model.names
        row = svm(ready, F.col("lang").isin(model.families[a]))
        model.family_rows = {a: row, b: -row}
    elif len(model.names) > 2:
        for f in model.names:
            model.family_rows[f] = svm(ready, F.col("lang").isin(model.families[f]))
    for langs in model.families.values():
        for a, b in combinations(langs, 2):
            model.pair_rows[a, b] = svm(ready.where(F.col("lang").isin(a, b)), F.col("lang") == a)
    ready.unpersist()
    return model


def identify(docs: DataFrame, model: Hierarchy, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col`` appended (columns of those
    names are replaced).  The prediction is a learned language, or ``und``
    (score 0) if the text is null, empty or has no letter, or nothing was
    learned.  The score is 0 to 1.  Every row is judged by its whole text
    alone; rows stay as they are."""
    worker_path(docs.sparkSession)
    kept = docs.drop(pred_col, score_col)
    n = len(kept.columns)
    plain = kept.withColumn("__text", F.col(text_col).cast("string")).toDF(*(f"c{i}" for i in range(n + 1)))  # any names
    schema = T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(n)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=schema.names)

    return plain.mapInArrow(tidy(run), schema)
