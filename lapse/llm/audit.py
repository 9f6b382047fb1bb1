"""How document filters interact: every order of a set of filters, step by step.

Each document gets a mask with one bit per filter that it fails.  Documents of
one part (say, one source) with equal masks form a mask cell, a handful of
counts.  A recursive CTE then extends filter prefixes with each letter that
they don't hold yet: a level joins the prefixes with the mask cells of their
part, carries the bits applied so far, and emits the figures of the step."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapse.llm.common import staged, tidy, worker_path

LETTERS = "ABCDE"
#: Bit of the filter that looks at the whole table: a smaller id has the text.
COPY = 16
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character but the first


def text_mask(text: bytes) -> int:
    """Bits 1 to 8, filters A to D, of one text in UTF-8."""
    words = text.split()  # of bytes: at space, tab, line end, vertical tab, form feed, return
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    fails = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * points,
        len(text.translate(None, b"#$%&*|")) < len(text),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _masked(texts: DataFrame) -> DataFrame:
    """(id, part, digest, mask) of (id, part, text)."""
    kinds = {f.name: f.dataType for f in texts.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("part", kinds["part"]),
                           T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])

    def run(batches):
        for b in batches:
            found = [(hashlib.sha256(x).digest(), text_mask(x)) for x in (v.as_py() for v in b.column(2).cast(pa.binary()))]
            digests, masks = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=schema.names)

    return texts.mapInArrow(tidy(run), schema)


def _flags(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, good, toxic), one row per labelled document."""
    def any_one(c):
        return F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))

    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        any_one("quality").alias("good"), any_one("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part with equal masks, and
    how many of them are labelled good or toxic.

    Texts are compared by their SHA-256.  Rows without id have no smaller one
    and no label, and no other row is a copy of them.  Of repeated rows with
    equal id none is a copy of the other."""
    worker_path(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    slim = _masked(docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text")))
    # One narrow row per id and text; written, so that texts are read once and a hot id or text can be split below.
    slim = staged(slim.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    zero = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    nameless = slim.where("id is null").select("part", "mask", "n", *zero)
    flagged = slim.where("id is not null").join(_flags(labels, id_col), F.col("id") == F.col("__id"), "left").select(
        "id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # All rows with one text in one part: how many, and how many of them under their smallest id.
    same = flagged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min(F.struct("id", "n")).alias("least"))
    kin = Window.partitionBy("digest")  # one row per part and label pair
    marked = same.withColumn("least_id", F.min("first").over(kin))
    originals = F.when(F.col("first") == F.col("least_id"), F.col("least.n")).otherwise(F.lit(0))
    split = marked.select("part", "mask", "good", "toxic", F.inline(F.array(
        F.struct(F.lit(0).alias("copy"), originals.alias("n")),
        F.struct(F.lit(COPY).alias("copy"), (F.col("n") - originals).alias("n")))))
    rows = split.select("part", (F.col("mask") + F.col("copy")).alias("mask"), "n", "good", "toxic").unionByName(nameless)
    return rows.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


#: Figures of a step over the mask cells c of a part; p.applied holds the bits
#: before it, f.bit its own.
_STEP = {
    "kept": ("(c.mask & (p.applied | f.bit)) = 0", "n"),
    "removed": ("(c.mask & f.bit) <> 0 AND (c.mask & p.applied) = 0", "n"),
    "redundant": ("(c.mask & f.bit) <> 0 AND (c.mask & p.applied) <> 0", "n"),
    "unique_fails": ("c.mask = f.bit", "n"),
    "good_lost": ("(c.mask & f.bit) <> 0 AND (c.mask & p.applied) = 0", "good"),
    "toxic_lost": ("(c.mask & f.bit) <> 0 AND (c.mask & p.applied) = 0", "toxic"),
}


def enumerate_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, ..., toxic_lost): one row per part, order
    of all letters and step; bit i of a mask is the filter letters[i]."""
    spark = cells.sparkSession
    by_part = staged(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "cells")
    filters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))

    def figure(name: str) -> str:
        test, count = _STEP[name]
        return f"'{name}', aggregate(m.cells, 0L, (a, c) -> a + IF({test}, c.{count}, 0L))"

    figures = ", ".join(map(figure, _STEP))
    trail_type = "array<struct<" + ",".join(f"{x}:bigint" for x in _STEP) + ">>"
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows grow with the parts; the levels end with the letters
    try:
        return staged(spark.sql(f"""
            WITH RECURSIVE prefixes(part, filter_order, applied, level, trail) AS (
              SELECT part, '', 0, 0, CAST(array() AS {trail_type}) FROM {{cells}}
              UNION ALL
              SELECT p.part, concat(p.filter_order, f.letter), p.applied | f.bit, p.level + 1,
                     concat(p.trail, array(named_struct({figures})))
              FROM prefixes p JOIN {{cells}} m ON m.part = p.part
              LATERAL VIEW inline(filter(array({filters}), x -> (p.applied & x.bit) = 0)) f AS letter, bit
              WHERE p.level < {len(letters)})
            SELECT part, filter_order, s.pos + 1 AS step, s.col.*
            FROM prefixes LATERAL VIEW posexplode(trail) s AS pos, col WHERE level = {len(letters)}""", cells=by_part), "orders")
    finally:
        spark.conf.set(limit, before)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """Filters A to E (see ``text_mask`` and ``COPY``) in all their orders.  One
    row per part, filter_order and step (from 1): kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, and shapley, the step's filter's
    ``removed`` summed over all orders.

    Null and empty texts are one text; null parts are the empty string; null
    ids and repeated rows as in ``mask_cells``.  A document is good or toxic if
    any row of ``labels`` (id_col, quality, toxic) says so.  Without documents
    there are no rows.  Other columns, whatever their names, are not read."""
    steps = enumerate_orders(mask_cells(docs, labels, id_col, text_col, part_col))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
