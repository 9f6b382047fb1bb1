"""SimHash near-duplicates through a table of distances to reference fingerprints.

The Hamming distance is a metric, so two fingerprints within ``max_bits`` of
each other differ by at most ``max_bits`` in their distance to *every*
reference fingerprint.  The distance table of a fingerprint holds its distance
to

* the zero fingerprint and one mask per block of two bits.  Half the
  difference of such a distance from the first one is the number of set bits
  in the block, a coordinate that a changed bit outside the block leaves alone;
* eight fixed pseudo-random fingerprints, whose distances every changed bit
  moves by one.

Candidates: the blocks form ``max_bits + 4`` groups.  A linked pair changes at
most ``max_bits`` groups, so it agrees on the block coordinates of some four
of them; the pairs of one bucket (table, coordinates of four groups) are
compared.  A pair whose distance rows differ by more than ``max_bits`` in any
coordinate is discarded; the survivors are verified on the fingerprints.

Buckets over ``bucket_cap`` hold clusters of near copies.  Their members skip
the pairwise step and are linked exactly through shared one-bit neighbours:
two fingerprints are within two bits of each other if and only if some third
value is within one bit of both, and that neighbour has at most 65 members.
Work is therefore linear in the number of different fingerprints, whatever the
sizes of the groups.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import drop_staged, is_empty, staged, tidy, worker_path
from lapse.llm.components import connected_components

BLOCK_BITS = 2
SAME_GROUPS = 4
BUCKET_CAP = 64
CHUNK = 1 << 18


def fingerprint(data: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text.  A-Z are lower-cased; words are
    runs of anything but the six ASCII white-space characters; shingles count
    as often as they occur.  Fewer words than a shingle: the whole sequence is
    the shingle.  No word (null, empty, blank): 0."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle_words:
        return digest(b" ".join(words))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
        h = np.fromiter(map(digest, shingles), np.uint64, min(CHUNK, n - at))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_key(text: Column) -> Column:
    """With its id, what names a row: ids may be null or given twice."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("text_key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, text_key, fp, all long but the id): one row per input row.
    text_key is a hash of the text, null and empty ones alike."""
    worker_path(docs.sparkSession)
    slim = docs.select(F.col(id_col), text_key(F.col(text_col)), F.col(text_col).cast("string").cast("binary").alias("__text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words, seed) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "text_key", "fp"])

    schema = slim.select(F.col(id_col), "text_key", F.lit(0).cast("long").alias("fp")).schema
    for field in schema:
        field.nullable = True
    return slim.mapInArrow(tidy(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(max_bits: int) -> list[list[int]]:
    """Reference masks of two bits each, dealt to max_bits + 4 groups."""
    masks = [((1 << BLOCK_BITS) - 1) << s for s in range(0, 64, BLOCK_BITS)]
    groups = max_bits + SAME_GROUPS
    return [masks[g::groups] for g in range(groups)]


def filter_pivots(n: int = 8) -> list[int]:
    """Fixed pseudo-random reference fingerprints."""
    return [xxhash.xxh64_intdigest(f"pivot-{i}".encode()) for i in range(n)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long"))).cast("long")


def distance_table(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, g0..gN block coordinates by group, pivots: eight distances of one
    byte each) for every row of ``fps``."""
    fp = F.col("fp")
    zero = _distance(fp, 0)
    cols = []
    for g, masks in enumerate(_blocks(max_bits)):
        code = F.lit(0).cast("long")
        for m in masks:
            set_bits = F.expr(f"shiftright({BLOCK_BITS} + d0 - bit_count(fp ^ {_signed(m)}L), 1)")
            code = code * (BLOCK_BITS + 1) + set_bits
        cols.append(code.alias(f"g{g}"))
    packed = F.lit(0).cast("long")
    for p in filter_pivots():
        packed = F.shiftleft(packed, 8).bitwiseOR(_distance(fp, p))
    return fps.select("fp", zero.alias("d0")).select("fp", *cols, packed.alias("pivots"))


def _keys(table: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and choice of four groups."""
    groups = _blocks(max_bits)
    width = (BLOCK_BITS + 1) ** max(map(len, groups))
    keys = []
    for t, chosen in enumerate(combinations(range(len(groups)), SAME_GROUPS)):
        key = F.lit(t).cast("long")
        for g in chosen:
            key = key * width + F.col(f"g{g}")
        keys.append(key)
    return table.select(F.explode(F.array(*keys)).alias("key"), "fp", "pivots")


def _within(max_bits: int) -> Column:
    """Keeps a pair if none of its eight coordinates of ``filter_pivots`` (the
    block coordinates agree by their key) differs by more than max_bits and
    then if the fingerprints themselves don't."""
    near = F.lit(True)
    for i in range(8):
        a, b = (F.shiftright(F.col(f"{s}.pivots"), 8 * i).bitwiseAND(F.lit(127)) for s in "ab")
        near = near & (F.abs(a - b) <= max_bits)
    return near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)


def _neighbour_links(fps: DataFrame) -> DataFrame:
    """Links at two bits or fewer through shared one-bit neighbours."""
    hubs = staged(
        fps.select("fp", F.explode(F.expr(
            "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("hub")),
        "hubs",
    )
    low = hubs.groupBy("hub").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hubs.join(low, "hub").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, max_bits: int = 2, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b) links that span every group of fingerprints (column fp, no
    repeats) connected by steps of at most ``max_bits`` bits.

    ``bucket_cap`` only chooses how a bucket is linked, not what is found.  It
    has no effect for a ``max_bits`` other than 2, where the buckets are
    always compared pairwise."""
    keys = staged(_keys(distance_table(fps, max_bits), max_bits), "keys")
    dense = None
    small = keys
    if max_bits == 2:
        big = staged(keys.groupBy("key").count().where(F.col("count") > bucket_cap).select("key"), "big")
        if not is_empty(big):
            small = keys.join(big, "key", "left_anti")
            dense = keys.join(big, "key", "left_semi").select("fp").distinct()
    links = (
        small.alias("a").join(small.alias("b"),
                              (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _within(max_bits))
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    if dense is not None:
        links = links.union(_neighbour_links(dense))
    out = staged(links.distinct(), "near")
    drop_staged(keys)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       max_bits: int = 2, seed: int = 42, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(id_col, fp, component_id, text_key, component): one row per input row.

    component_id is the smallest id reachable by steps of at most ``max_bits``
    differing bits, itself included.  Null, empty and blank texts have
    fingerprint 0 and are linked like any other.  Rows with a null id get a
    fingerprint and component (null if nothing in it has an id).  Repeated rows
    come back as often as they are given.  ``component`` is the same for the
    rows of a component and no others, whereas components that share an id, as
    an id may be given to unlike texts, can share their component_id.  No rows
    give no rows.  Other columns are not read."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle_words, seed), "fps")
    classes = staged(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    links = fingerprint_links(classes.select("fp"), max_bits, bucket_cap)
    roots = staged(connected_components(links, "a", "b").toDF("fp", "root"), "roots")
    lowest = staged(roots.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("low")), "lowest")
    low = staged(roots.join(lowest, "root").select("fp", "low", "root"), "low")
    final = staged(classes.join(low, "fp", "left").select(
        "fp", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "fp").alias("component")), "final")
    return fps.join(final, "fp").select(id_col, "fp", "component_id", "text_key", "component")


def keep_one_per_component(docs: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null
    ids last; of equal ids by a hash of the text).  Rows are told apart by id
    and text, so a row stays whatever becomes of another one under its id."""
    mine = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key")
    groups = staged(components.groupBy(F.col("component").alias("__c")).agg(F.count("*").alias("n"), F.min(mine).alias("keep"))
                    .where("n > 1"), "groups")
    named = F.col(id_col).alias("__id"), F.col("text_key").alias("__key")
    members = components.join(groups, F.col("component") == F.col("__c"))
    stays = mine.eqNullSafe(F.col("keep"))
    gone = staged(members.where(~stays).select(*named).distinct(), "gone")
    again = staged(members.where(stays).groupBy(*named).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    keyed = docs.withColumn("__text_key", text_key(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    # What goes grows with the documents: they are dealt out by id and text at every size.
    kept = keyed.join(gone.hint("shuffle_hash"), same, "left_anti")
    if not is_empty(again):  # the row that stays is given more than once
        first = kept.join(again, same, "left_semi").dropDuplicates([id_col, "__text_key"])
        kept = kept.join(again, same, "left_anti").unionByName(first)
    return kept.drop("__text_key")
