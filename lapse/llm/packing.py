"""Best-fit-decreasing packing of tokenised documents into fixed windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.bpe import CACHE_WORDS, bpe_ids
from lapse.llm.common import tidy, worker_path

#: Token bytes that a task holds before it packs and emits what it has.
CHUNK_BYTES = 64 << 20
#: sequence_id = partition * 2**32 + number within it.
PART_SHIFT = 32


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..size whose
    nodes count the open windows below, so the tightest window with room for a
    piece is found in log2(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (capacity, window) of the smallest capacity >= need."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[tuple[int, int]], int]:
    """((window, offset) of each length in the order given, windows used).
    Every length is 1..size.  Equal lengths go in the order given."""
    tree, placed, windows = CapacityTree(size), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        if found is None:
            found = size, windows
            windows += 1
        capacity, window = found
        placed[i] = window, size - capacity
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], window)
    return placed, windows


def pack_chunk(docs: list[tuple[object, bytes]], size: int, first: int) -> tuple[list[tuple], int]:
    """Pieces (id, start, ids, doc_tokens, sequence, offset) of one chunk of
    (id, token bytes), and the next free sequence number.  A document longer
    than a window is first cut into full windows; the rests are packed."""
    rows, rests = [], []
    for key, ids in docs:
        n = len(ids) // 4
        full = n // size * size
        for start in range(0, full, size):
            rows.append((key, start, ids[4 * start : 4 * (start + size)], n, first, 0))
            first += 1
        if n > full:
            rests.append((key, full, ids[4 * full :], n))
    placed, windows = best_fit_decreasing([len(r[2]) // 4 for r in rests], size)
    rows += [(*r, first + w, at) for r, (w, at) in zip(rests, placed, strict=True)]
    return rows, first + windows


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024,
                   end_id: int = 0, tokenizer: tuple[str, str, str] | None = None,
                   chunk_bytes: int = CHUNK_BYTES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: id_col, start, length, ids (binary: unsigned 32-bit
    little-endian), doc_tokens, sequence_id, offset.

    A document is its token ids and then ``end_id``; null and empty texts are
    that one id.  Every id lies in exactly one piece and the pieces of a
    sequence follow each other without a gap from offset 0.  Each task packs
    the documents of its own partition in chunks of ``chunk_bytes`` of ids, so
    nothing is shuffled and memory does not grow with the partition; a chunk
    leaves at most a few windows part full.  Repeated rows and repeated or null
    ids are packed like any other row.  Other columns are not read.

    ``tokenizer``: (path of a byte-level BPE file, path of the same vocabulary as
    ranks, its splitting pattern).  ``cache_words`` trades a worker's memory for
    time, nothing else."""
    worker_path(docs.sparkSession)
    files = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = slim.schema[0].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches):
        encode = bpe_ids(*files, cache_words).encode
        nxt = TaskContext.get().partitionId() << PART_SHIFT
        held, held_bytes, id_type = [], 0, None

        def out():
            nonlocal nxt
            rows, nxt = pack_chunk(held, max_tokens, nxt)
            for at in range(0, len(rows), 4096):
                key, start, ids, n, seq, off = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, id_type), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                    names=schema.names)

        for b in batches:
            id_type = b.column(0).type
            texts = b.column(1)
            for i, key in enumerate(b.column(0).to_pylist()):
                held.append((key, encode(texts[i].as_py()) + end))
                held_bytes += len(held[-1][1])
                if held_bytes >= chunk_bytes:
                    yield from out()
                    held, held_bytes = [], 0
        if held:
            yield from out()

    return slim.mapInArrow(tidy(run), schema)
