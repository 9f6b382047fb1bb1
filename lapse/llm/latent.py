"""Benchmark decontamination by latent semantic retrieval.

1. Every text becomes a sequence of ids of the benchmark's words (0: another
   word) and is staged in that form; a word that no benchmark item has can
   neither add to a match nor to a longest common subsequence.
2. TF-IDF statistics come from all passages (``passage_words`` words each) of
   all documents.
3. A randomised SVD of the TF-IDF passage matrix A (the items are added to it
   as passages of a fixed share of its weight): each task adds up its part
   of A'(A W) for a fixed random W, Spark sums the parts term by term, and the
   leading right singular vectors follow from that sketch (Nystroem).
4. Windows about as long as an item slide over every document; windows whose
   latent cosine with an item reaches ``min_cosine`` are candidates.
5. A candidate must hold enough of the item's words at all, and then pass the
   longest-common-subsequence check: at least ``min_lcs`` of the item's words
   in order, or, for a paraphrase, at least ``paraphrase_lcs`` of them
   together with ``answer_share`` of the answer's.
6. Items of fewer than ``min_words`` words have too few for a window; they are
   found where a document holds exactly their words one after another.

The benchmark is taken in blocks of ``ITEM_BLOCK`` items, so what is sent to
the tasks and kept on the driver (terms x rank) is bounded by that block."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lapse.llm.common import drop_staged, staged, tidy, worker_path

ITEM_BLOCK = 2048
RANK, OVERSAMPLE, IDF_POWER = 32, 8, 3
ITEM_SHARE = 0.1
STEP = 4  # windows begin at multiples of this
#: Words of a chunk of documents.
TOKENS = 1 << 19
CHUNK = 3 << 13  # a multiple of every stride up to 8192

_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: UTF-8 of all but ASCII and the letters from U+00C0 to U+027F, which are all
#: composed letters except U+00D7 and U+00F7.
_BEYOND = re.compile(rb"[\xc2\xca-\xff]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: First and last letters of scripts that put no space between words (Han and
#: kana, Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, Yi).
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
            (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
            (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)]


def _ranges(points) -> str:
    """The inside of a character class."""
    out, first, last = [], None, None
    for c in [*points, None]:
        if first is not None and c != last + 1:
            out.append(f"\\U{first:08x}-\\U{last:08x}")
            first = None
        if first is None:
            first = c
        last = c
    return "".join(out)


@lru_cache(maxsize=2)
def _word_pattern(planes: bool) -> re.Pattern:
    """A run of letters and digits with their marks, or one character of an
    unspaced script with its marks; a smaller class, tried faster, without the
    planes beyond the basic one."""
    letters = [c for c in range(0x40000 if planes else 0x10000) if chr(c).isalnum()]
    marks = _ranges(c for c in range(0xE01F0 if planes else 0x10000) if unicodedata.category(chr(c))[0] == "M")
    apart = {c for a, z in UNSPACED for c in range(a, z + 1)}
    spaced, unspaced = _ranges(c for c in letters if c not in apart), _ranges(c for c in letters if c in apart)
    return re.compile(f"[{spaced}][{spaced}{marks}]*|[{unspaced}][{marks}]*")


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits with their marks, composed;
    scripts without spaces by characters.  One rule for all texts: ASCII and
    Latin letters alone take a shorter way to the same words."""
    if not text:
        return []
    low = text.lower()
    data = low.encode("utf-8", "surrogatepass")
    if low.isascii() or not (_BEYOND.search(data) or b"\xc3\x97" in data or b"\xc3\xb7" in data):
        return data.translate(_KEEP).split()
    return _general_words(low)


def _general_words(low: str) -> list[bytes]:
    low = unicodedata.normalize("NFC", low)
    planes = False
    if _ASTRAL.search(low):
        low = _ASTRAL.sub(lambda m: m[0] if m[0].isalnum() or unicodedata.category(m[0])[0] == "M" else " ", low)
        planes = _ASTRAL.search(low) is not None
    return [w.encode() for w in _word_pattern(planes).findall(low)]


def answer_words(text: str | None, answer: str | None) -> list[bytes]:
    """Words of the given answer; without one, of the item's last sentence
    (its last eight words if that is shorter)."""
    if answer:
        return words(answer)
    last = words(re.split(r"[.!?]+\s+", (text or "").strip())[-1])
    return last if len(last) >= 8 else words(text)[-8:]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``.
    Zeros of ``b`` (unknown words) match nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x) if x else None
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def window_size(n: int) -> int:
    """The smallest of 8, 12, 16, 24, 32, 48, 64, ... that holds n words."""
    size = 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return size


def stride_of(size: int) -> int:
    """A quarter to a third of the window, a multiple of STEP."""
    return max(STEP, -(-size // 4 // STEP) * STEP)


class Runs:
    """Items of few words, found as exact runs: the trie of their words is
    walked from all words of a chunk of documents at once."""

    def __init__(self, items: list[tuple], terms: int):
        self.ids, self.terms = [x[0] for x in items], terms
        self.shares = [lcs_length(a, ws) / len(a) if a else 0.0 for _, ws, a in items]
        self.longest = max((len(ws) for _, ws, _ in items), default=0)
        edges: dict[int, int] = {}
        self.at: dict[int, list[int]] = {}
        for k, (_, ws, _) in enumerate(items):
            node = 0
            for w in ws:
                node = edges.setdefault(node * terms + w, len(edges) + 1)
            self.at.setdefault(node, []).append(k)
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.ends = np.zeros(len(edges) + 1, bool)
        self.ends[list(self.at)] = True

    def matches(self, buffers: list[np.ndarray]):
        """(document, item, cosine, lcs, answer share, first, last) of the
        first run of each document and item."""
        if not self.ids or not buffers:
            return
        stream = np.concatenate([y for x in buffers for y in (x, [0])]).astype(np.int64)  # 0 ends a document
        ends = np.cumsum([len(x) + 1 for x in buffers])
        pos = np.flatnonzero(stream)
        node = np.zeros(len(pos), np.int64)
        for step in range(self.longest):
            key = node * self.terms + stream[pos + step]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            pos, node = pos[on], self.to[i[on]]
            p, n = pos[self.ends[node]], node[self.ends[node]]
            doc = np.searchsorted(ends, p, side="right")
            for f in np.unique(doc * len(self.ends) + n, return_index=True)[1]:
                d = int(doc[f])
                first = int(p[f]) - int(ends[d]) + len(buffers[d]) + 1
                for k in self.at[int(n[f])]:
                    yield d, k, 1.0, 1.0, self.shares[k], first, first + step + 1


class Items:
    """One block of benchmark items in the form that the tasks use."""

    def __init__(self, rows: list, min_words: int):
        lists = [(r.item, words(r.text), answer_words(r.text, r.answer)) for r in rows]
        short = [x for x in lists if 0 < len(x[1]) < min_words]
        lists = [x for x in lists if len(x[1]) >= min_words]
        known = sorted({w for _, ws, a in lists for w in ws + a})
        more = sorted({w for _, ws, a in short for w in ws + a}.difference(known))  # words of short items alone come last
        self.vocabulary = {w: i for i, w in enumerate(known + more, 1)}
        self.ids = [x[0] for x in lists]
        self.words = [[self.vocabulary[w] for w in ws] for _, ws, _ in lists]
        self.answers = [[self.vocabulary[w] for w in a] for _, _, a in lists]
        self.terms = len(known) + 1
        self.dtype = np.dtype("<u2" if len(self.vocabulary) + 1 < 1 << 16 else "<u4")
        self.runs = Runs([(item, *([self.vocabulary[w] for w in x] for x in (ws, a))) for item, ws, a in short],
                         len(self.vocabulary) + 1)

    def long_parts(self, buffers: list[np.ndarray]) -> list[np.ndarray]:
        """Encoded documents without the words that only short items have."""
        if len(self.vocabulary) < self.terms:
            return buffers
        return [np.where(x < self.terms, x, 0).astype(self.dtype) for x in buffers]

    def has(self) -> np.ndarray:
        """Bits: does the item have the term?"""
        bits = np.zeros((len(self.ids), self.terms), bool)
        for i, ws in enumerate(self.words):
            bits[i, ws] = True
        return np.packbits(bits, axis=1, bitorder="little")


def encode_documents(docs: DataFrame, id_col: str, text_col: str, items: Items) -> DataFrame:
    """(id_col, ids binary): the benchmark's words in every whole text."""
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    vocabulary, dtype = items.vocabulary, items.dtype

    def run(batches):
        get = vocabulary.get
        for b in batches:
            out = []
            for t in b.column(1):
                ws = words(t.as_py())
                out.append(np.fromiter(map(get, ws, repeat(0)), dtype, len(ws)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "ids"])

    return slim.mapInArrow(tidy(run), T.StructType([T.StructField(id_col, slim.schema[0].dataType),
                                              T.StructField("ids", T.BinaryType())]))


def _chunks(column, dtype):
    """Lists of encoded documents of at most about TOKENS words (a longer
    document comes alone)."""
    held, size = [], 0
    for x in column:
        ids = np.frombuffer(x.as_buffer(), dtype)
        if held and size + len(ids) > TOKENS:
            yield held
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    if held:
        yield held


def _passages(buffers: list[np.ndarray], terms: int, passage_words: int):
    """(passage, term, count) of the passages that have a known term, by
    passage, and the number of all passages."""
    lengths = np.array([len(x) for x in buffers])
    per_doc = -(-lengths // passage_words)
    first = np.repeat(np.cumsum(per_doc) - per_doc, lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids = np.concatenate(buffers).astype(np.int64)
    passage = first + within // passage_words
    known = ids > 0
    key, counts = np.unique(passage[known] * terms + ids[known], return_counts=True)
    return (key // terms, key % terms, counts), int(per_doc.sum())


def term_weights(encoded: DataFrame, items: Items, passage_words: int) -> tuple[np.ndarray, float]:
    """Inverse passage frequency of each term over all documents, to the power
    IDF_POWER: rare words tell passages apart, and a steep weight keeps the
    few latent dimensions for them.  Also the number of passages."""
    terms, dtype = items.terms, items.dtype

    def run(batches):
        df = np.zeros(terms, np.int64)
        for b in batches:
            for docs in _chunks(b.column("ids"), dtype):
                found, n = _passages(items.long_parts(docs), terms, passage_words)
                df[0] += n
                df += np.bincount(found[1], minlength=terms)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    counts = encoded.select("ids").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(terms)
    for r in counts.collect():  # at most one row per term of the block
        df[r.term] = r.n
    weights = (np.log((df[0] + 1) / (df + 1)) + 0.1) ** IDF_POWER
    weights[0] = 0
    return weights, df[0]


def sketch(encoded: DataFrame, items: Items, weights: np.ndarray, passage_words: int, width: int, seed: int):
    """(W, A'AW) for the unit-length TF-IDF rows A of all passages."""
    terms, dtype = items.terms, items.dtype
    w = np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32)
    w[0] = 0
    names = [f"s{i}" for i in range(width)]

    def add(total, passage, term, count):
        if not len(passage):
            return
        value = (count * weights[term]).astype(np.float32)
        starts = np.nonzero(np.diff(passage, prepend=-1))[0]
        norm = np.sqrt(np.add.reduceat(value * value, starts))
        sizes = np.diff(np.append(starts, len(passage)))
        value /= np.repeat(norm, sizes)
        lo = 0
        while lo < len(starts):  # whole passages, CHUNK entries or so at a time
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CHUNK)))
            a, z = starts[lo], starts[hi] if hi < len(starts) else len(passage)
            t, v = term[a:z], value[a:z, None]
            y = np.add.reduceat(w[t] * v, starts[lo:hi] - a, axis=0)
            row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            order = np.argsort(t, kind="stable")
            by_term = t[order]
            cuts = np.nonzero(np.diff(by_term, prepend=-1))[0]
            total[by_term[cuts]] += np.add.reduceat(y[row[order]] * v[order], cuts, axis=0)
            lo = hi

    def run(batches):
        total = np.zeros((terms, width))
        for b in batches:
            for docs in _chunks(b.column("ids"), dtype):
                add(total, *_passages(items.long_parts(docs), terms, passage_words)[0])
        at = np.nonzero(total.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c) for c in total[at].T)], names=["term", *names])

    parts = encoded.select("ids").mapInArrow(tidy(run), "term long, " + ", ".join(f"{n} double" for n in names))
    summed = parts.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((terms, width))
    for r in summed.collect():  # at most one row per term of the block
        out[r.term] = r[1:]
    return w.astype(float), out


def add_items(w: np.ndarray, product: np.ndarray, items: Items, weights: np.ndarray, passages: float) -> np.ndarray:
    """The sketch with the items as passages too, which together weigh
    ITEM_SHARE of the corpus: the few dimensions kept then tell items apart
    even if the corpus holds each of them once or never."""
    rows = np.zeros((len(items.ids), items.terms), np.float32)
    for i, ws in enumerate(items.words):
        np.add.at(rows[i], ws, 1)
    rows *= weights
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
    return product + ITEM_SHARE * max(passages, 1) / len(rows) * (rows.T @ (rows @ w))


def right_vectors(w: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from W and A'AW."""
    shift = 1e-7 * max(np.linalg.norm(product), 1e-12)
    shifted = product + shift * w
    core = w.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-12
    if not keep.any():
        return np.zeros((len(w), 1))
    u, s, _ = np.linalg.svd(shifted @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, :rank]


class Search:
    """Windows of a stream of documents against the items of one block."""

    def __init__(self, items: Items, word_vectors: np.ndarray, min_cosine: float, min_lcs: float,
                 paraphrase_lcs: float, answer_share: float):
        self.items, self.vectors, self.min_cosine = items, word_vectors.astype(np.float32), min_cosine
        self.min_lcs, self.paraphrase_lcs, self.answer_share = min_lcs, paraphrase_lcs, answer_share
        self.has = items.has()
        self.lengths = np.array([len(x) for x in items.words])
        sizes = np.array([window_size(n) for n in self.lengths])
        self.classes = []
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            q = np.array([self.vectors[items.words[i]].sum(axis=0) for i in at])
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            at, q = at[norm[:, 0] > 0], (q / np.maximum(norm, 1e-30))[norm[:, 0] > 0]
            self.classes.append((int(size), stride_of(int(size)), at, q.T.astype(np.float32)))
        self.longest = max((c[0] for c in self.classes), default=STEP)

    def candidates(self, stream: np.ndarray):
        """(first word, size, item, cosine) of the candidate windows."""
        n = len(stream)
        for at in range(0, n, CHUNK):
            part = stream[at : at + CHUNK + self.longest]
            part = np.concatenate([part, np.zeros(-len(part) % STEP + self.longest, part.dtype)])
            if not part.any():
                continue
            word = self.vectors[part]
            steps = np.zeros((len(part) // STEP + 1, word.shape[1]))
            np.cumsum(word[0::STEP] + word[1::STEP] + word[2::STEP] + word[3::STEP], axis=0, out=steps[1:])
            for size, stride, item, q in self.classes:
                windows = -(-min(CHUNK, n - at) // stride)
                begin, end = steps[:: stride // STEP][:windows], steps[size // STEP :: stride // STEP][:windows]
                v = (end - begin).astype(np.float32)
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                cosine = v @ q
                hits = np.flatnonzero(cosine >= self.min_cosine * np.maximum(norm, 1e-6)[:, None])
                if len(hits):
                    i, j = np.divmod(hits, q.shape[1])
                    yield at + i * stride, size, item[j], cosine[i, j] / norm[i]

    def enough_words(self, stream: np.ndarray, first: np.ndarray, size: int, item: np.ndarray) -> np.ndarray:
        """Does the window, with a stride on each side, hold enough of the
        item's words in any order?  No match can do with fewer."""
        out = np.zeros(len(first), bool)
        margin = size // 4
        for at in range(0, len(first), 1 << 14):
            f, i = first[at : at + (1 << 14)], item[at : at + (1 << 14)]
            pos = f[:, None] + np.arange(-margin, size + margin)
            t = stream[np.clip(pos, 0, len(stream) - 1)].astype(np.int64)
            t[(pos < 0) | (pos >= len(stream))] = 0
            hits = (self.has[i[:, None], t >> 3] >> (t & 7) & 1).sum(axis=1)
            out[at : at + (1 << 14)] = hits >= self.paraphrase_lcs * self.lengths[i]
        return out

    def verified(self, region: list[int], item: int) -> tuple[float, float] | None:
        lcs = lcs_length(self.items.words[item], region) / len(self.items.words[item])
        if lcs < min(self.paraphrase_lcs, self.min_lcs):
            return None
        answer = self.items.answers[item]
        share = lcs_length(answer, region) / len(answer) if answer else 0.0
        if lcs >= self.min_lcs or share >= self.answer_share:
            return lcs, share
        return None

    def matches(self, buffers: list[np.ndarray]):
        """(document, item, cosine, lcs, answer share, first, last) for each
        document (a number in ``buffers``) and item; the best window counts."""
        stream = np.concatenate(buffers) if buffers else np.zeros(0, self.items.dtype)
        ends = np.cumsum([len(x) for x in buffers])
        best: dict[tuple[int, int], tuple] = {}
        for first, size, item, cosine in self.candidates(stream):
            ok = np.nonzero(self.enough_words(stream, first, size, item))[0]
            for k in ok:
                margin = size // 4
                lo, hi = max(0, int(first[k]) - margin), min(len(stream), int(first[k]) + size + margin)
                doc = int(np.searchsorted(ends, lo, side="right"))
                while doc < len(ends) and (begin := int(ends[doc]) - len(buffers[doc])) < hi:
                    a, z = max(lo, begin), min(hi, int(ends[doc]))
                    found = self.verified(stream[a:z].tolist(), int(item[k])) if z > a else None
                    if found:
                        row = (found[0], float(cosine[k]), found[1], a - begin, z - begin)
                        at = doc, int(item[k])
                        best[at] = max(best.get(at, row), row)
                    doc += 1
        for (doc, item), (lcs, cosine, share, a, z) in best.items():
            yield doc, item, cosine, lcs, share, a, z


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
                      rank: int = RANK, passage_words: int = 64, min_cosine: float = 0.5, min_lcs: float = 0.7,
                      paraphrase_lcs: float = 0.5, answer_share: float = 0.8, min_words: int = 8,
                      item_block: int = ITEM_BLOCK, seed: int = 11) -> DataFrame:
    """One row per document id and benchmark item that it holds: id_col,
    item_id, cosine, lcs_share, answer_share, first_word, last_word (exclusive;
    of the best window with its margin).

    Documents and items with null or empty text match nothing; an item of fewer
    than ``min_words`` words matches where its words stand exactly in a row
    (cosine and lcs_share 1, first and last word of the run).  Repeated
    items match like the first; repeated documents and ids give one row per id
    and item.  An empty table gives no rows.  Other columns are not read."""
    spark = docs.sparkSession
    worker_path(spark)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    wanted = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"),
                              answer.alias("answer")).where("text is not null")
    blocks = max(1, -(-wanted.count() // item_block))
    wanted = wanted.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {blocks})"))
    id_type, item_type = docs.schema[id_col].dataType, wanted.schema["item"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("item_id", item_type)]
                          + [T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs_share", "answer_share")]
                          + [T.StructField(c, T.LongType()) for c in ("first_word", "last_word")])
    found = []
    for block in range(blocks):
        items = Items(wanted.where(F.col("block") == block).orderBy("item", "text").collect(), min_words)
        if not items.ids and not items.runs.ids:
            continue
        encoded = staged(encode_documents(docs, id_col, text_col, items), "encoded")
        search = None
        if items.ids:
            weights, passages = term_weights(encoded, items, passage_words)
            w, product = sketch(encoded, items, weights, passage_words, rank + OVERSAMPLE, seed)
            vectors = weights[:, None] * right_vectors(w, add_items(w, product, items, weights, passages), rank)
            search = Search(items, vectors, min_cosine, min_lcs, paraphrase_lcs, answer_share)
        found.append(staged(_search(encoded, items, search, schema), "matches"))
        drop_staged(encoded)
    if not found:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("lcs_share", "cosine", "answer_share", "first_word", "last_word")).alias("m")
    return (reduce(DataFrame.union, found).groupBy(id_col, "item_id").agg(best)
            .select(id_col, "item_id", "m.cosine", "m.lcs_share", "m.answer_share", "m.first_word", "m.last_word"))


def _search(encoded: DataFrame, items: Items, search: Search | None, schema: T.StructType) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows, first = [], 0
            for docs in _chunks(b.column(1), items.dtype):
                if search:
                    rows += [(ids[first + doc], items.ids[item], *rest)
                             for doc, item, *rest in search.matches(items.long_parts(docs))]
                rows += [(ids[first + doc], items.runs.ids[item], *rest) for doc, item, *rest in items.runs.matches(docs)]
                first += len(docs)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows],
                                                 schema=arrow_schema)

    arrow_schema = to_arrow_schema(schema)
    return encoded.mapInArrow(tidy(run), schema)
