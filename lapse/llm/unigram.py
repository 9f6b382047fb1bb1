"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a
position; dynamic programming keeps, for each position, only the best score
and the number of pieces on that path.  Ties go to the path that the
tokenizer meets first: the one whose last piece starts earliest; a later one
replaces it only with a strictly higher score.  Scores are added in doubles
from the start of a word, as the tokenizer does, so rounding is the same too.

Words are cut at spaces (each keeps a leading U+2581), and the counts of short
words are kept in a bounded cache."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import tidy, worker_path

SPACE = "▁"
#: How far below the lowest score an unknown character is; fixed by the tokenizers.
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 150_000
CACHED_CHARS = 64
NOT_REACHED = float("-inf")


class PieceCounter(dict):
    """Word (without its leading space mark) -> number of pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.empty = not vocabulary
        if vocabulary:
            self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = self.count_word(SPACE + word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def count_word(self, word: str) -> int:
        """Pieces of the best path through one word, space mark included."""
        if not self.singles.issuperset(word):
            return self._with_unknown(word)
        score, pieces = [NOT_REACHED] * (len(word) + 1), [0] * (len(word) + 1)
        score[0] = 0.0
        for last, (length, own) in self.automaton.iter(word):  # by end; of one end the longest first
            start, end = last + 1 - length, last + 1
            total = score[start] + own
            if total > score[end]:
                score[end] = total
                pieces[end] = pieces[start] + 1
        return pieces[-1]

    def _with_unknown(self, word: str) -> int:
        """The same for a word with characters that are no piece."""
        n = len(word)
        score, pieces, after_unknown = [NOT_REACHED] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at = 0
        for last, (length, own) in () if self.empty else self.automaton.iter(word):
            while at < last:
                at += 1
                self._unknown(word, at, score, pieces, after_unknown)
            start, end = last + 1 - length, last + 1
            total = score[start] + own
            if total > score[end]:
                score[end], pieces[end], after_unknown[end] = total, pieces[start] + 1, False
        while at < n:
            at += 1
            self._unknown(word, at, score, pieces, after_unknown)
        return pieces[n]

    def _unknown(self, word, end, score, pieces, after_unknown) -> None:
        """The last character as an unknown one, if it is no piece itself."""
        c = word[end - 1]
        if c in self.singles:
            return
        total = score[end - 1] + self.unknown
        if total > score[end]:
            score[end] = total
            if self.byte_fallback:
                pieces[end] = pieces[end - 1] + len(c.encode("utf-8", "replace"))
            else:
                pieces[end] = pieces[end - 1] + (not after_unknown[end - 1])
            after_unknown[end] = True

    def count(self, text: str | None) -> int:
        """Pieces of a whole text; null and empty have none."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "":  # the text brings its own leading space
            del words[0]
        return sum(map(self.__getitem__, words))


def read_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model; control, unknown, unused and
    byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]


@lru_cache(maxsize=2)
def piece_counter(model_path: str, byte_fallback: bool) -> PieceCounter:
    """One per worker process: the cache outlives a task."""
    return PieceCounter(read_vocabulary(model_path), byte_fallback)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
                 byte_fallback: bool = True) -> DataFrame:
    """(id_col, n_tokens): pieces of the best unigram segmentation of every
    whole text under the model's pieces and scores.

    Null and empty texts have 0.  A character that is no piece counts as its
    UTF-8 bytes, or, without ``byte_fallback``, a run of such characters as one
    unknown piece.  One row per input row, repeated rows and null ids included;
    other columns are not read.  Nothing is shuffled."""
    worker_path(docs.sparkSession)
    path = model_path or default_model()
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = piece_counter(path, byte_fallback).count
        for b in batches:
            n = [count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=schema.names)

    return slim.mapInArrow(tidy(run), schema)
