"""Vectors as short codes: one small codebook per part of the vector.

The codebooks are fitted in integers, so their result is the same however the
rows are dealt out.  What a part's nearest entry is, is mostly known from the
round before (Drake and Hamerly's adaptive bounds): with each part its b
closest entries are kept, with lower bounds of their distances in ascending
order, and one outer bound for all other entries.  Entries move by a known
distance, which loosens the bounds; only where a bound no longer lies above
the distance to the part's own entry are integer distances computed, of the
entries before that bound, or of all entries once the outer bound fails.  How
many bounds the parts needed decides the next round's b.

Rows and bounds are a table that each round reads and writes anew.  The rows'
sums by entry are all that leaves the tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lapse.llm.common import drop_staged, staged, tidy, worker_path

NONE = 255  # no entry at this place
#: Share of parts that may need all entries before b grows, and of those that
#: may need more bounds than b has when it shrinks.
GROW, SHRINK = 0.05, 0.01
_SLACK = 1e-9  # more than the rounding of a square root and a sum

Codebooks = dict[int, list[np.ndarray]]  # by vector length: per part, entries x components


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; they are equal if the length
    is a multiple of their number."""
    return [i * length // parts for i in range(parts + 1)]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return (d * d).sum(axis=-1)


def _below(x: np.ndarray) -> np.ndarray:
    """Lower bounds in single precision."""
    return np.nextafter((x * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """near: the closest entries of each row, its own first; low: lower bounds
    of their distances; outer: of the distances to all entries not in near."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    @classmethod
    def unknown(cls, rows: int, b: int) -> Bounds:
        return cls(np.full((rows, b), NONE, np.uint8), np.full((rows, b), np.inf, np.float32), np.full(rows, -np.inf, np.float32))

    def resized(self, b: int) -> Bounds:
        """The first b places; what goes is under the outer bound from now on."""
        have = self.near.shape[1]
        if b < have:
            return Bounds(self.near[:, :b], self.low[:, :b], np.minimum(self.outer, self.low[:, b:].min(axis=1)))
        more = Bounds.unknown(len(self.outer), b - have)
        return Bounds(np.hstack([self.near, more.near]), np.hstack([self.low, more.low]), self.outer)

    def moved(self, drift: np.ndarray) -> None:
        """Entry e went ``drift[e]`` far; bounds ascend again afterwards."""
        far = np.append(drift, np.zeros(NONE + 1 - len(drift)))
        self.outer = _below(self.outer - drift.max(initial=0))
        self.low = np.where(self.near == NONE, np.inf, _below(self.low - far[self.near])).astype(np.float32)
        for j in range(self.low.shape[1] - 1, 0, -1):
            after = self.low[:, j + 1] if j + 1 < self.low.shape[1] else self.outer
            self.low[:, j] = np.minimum(self.low[:, j], after)

    def assign(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each row to its nearest entry (ties: lower index),
        which then is near[:, 0], and how many bounds that took: at most b - 1
        of the entries in near, b if all entries had to be looked at."""
        b = self.near.shape[1]
        own = self.near[:, 0]
        known = own != NONE
        best = np.zeros(len(x), np.int64)
        best[known] = _squares(x[known], entries[own[known]])
        reach = np.sqrt(best.astype(float)) * (1 + _SLACK)
        all_of = ~known | (self.outer <= reach)
        needed = np.where(all_of, b, (self.low[:, 1:] <= reach[:, None]).sum(axis=1))
        some = np.flatnonzero((needed > 0) & ~all_of)
        if len(some):
            place = np.arange(1, b)[None, :]
            # Padded places are infinitely far; they can only be counted in where the outer bound fails.
            ask = (place <= needed[some][:, None]) & (self.near[some, 1:] != NONE)
            row, j = np.nonzero(ask)
            exact = np.full((len(some), b), np.iinfo(np.int64).max)
            exact[:, 0] = best[some]
            exact[row, j + 1] = _squares(x[some[row]], entries[self.near[some[row], j + 1]])
            low = self.low[some].copy()
            low[row, j + 1] = _below(np.sqrt(exact[row, j + 1].astype(float)))
            low[:, 0] = _below(np.sqrt(best[some].astype(float)))
            least = exact.min(axis=1)
            winner = np.where(exact == least[:, None], self.near[some].astype(np.int64), NONE).min(axis=1)
            first = self.near[some] == winner[:, None]
            order = np.argsort(np.where(first, -np.inf, low), axis=1, kind="stable")
            self.near[some] = np.take_along_axis(self.near[some], order, 1)
            self.low[some] = np.take_along_axis(low, order, 1)
            best[some] = least
        full = np.flatnonzero(all_of)
        if len(full):
            exact = _squares(x[full][:, None, :], entries[None, :, :])
            order = np.argsort(exact, axis=1, kind="stable")
            exact = np.take_along_axis(exact, order, 1)
            bounds = _below(np.sqrt(exact.astype(float)))
            have = min(b, len(entries))
            self.near[full, :have], self.low[full, :have] = order[:, :have], bounds[:, :have]
            self.near[full, have:], self.low[full, have:] = NONE, np.inf
            self.outer[full] = bounds[:, have] if len(entries) > have else np.inf
            best[full] = exact[:, 0]
        sure = np.flatnonzero(needed == 0)
        self.low[sure, 0] = _below(np.sqrt(best[sure].astype(float)))
        return best, needed


#: What a task leaves of its rows of one length: sums by part, entry and
#: component; component -1 counts rows; part -1 counts needs (entry bounds).
_TALLY = "array<struct<n:int,part:int,entry:int,at:int,total:bigint>>"


class _Round:
    """One assignment of all rows of a task."""

    def __init__(self, books: Codebooks, before: Codebooks | None, b: int, parts: int):
        self.books, self.b, self.parts = books, b, parts
        self.drift = {n: [np.sqrt(_squares(old, new).astype(float)) * (1 + _SLACK) for old, new in zip(before[n], book, strict=True)]
                      for n, book in books.items()} if before else None
        self.sums: dict[int, list[np.ndarray]] = {}
        self.needs = np.zeros(256, np.int64)

    def batch(self, n: int, x: np.ndarray, kept: list[Bounds] | None) -> tuple[list[Bounds], np.ndarray]:
        at, out, error = cuts(n, self.parts), [], np.zeros(len(x), np.int64)
        sums = self.sums.setdefault(n, [np.zeros((len(c), c.shape[1] + 1), np.int64) for c in self.books[n]])
        for p, entries in enumerate(self.books[n]):
            part = x[:, at[p] : at[p + 1]]
            if kept is None:
                bounds = Bounds.unknown(len(x), self.b)
            else:
                kept[p].moved(self.drift[n][p])
                bounds = kept[p].resized(self.b)
            best, needed = bounds.assign(part, entries)
            error += best
            self.needs += np.bincount(needed, minlength=256)
            mine = bounds.near[:, 0][:, None] == np.arange(len(entries), dtype=np.uint8)[None, :]
            sums[p][:, 0] += mine.sum(axis=0)
            sums[p][:, 1:] += mine.T.astype(np.int64) @ part
            out.append(bounds)
        return out, error

    def tally(self) -> list[tuple]:
        rows = [(0, -1, j, 0, int(c)) for j, c in enumerate(self.needs) if c]
        for n, sums in self.sums.items():
            for p, s in enumerate(sums):
                rows += [(n, p, e, at - 1, int(s[e, at])) for e, at in zip(*np.nonzero(s), strict=True)]
        return rows


def _pack(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _unpack(column: pa.Array, kind, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


class _Job:
    """The passes over the rows; kinds: types of the carried columns."""

    def __init__(self, carried: T.StructType, store: str, parts: int):
        self.carried, self.store, self.parts = carried, np.dtype(store), parts
        state = "n int, v binary, near binary, low binary, outer binary, tally " + _TALLY
        self.schema = T.StructType([*carried.fields, *T._parse_datatype_string(state).fields])

    def _rows(self, b: pa.RecordBatch, round_: _Round, last_b: int | None, scale: int):
        """(rows' places, n, vectors, bounds, errors) for each vector length of a batch."""
        at_n = len(self.carried.fields)
        if last_b is None:
            sizes = np.array(b.column(at_n).value_lengths())
        else:
            sizes = np.array(b.column(at_n))
        for n in map(int, np.unique(sizes)):
            rows = np.flatnonzero(sizes == n)
            part = b.take(pa.array(rows))
            if last_b is None:
                flat = part.column(at_n).flatten().to_numpy(zero_copy_only=False)
                x, kept = np.floor(scale * flat.astype(float)).astype(np.int64).reshape(len(rows), n), None
            else:
                x = _unpack(part.column(at_n + 1), self.store, len(rows)).astype(np.int64)
                shape = (len(rows), self.parts, last_b)
                near = _unpack(part.column(at_n + 2), np.uint8, len(rows)).reshape(shape)
                low = _unpack(part.column(at_n + 3), np.float32, len(rows)).reshape(shape)
                outer = _unpack(part.column(at_n + 4), np.float32, len(rows))
                kept = [Bounds(near[:, p].copy(), low[:, p].copy(), outer[:, p].copy()) for p in range(self.parts)]
            yield (rows, part, n, x, *round_.batch(n, x, kept))

    def step(self, df: DataFrame, books: Codebooks, before: Codebooks | None, b: int, last_b: int | None, scale: int) -> DataFrame:
        """The table of the next round: rows with their new bounds, and one row of sums per task."""
        names, carried, parts = self.schema.names, len(self.carried.fields), self.parts
        tallies = pa.list_(pa.struct([("n", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()),
                                      ("total", pa.int64())]))

        def run(batches):
            round_, types = _Round(books, before, b, parts), []
            for batch in batches:
                types = [c.type for c in batch.columns[:carried]]
                for _, part, n, x, bounds, _ in self._rows(batch, round_, last_b, scale):
                    rows = len(x)
                    yield pa.RecordBatch.from_arrays([
                        *part.columns[:carried], pa.array(np.full(rows, n, np.int32)), _pack(x.astype(self.store)),
                        _pack(np.hstack([y.near for y in bounds])), _pack(np.hstack([y.low for y in bounds])),
                        _pack(np.stack([y.outer for y in bounds], axis=1)), pa.nulls(rows, tallies)], names=names)
            rows = [dict(zip(("n", "part", "entry", "at", "total"), r, strict=True)) for r in round_.tally()]
            if rows:
                none = [pa.nulls(1, x) for x in (*types, pa.int32(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([rows], tallies)], names=names)

        return df.mapInArrow(tidy(run), self.schema)

    def codes(self, df: DataFrame, books: Codebooks, before: Codebooks | None, b: int, last_b: int | None, scale: int) -> DataFrame:
        schema = T.StructType([*self.carried.fields, *T._parse_datatype_string("code string, error bigint").fields])
        carried, parts = len(self.carried.fields), self.parts

        def run(batches):
            round_ = _Round(books, before, b, parts)
            for batch in batches:
                for _, part, _, _, bounds, error in self._rows(batch, round_, last_b, scale):
                    codes = [r.tobytes().hex() for r in np.stack([y.near[:, 0] for y in bounds], axis=1)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:carried], pa.array(codes, pa.string()), pa.array(error)],
                                                     names=schema.names)

        return df.mapInArrow(tidy(run), schema)


def _next_b(needs: dict[int, int], b: int, entries: int) -> int:
    total, most = sum(needs.values()), max(2, entries // 2)
    if needs.get(b, 0) > GROW * total:
        return min(2 * b, most)
    shrunk = 1
    while shrunk < b and sum(c for j, c in needs.items() if j >= shrunk) > SHRINK * total:
        shrunk += 1
    return max(2, min(b, shrunk))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = (),
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(id_col, keep..., code, error) of every vector, and the codebooks.

    Components are integers floor(scale * x).  Each part's codebook starts as
    that part of the vectors with the smallest ids (equal ids by vector, null
    ids last); each round assigns every part to its nearest entry (ties to
    the lower index) and moves each entry to the componentwise floor of its
    parts' mean; unused entries stay.  code holds two hex digits per part,
    error the squared distances.

    Rows whose vector is null or holds null or non-finite components go; all
    others, repeated ones and those without id too, count and come back once.
    Vectors of each length have codebooks of their own; fewer vectors than
    ``entries`` give as many entries.  An empty table has no codes and no
    codebooks.  Components whose sums or squared distances would not fit into
    64 bits are an error.  Columns not named are not read."""
    if not 1 <= entries < NONE:
        raise ValueError(f"entries must lie between 1 and {NONE - 1}")
    if {"code", "error"} & {id_col, *keep}:
        raise ValueError("code and error are names of the result")
    worker_path(vectors.sparkSession)
    ok = vectors.where(F.col(vector_col).isNotNull() & _finite(F.col(vector_col)))
    carried = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate((id_col, *keep))]
    plain = ok.select(*carried, F.col(vector_col).cast("array<double>").alias("__v"))
    largest = F.greatest(F.abs(F.array_max("__v")), F.abs(F.array_min("__v")))
    sizes = plain.groupBy(F.size("__v").alias("n")).agg(F.count("*").alias("rows"), F.max(largest).alias("top")).collect()  # one row per length
    most = 0.0
    for r in sizes:
        top = (r.top or 0.0) * scale + 1
        most = max(most, top)
        if max(2 * top * r.rows, (r.n // parts + 1) * (2 * top) ** 2) >= 1 << 62:
            raise OverflowError("sums or squared distances do not fit into 64 bits")
    seeds = plain.select("__v", F.row_number().over(
        Window.partitionBy(F.size("__v")).orderBy(F.asc_nulls_last("__c0"), "__v")).alias("__at")).where(F.col("__at") <= entries)
    first: dict[int, list] = {}
    for r in sorted(seeds.collect(), key=lambda r: r["__at"]):  # at most ``entries`` rows per length
        first.setdefault(len(r["__v"]), []).append(np.floor(scale * np.array(r["__v"], float)).astype(np.int64))
    books: Codebooks = {}
    for n, found in first.items():
        at, table = cuts(n, parts), np.array(found).reshape(len(found), n)
        books[n] = [table[:, at[p] : at[p + 1]] for p in range(parts)]
    store = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    job = _Job(T.StructType(plain.schema.fields[:-1]), store, parts)
    rows, old, before, last_b, b = plain, [], None, None, max(2, entries // 4)
    for _ in range(rounds):
        done = staged(job.step(rows, books, before, b, last_b, scale), "bounds")
        tally = done.where("tally is not null").select(F.inline("tally")).groupBy("n", "part", "entry", "at").agg(
            F.sum("total").alias("total")).collect()  # one row per component of the codebooks
        moved = {n: [c.copy() for c in book] for n, book in books.items()}
        counts = {(r.n, r.part, r.entry): r.total for r in tally if r.part >= 0 and r["at"] < 0}
        for (n, part, entry) in counts:
            moved[n][part][entry] = 0  # components whose sum is 0 send nothing
        for r in tally:
            if r.part >= 0 and r["at"] >= 0:
                moved[r.n][r.part][r.entry, r["at"]] = r.total // counts[r.n, r.part, r.entry]
        drop_staged(*old)
        old, rows = [done], done.where("tally is null").drop("tally")
        last_b, b = b, _next_b({r.entry: r.total for r in tally if r.part < 0}, b, entries)
        before, books = books, moved
    coded = staged(job.codes(rows, books, before, b, last_b, scale), "codes")
    drop_staged(*old)
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate((id_col, *keep))]
    return coded.select(*names, "code", "error"), books


def codebooks_sha256(books: Codebooks) -> str:
    """Of all integer components, by length, part, entry and place, comma-joined."""
    numbers = (str(x) for n in sorted(books) for book in books[n] for entry in book.tolist() for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()
