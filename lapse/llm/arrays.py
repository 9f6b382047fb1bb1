"""Running totals over arrays and cuts of long texts, as column expressions
whose time grows with the array or text and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements added up one by one; LEVELS times nested.
RUN, LEVELS = 32, 4
#: Code points per block of a text, and blocks cut out at once.
BLOCK, MANY = 2048, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int = 0, levels: int = LEVELS) -> Column:
    """For each element of a bigint array what ``merge`` makes of all elements
    before it, from ``zero`` on.  Runs of RUN elements are merged first, their
    results likewise, so an element looks at RUN others per level."""
    start = F.lit(zero).cast("bigint")

    def fold(part):
        return F.aggregate(part, start, lambda acc, x: merge(acc, x).cast("bigint"))

    def before(a, level):
        if not level:
            return F.transform(a, lambda x, i: fold(F.slice(a, F.lit(1), i)))

        def with_runs(runs):
            return let(before(runs, level - 1), lambda above: F.transform(a, lambda x, i: let(
                _whole(i / RUN), lambda run: F.aggregate(
                    F.slice(a, run * RUN + 1, i - run * RUN), above[run], lambda acc, y: merge(acc, y).cast("bigint")))))

        return let(F.transform(_upto(F.ceil(F.size(a) / RUN)), lambda r: fold(F.slice(a, r * RUN + 1, F.lit(RUN)))), with_runs)

    return let(values.cast("array<bigint>"), lambda a: before(a, levels))


def blocks_of(text: Column) -> Column:
    """A text as an array of BLOCK code points each."""
    def cut(t, size):
        return F.transform(_upto(F.ceil(F.length(t) / size)), lambda k: F.substring(t, k * size + 1, F.lit(size)))

    return let(text, lambda t: F.flatten(F.transform(cut(t, BLOCK * MANY), lambda s: cut(s, BLOCK))))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks."""
    def at(b, i):
        return F.coalesce(F.get(b, i), F.lit(""))

    def cut(first, last):
        inside = F.substring(at(blocks, first), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))
        across = F.concat(
            F.substring(at(blocks, first), (start - first * BLOCK + 1).cast("int"), F.lit(BLOCK)),
            F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(at(blocks, last), F.lit(1), (end - last * BLOCK).cast("int")))
        return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)

    return let(_whole(start / BLOCK), lambda first: let(_whole(end / BLOCK), lambda last: cut(first, last)))
