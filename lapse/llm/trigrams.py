"""Boolean trigram queries from regular expressions."""

from __future__ import annotations

from re import _constants as C
from re import _parser as P

#: More ways through a pattern than this make a part of it count as unknown.
MAX_WAYS = 512
GAP = None


def _in_chars(items) -> set[str] | None:
    """The lower-cased characters of a small class; None for any other."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 3 and all(c.isascii() for c in out) else None


def _join(a: list[tuple], b: list[tuple]) -> list[tuple]:
    out = {x + y for x in a for y in b}
    return list(out) if len(out) <= MAX_WAYS else [x + (GAP,) for x in a]


def _ways(seq) -> list[tuple]:
    """Each way through a parsed pattern: characters in a row, GAP where
    anything may stand."""
    ways: list[tuple] = [()]
    for op, arg in seq:
        if op is C.LITERAL:
            c = chr(arg).lower()
            part = [(c,)] if c.isascii() else [(GAP,)]
        elif op is C.IN:
            chars = _in_chars(arg)
            part = [(c,) for c in sorted(chars)] if chars else [(GAP,)]
        elif op is C.SUBPATTERN:
            part = _ways(arg[-1])
        elif op is C.BRANCH:
            part = [w for branch in arg[1] for w in _ways(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            once = _ways(body)
            part = [()]
            for _ in range(min(low, 3)):
                part = _join(part, once)
            if low == 0 and high == 1:
                part = [(), *once]
            elif high > min(low, 3):
                part = [w + (GAP,) for w in part]
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = [()]
        else:
            part = [(GAP,)]
        ways = _join(ways, part)
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams such that every text that the pattern
    matches has, lower-cased, all trigrams of at least one set.  None: the
    pattern has no mandatory trigram, so nothing can be ruled out."""
    sets = set()
    for way in _ways(P.parse(pattern)):
        found, run = set(), ""
        for c in (*way, GAP):
            if c is GAP:
                run = ""
            else:
                run = (run + c)[-3:]
                if len(run) == 3:
                    found.add(run)
        if not found:
            return None
        sets.add(frozenset(found))
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
