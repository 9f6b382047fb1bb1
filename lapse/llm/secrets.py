"""Secret scanning behind an inverted trigram index, all in column expressions.

Each rule's pattern yields a Boolean trigram query.  The index holds a posting
(trigram, document id) for every trigram of those queries; intersecting the
postings by document gives the rules whose patterns can match it at all.  Only
those are run.  Rules without a mandatory trigram run on every text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.arrays import blocks_of, let, piece, running
from lapse.llm.common import staged
from lapse.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap; those whose
    ``group`` has fewer than ``min_chars`` characters are dropped.  The pattern
    must mean the same in Java and Python and match no empty string."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key")

#: A run that is too short hides no longer match of its own kind inside, so
#: the last two patterns can ask for the length themselves.
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def build_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) or () for g in s})
    low = F.lower(F.col(text_col).cast("string"))
    found = [F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams] or [F.lit(None).cast("string")]
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*found))).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, rules): the rules with a trigram query whose postings meet in the
    document.  A document has at most as many postings as there are trigrams."""
    seen = index.groupBy("id").agg(F.collect_set("trigram").alias("seen"))
    tests = []
    for r in rules:
        query = trigram_query(r.pattern)
        if query is not None:
            meets = [reduce(Column.__and__, (F.array_contains("seen", g) for g in sorted(s))) for s in query]
            tests.append(F.when(reduce(Column.__or__, meets), F.lit(r.kind)))
    rules_of = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return seen.select("id", rules_of.alias("rules")).where(F.size("rules") > 0)


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points: what lies between the matches and the
    matches themselves add up to their places."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))

    def spans(parts):
        sizes = F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

        def span(x, start):
            return F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"),
                            (start + F.length(x["hit"])).cast("bigint").alias("end"), F.lit(rule.kind).alias("kind"),
                            (F.length(x["part"]) >= rule.min_chars).alias("keep"))

        found = let(running(sizes, lambda a, b: a + b), lambda before: F.transform(
            parts, lambda x, i: span(x, before[i] + F.length(x["gap"]))))
        kept = F.filter(found, lambda s: s["keep"])  # null after the last match
        return F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).cast(SPAN)

    return let(parts, spans)


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
         spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans_col`` appended (a column of that name is
    replaced): the spans (start, rank, end, kind) of all rules by start, then
    by the rules' order; code points, end exclusive.

    Null and empty texts have no spans.  Rows with equal or null ids share
    their candidate rules, never their matches.  Every row comes back once."""
    hits = staged(candidates(build_index(docs, rules, id_col, text_col), rules), "candidates")
    hits = hits.select(F.col("id").alias("__id"), F.col("rules").alias("__rules"))
    text = F.col(text_col).cast("string")
    found = []
    for rank, r in enumerate(rules):
        may = text.rlike(r.pattern)
        if trigram_query(r.pattern) is not None:
            may = F.array_contains("__rules", r.kind) & may
        found.append(F.when(may, match_spans(text, r, rank)).otherwise(F.array().cast(SPAN)))
    spans = F.array_sort(F.concat(*found)).cast(SPAN)
    kept = docs.drop(spans_col)
    joined = kept.join(hits, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in kept.columns), spans.alias(spans_col))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping or touching spans (by start)
    replaced by ``mark``."""

    def masked(spans, blocks):
        def one(done):  # done: the largest end before each span, and at last of all
            def part(s, i):
                gap = piece(blocks, F.get(done, i), s["start"])
                return F.when((s["start"] > F.get(done, i)) | (i == 0), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

            tail = piece(blocks, F.element_at(done, -1), F.length(text).cast("bigint"))
            return F.concat(F.array_join(F.transform(spans, part), ""), tail)

        ends = F.concat(F.transform(spans, lambda s: s["end"]), F.array(F.lit(0).cast("bigint")))
        return let(running(ends, F.greatest), one)

    return let(spans, lambda s: let(blocks_of(text), lambda b: masked(s, b)))


def redact(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with the secrets in the text replaced by ``mark``; texts
    without one stay as they are.  ``length_col`` then holds the new number of
    code points of the texts that changed."""
    found = scan(docs, rules, id_col, text_col, "__spans")
    hit = F.size("__spans") > 0
    text = F.col(text_col)
    out = found.withColumn("__new", F.when(hit, redacted(text, F.col("__spans"), mark)).otherwise(text))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__new").alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(hit, F.length("__new")).otherwise(F.col(c)).cast(kind).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
