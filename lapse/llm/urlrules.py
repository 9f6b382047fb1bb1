"""URL verdicts from pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: ``||example.com/en/`` blocks that path
of the host and its subdomains, ``@@`` in front allows it, ``*`` stands for
anything and ``^`` for a separator or the end; a pattern without ``||`` fits
anywhere.  Each rule is filed under the one of its literal tokens that the
fewest URLs have.  A URL's tokens fetch the rules filed under them; only those
rules' regular expressions run.  Rules without a token run on every URL.  Of
the rules that fit, the longest decides."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm.common import is_empty, staged

#: ``^`` in a pattern.
SEPARATOR = "([^A-Za-z0-9_.%-]|$)"


@dataclass(frozen=True)
class UrlRule:
    pattern: str  # ||host/path, with * and ^
    allow: bool = False

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    def regex(self) -> str:
        """Over the lower-cased host followed by the path; the same in Java
        and RE2.  (?s): line ends in a path are characters like any other."""
        body = "".join({"*": ".*", "^": SEPARATOR}.get(c, re.sub(r"([^A-Za-z0-9/])", r"\\\1", c)) for c in self.name)
        return r"(?s)^([^/]*\.)?" + body if self.pattern.startswith("||") else "(?s)" + body

    def tokens(self) -> list[str]:
        """Runs of letters and digits that every fitting URL has whole:
        bounded on both sides by a literal character or the host's start."""
        start = r"(?:^|(?<=[^A-Za-z0-9*]))" if self.pattern.startswith("||") else r"(?<=[^A-Za-z0-9*])"
        return sorted({t.lower() for t in re.findall(start + r"[A-Za-z0-9]+(?=[^A-Za-z0-9*])", self.name)})


def _ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to the first of / ? # or the end, A-Z lower-cased;
    empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(_ascii_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to the first of ? # or the end; empty likewise."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule] | DataFrame) -> DataFrame:
    """(rule, name, regex, verdict, tokens): one row per rule, numbered in the
    order of its name and verdict, in the shared folder.  ``rules``: a list, or
    a table (pattern string, allow boolean), whose null patterns are left out
    and whose null ``allow`` blocks."""
    if not isinstance(rules, DataFrame):
        texts = [json.dumps([{"pattern": r.pattern, "allow": r.allow} for r in rules[at : at + 1000]]) for at in range(0, len(rules), 1000)]
        lists = spark.range(1).select(F.explode(F.array(*map(F.lit, texts or ["[]"]))).alias("text"))
        rules = lists.select(F.inline(F.from_json("text", "array<struct<pattern:string,allow:boolean>>")))
    anchored = F.startswith("pattern", F.lit("||"))
    plain = rules.where("pattern is not null").select(
        F.when(anchored, F.substring("pattern", 3, 1 << 30)).otherwise(F.col("pattern")).alias("name"), anchored.alias("anchored"),
        F.when(F.col("allow"), "allow").otherwise("block").alias("verdict"))
    body = F.regexp_replace("name", r"([^A-Za-z0-9/*^])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    regex = F.concat(F.when(F.col("anchored"), F.lit(r"(?s)^([^/]*\.)?")).otherwise(F.lit("(?s)")), body)
    inner = r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"
    first = r"^[A-Za-z0-9]+(?=[^A-Za-z0-9*])"
    tokens = F.when(F.col("anchored"), F.regexp_extract_all("name", F.lit(f"(?:{first})|(?:{inner})"), F.lit(0))).otherwise(
        F.regexp_extract_all("name", F.lit(inner), F.lit(0)))
    table = plain.select("name", regex.alias("regex"), "verdict", F.array_distinct(F.transform(tokens, _ascii_lower)).alias("tokens"))
    return staged(table.distinct().select(F.xxhash64("name", "regex", "verdict").alias("rule"), "*"), "rules")


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule): each rule of ``rule_table`` that has tokens under its
    rarest one (ties: the first in alphabetical order), counted over the token
    sets of all ``urls``."""
    filed = rules.select("rule", F.explode("tokens").alias("token"))
    wanted = filed.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")
    return filed.join(counts, "token", "left").groupBy("rule").agg(best).select("best.token", "rule")


def judge(pages: DataFrame, rules: Sequence[UrlRule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict appended (columns of those
    names are replaced).  rule is null and the verdict ``default`` where no
    rule fits.  Ties between rules of equal length go to the smaller name;
    a rule given twice, to the blocking one.  Null and malformed URLs have
    empty host and path.  Every row comes back once; an empty table gives no
    rows, and without rules every URL gets ``default``.

    ``rules``: a list or a table (see ``rule_table``).  They stay a table; only
    those without a token, which every URL has to try, are sent to all tasks."""
    spark = pages.sparkSession
    kept = pages.drop("host", "path", "rule", "verdict")
    url = F.col(url_col).cast("string")
    where = F.concat(host_of(url), path_of(url))
    urls = staged(kept.select(where.alias("place")).distinct()
                  .select("place", F.array_distinct(F.split(_ascii_lower(F.col("place")), "[^a-z0-9]+")).alias("tokens")), "urls")
    table = rule_table(spark, rules)
    filed = staged(index_rules(urls, table).join(table.drop("tokens"), "rule"), "filed")
    found = urls.select("place", F.explode("tokens").alias("token")).join(filed, "token").select("place", "name", "regex", "verdict")
    loose = table.where(F.size("tokens") == 0)
    if not is_empty(loose):
        everywhere = loose.agg(F.collect_list(F.struct("name", "regex", "verdict"))).scalar()
        found = found.unionByName(urls.select("place", F.explode(everywhere).alias("r")).select("place", "r.*"))
    fits = found.where(F.expr("place rlike regex"))
    order = F.struct(-F.length("name"), F.col("name"), (F.col("verdict") == "allow"))
    best = staged(fits.groupBy("place").agg(F.min_by(F.struct("name", "verdict"), order).alias("best")), "verdicts")
    best = best.select(F.col("place").alias("__place"), F.col("best").alias("__best"))
    named = kept.withColumns({"host": host_of(url), "path": path_of(url)})
    out = named.join(best, F.concat("host", "path") == F.col("__place"), "left")
    return out.select(*(F.col(f"`{c}`") for c in kept.columns), "host", "path", F.col("__best.name").alias("rule"),
                      F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
