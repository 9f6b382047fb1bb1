"""URL rules against every rule on every URL."""

import functools
import random
import re
import time

from pyspark.sql import functions as F

from lapse.llm.urlrules import UrlRule, index_rules, judge, rule_table

RULES = [UrlRule("||com/", True), UrlRule("||example.com/en/"), UrlRule("||www.example.com/en/", True), UrlRule("||net/es/"),
         UrlRule("||net/fr/"), UrlRule("/ads/*/banner^"), UrlRule("||b*.org"), UrlRule("track"), UrlRule("||net/fr/", True)]


@functools.cache
def compiled(rule):
    return re.compile(rule.regex())


def slow(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(-len(r.name), r.name, r.allow) for r in rules if compiled(r).search(host + path)]
    if not fits:
        return host, path, None, "allow"
    _, name, allow = min(fits)
    return host, path, name, "allow" if allow else "block"


def urls():
    rng = random.Random(3)
    parts = ["http://", "https://", "www.", "example.", "EXAMPLE.", "com", "net", "org", "/en/", "/es/x", "/fr/", "/ads/1/banner",
             "/ads/banner", "?q=/en/", "#/fr/", "b", "bad", ".", "/", ":80", "track", "é", "K", "\n", "://"]
    return [None, "", "no scheme", "://", "http://com", "http://com/", "http://xcom/", "http://x.net/es/", "http://x.net/ES/",
            "http://WWW.Example.COM/en/1?x", "http://m.www.example.com/en/", "http://example.com/en", "http://a.com:80/"] + [
        "".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(800)]


def test_judge(spark):
    rows = [(i, u) for i, u in enumerate(urls())] + [(0, None), (None, "http://x.net/es/"), (9, "http://h.com/" + "a/" * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {"rule": F.lit(1), "verdict": F.lit("x"), "host": F.lit(2), "place": F.lit("y"), "token": F.lit("z"), "best": F.lit(3)})
    for rules in (RULES, RULES[:5], []):
        got = judge(df, rules).select("page_id", "url", "host", "path", "rule", "verdict").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, u, *slow(u, rules))) for i, u in rows)
    assert judge(df.limit(0), RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["com", "example", "en"],), (["com", "en"],), (["com"],)], "tokens array<string>")
    table = rule_table(spark, RULES)
    name = {r.rule: (r.name, r.verdict) for r in table.collect()}
    filed = {name[r.rule]: r.token for r in index_rules(urls, table).collect()}
    assert filed["com/", "allow"] == "com" and filed["example.com/en/", "block"] == "example" and filed["www.example.com/en/", "allow"] == "www"
    assert filed["net/es/", "block"] == "es" and filed["b*.org", "block"] == "org" if RULES[6].tokens() else ("b*.org", "block") not in filed
    assert ("track", "block") not in filed and filed["/ads/*/banner^", "block"] == "ads"


def test_table_says_what_the_rules_say(spark):
    rules = [*RULES, UrlRule("||a.b-c_d.x/(y)+[z]{1}|$\\q/*"), UrlRule("a^b*c/"), UrlRule("||É.com/"), UrlRule("||x1.y2.z3^"), UrlRule("*")]
    rows = {(r.name, r.verdict): r for r in rule_table(spark, rules).collect()}
    for r in rules:
        got = rows[r.name, "allow" if r.allow else "block"]
        assert got.regex == r.regex() and sorted(got.tokens) == r.tokens()
    given = spark.createDataFrame([(r.pattern, r.allow) for r in rules] + [(None, True), ("||com/", True)], "pattern string, allow boolean")
    assert {(r.name, r.verdict): r for r in rule_table(spark, given).collect()} == rows


def test_many_rules(spark):
    """2,000 rules against brute force; 50,000 are planned as quickly as a few."""
    rng = random.Random(9)
    hosts = [f"h{i}.example{i % 7}.{tld}" for i in range(400) for tld in ("com", "net")]
    rules = [UrlRule(f"||{rng.choice(hosts)}/{rng.choice(['', 'a/', 'b/', 'c/*/d'])}", rng.random() < 0.3) for _ in range(1998)]
    rules += [UrlRule("*zz"), UrlRule("banner")]
    rows = [(i, f"https://{rng.choice(['', 'm.'])}{rng.choice(hosts)}/{rng.choice(['', 'a/1', 'b/x', 'c/9/d', 'zz', 'banner'])}") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(df, rules).collect()}
    assert got == {i: slow(u, rules)[2:] for i, u in rows}
    began = time.time()
    many = rules + [UrlRule(f"||site{i}.org/p{i}/") for i in range(48_000)]
    assert {r.page_id: (r.rule, r.verdict) for r in judge(df, many).collect()} == got
    assert time.time() - began < 60
