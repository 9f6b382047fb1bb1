"""Registered queries of this subpackage (see ``__spark_entry__.py``).

Each applies one operator, with its production parameters, to its whole table
and derives the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import chat, langid, secrets, vafile, warc
from lapse.llm.audit import audit_filters
from lapse.llm.codes import codebooks_sha256, compress
from lapse.llm.common import drop_path, shared_path, staged
from lapse.llm.latent import benchmark_matches
from lapse.llm.neighbours import nearest
from lapse.llm.packing import pack_documents
from lapse.llm.simhash import simhash_components
from lapse.llm.unigram import token_counts
from lapse.llm.urlrules import UrlRule, judge
from lapse.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(warc.classify(read_table(spark, sf_dir, "pages")), path)
    records = staged(warc.read_records(spark, path).drop("payload"), "records", compression="zstd")  # the body has it
    drop_path(spark, path)  # all read
    captures = warc.assemble(records)
    return captures.select(
        "response.page_id", "response.payload_bytes", "response.payload_digest", "response.record_type",
        "response.refers_to", "n_requests", "n_metadata")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (35 - 5 * d)) & 31 AS INTEGER) + 1, 1)"
ORACLE_SQL["op1_warc_captures"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT *, list_transform([1, 11, 21, 31], lambda a: CAST('0x' || substr(sha1(t), a, 10) AS BIGINT)) AS parts FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform(range(8), lambda d: {_DIGIT}), '')), '')
         AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
FROM h"""


@_query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(read_table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 100 == 0)


ORACLE_SQL["op2_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@_query
def op3_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id"):
    """Documents that the language classifier may not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> langid.Hierarchy:
    return langid.fit(docs.where(~held_out()), salt=["doc_id", "text"])


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return langid.identify(slim, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in secrets.RULES]))

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secrets.RULES]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("secret_spans")).alias("spans"))


def _duck_spans(rank: int, rule: secrets.Rule) -> str:
    """DuckDB twin of one rule: text between the matches, and the matches, by place."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
      SELECT doc_id, row_id, {rank} AS rank, '{rule.kind}' AS kind,
             unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
               's': list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0),
               'n': length(hits[i]), 'part': length(parts[i])}})) AS m
      FROM (SELECT doc_id, row_id, string_split_regex(t, '{pattern}') AS gaps,
                   regexp_extract_all(t, '{pattern}', 0) AS hits,
                   regexp_extract_all(t, '{pattern}', {rule.group}) AS parts FROM d)"""


ORACLE_SQL["op5_secret_scan"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_duck_spans(i, r) for i, r in enumerate(secrets.RULES))}),
k AS (SELECT row_id, rank, kind, CAST(m.s AS BIGINT) AS a, CAST(m.s + m.n AS BIGINT) AS z FROM m
      WHERE m.part >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.min_chars}" for r in secrets.RULES)} END),
g AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans
      FROM k GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_id)"""


#: A conversation of two turns that say nothing but control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@_query
def op6_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(CONTROL_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))))))
    out = chat.format_trees(chat.chain_by_turn(rows.unionByName(extra)))
    read = out.select("conv", "formatted", chat.parsed_turns(F.col("formatted")).alias("turns"),
                      F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL = r"[<\[]\\*(?:/?s>|/?INST\]|</?SYS>>)"
ORACLE_SQL["op6_chat_reply_trees"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
                + length(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), 'nn'))
                + len(regexp_extract_all(role, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@_query
def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


URL_RULES = [
    UrlRule("||com/", allow=True),
    UrlRule("||example.com/en/"),
    UrlRule("||www.example.com/en/", allow=True),
    UrlRule("||net/es/"),
    UrlRule("||net/fr/"),
]


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).drop("url")


ORACLE_SQL["op8_url_filter"] = f"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
       ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS row_id, page_id,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT row_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
             arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (row_id)"""


@_query
def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(filter_order, before, bit, step) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT p.filter_order || f.letter, p.before | p.bit, f.bit, p.step + 1 FROM p JOIN f ON (p.before | p.bit) & f.bit = 0),
s AS (SELECT m.part, p.filter_order AS prefix, p.step,
             count(*) FILTER (m.mask & (before | bit) = 0) AS kept,
             count(*) FILTER (m.mask & bit <> 0 AND m.mask & before = 0) AS removed,
             count(*) FILTER (m.mask & bit <> 0 AND m.mask & before <> 0) AS redundant,
             count(*) FILTER (m.mask = bit) AS unique_fails,
             count(*) FILTER (m.mask & bit <> 0 AND m.mask & before = 0 AND good = 1) AS good_lost,
             count(*) FILTER (m.mask & bit <> 0 AND m.mask & before = 0 AND toxic = 1) AS toxic_lost
      FROM m, p WHERE p.step > 0 GROUP BY ALL),
o AS (SELECT o.filter_order, s.* EXCLUDE (prefix) FROM p o JOIN s ON o.step = 5 AND starts_with(o.filter_order, s.prefix))
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM o"""


@_query
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 50 == 0)


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read_table(spark, sf_dir, "embeddings"), keep=["label"])
    codes = staged(codes, "coded")
    totals = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("__label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _vector_rounds(rounds: int, parts: int = 8, entries: int = 16) -> str:
    """CTEs a0, b1, a1, ...: nearest entries of every part, and the next codebooks."""
    steps = []
    for r in range(rounds + 1):
        if r:
            steps.append(f"""
b{r} AS MATERIALIZED (SELECT o.part, o.entry, o.k, coalesce(m.c, o.c) AS c FROM b{r - 1} o LEFT JOIN (
      SELECT x.part, a.entry, x.k, CAST(floor(CAST(sum(x.c) AS DOUBLE) / count(*)) AS BIGINT) AS c
      FROM x JOIN a{r - 1} a USING (row_id, part) GROUP BY ALL) m USING (part, entry, k))""")
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row_id, part, d // {entries} AS dist, d % {entries} AS entry FROM (
      SELECT row_id, part, min(dist * {entries} + entry) AS d FROM (
        SELECT x.row_id, x.part, b.entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS dist
        FROM x JOIN b{r} b USING (part, k) GROUP BY ALL) GROUP BY ALL))""")
    return ",".join(steps)


ORACLE_SQL["op13_vector_codes"] = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row_id, vec_id, label, embedding AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row_id, (i - 1) * 8 // len(e) AS part, i AS k, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS c
      FROM (SELECT row_id, e, unnest(range(1, len(e) + 1)) AS i FROM v)),
b0 AS (SELECT part, row_id - 1 AS entry, k, c FROM x WHERE row_id <= 16),{_vector_rounds(6)},
o AS (SELECT row_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
      FROM a6 GROUP BY row_id),
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN o USING (row_id), s"""
