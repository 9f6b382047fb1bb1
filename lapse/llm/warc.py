"""WARC archives: writing pages as captures and assembling captures from records.

A capture is three records: a request, a response (or a revisit, if another
page has the same payload) and metadata.  Request and metadata name the
response they belong to in ``WARC-Concurrent-To``.

Archives are written as text whose rows end in the two line ends that close a
WARC record, and read as text whose rows are cut at the version line that
opens one.  So large uncompressed archives are split between tasks, compressed
ones are streamed, and no task ever holds a whole archive.  A payload that
itself contains a version line is put together again by the lengths that the
records give (see ``read_records``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm.common import is_empty, staged, worker_path

OPEN = "WARC/1.0\r\n"
END = "\r\n\r\n"
CRLF = "\r\n"
#: Hex digits in groups of ten are eight base-32 digits; fixed values.
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_DIGITS, BASE32_LETTERS)


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, payload_digest,
    refers_to, refers_to_uri): of the pages with equal payloads of at least
    ``min_bytes`` the one with the largest id is the response (refers_to is
    null), the others revisit it.  Rows repeated under that id are all
    responses.  A null id is smaller than any other; if all are null, all are
    responses.  A null payload is empty."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    plain = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                         payload.alias("payload"))
    plain = plain.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                               "payload_digest": sha1_base32(F.col("payload"))})
    # Staged, so that the join below sees its size and can split a payload that very many pages share.
    shared = staged(
        plain.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("top")).where("n > 1")
        .select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("top.page_id").alias("top_id"),
                F.col("top.url").alias("top_url")),
        "payloads",
    )
    revisit = F.col("top_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    return plain.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("top_id")).alias("refers_to"), F.when(revisit, F.col("top_url")).alias("refers_to_uri"))


def _one_line(value: Column) -> Column:
    """Header values keep to their line: line ends are percent-coded, and what
    already looks like such a code gets one more 25."""
    safe = F.regexp_replace(value, "%((?:25)*0[AaDd])", "%25$1")
    return F.replace(F.replace(safe, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _whole_line(value: Column) -> Column:
    plain = F.replace(F.replace(value, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r"))
    return F.regexp_replace(plain, "%25((?:25)*0[AaDd])", "%$1")


def _record(kind: Column, record_id: Column, uri: Column, extra: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line ends, as a string of its bytes."""
    lines = [F.lit(OPEN + "WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id,
             F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri]
    for name, value in extra:  # null: no such line
        lines.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write classified pages (see ``classify``) as WARC archives below
    ``path``, one per task, three records per page.  Nothing is collected: a
    page is one row from the scan to the file."""
    ident = pages.withColumn("uuid", F.uuid())
    names = {k: F.concat(F.lit("<urn:uuid:"), F.col("uuid"), F.lit(f"-{k}>")) for k in ("request", "response", "metadata")}
    uri = _one_line(F.col("url"))
    is_revisit = F.col("refers_to_uri").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    page_id = ("X-Page-Id", F.col("page_id").cast("string"))
    concurrent = ("WARC-Concurrent-To", names["response"])
    request = _record(F.lit("request"), names["request"], uri, [concurrent, page_id],
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")))
    response = _record(
        F.when(is_revisit, "revisit").otherwise("response"), names["response"], uri,
        [page_id, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
         ("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
         ("WARC-Refers-To-Target-URI", _one_line(F.col("refers_to_uri"))),
         ("WARC-Refers-To-Date", F.when(is_revisit, DATE)),
         ("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))],
        F.when(is_revisit, head).otherwise(F.concat(head, F.col("payload").cast("string"))))
    metadata = _record(F.lit("metadata"), names["metadata"], uri, [concurrent, page_id],
                       F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)))
    rows = ident.select(F.concat_ws(END, request, response, metadata).alias("value"))
    rows.write.option("lineSep", END).option("compression", compression).text(path)


def _header(head: Column, name: str) -> Column:
    """Value of a header line; null if there is none."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.lower(head).contains(name.lower() + ":"), F.when(found != "", found))


def _repaired(parts: DataFrame) -> DataFrame:
    """Fragments of archives in which a payload holds a version line, joined
    into whole records.  Only lengths are brought together by archive; the
    bytes are joined record by record."""
    worker_path(parts.sparkSession)
    mark = len(OPEN)
    narrow = parts.select("file", "block", "seq", F.octet_length("value").alias("size"),
                          F.octet_length("head").alias("head_size"), "length")

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "seq"])
        out, head, missing = [], 0, 0
        for i, (size, head_size, length) in enumerate(zip(pdf["size"], pdf.head_size, pdf.length, strict=True)):
            if missing > 0:
                missing -= size + mark
            else:
                head = i
                missing = 0 if pd.isna(length) else head_size + length + 8 - size
            out.append(head)
        return pdf[["file", "block", "seq"]].assign(record=out, at=range(len(pdf)))

    at = narrow.groupBy("file").applyInPandas(heads, "file string, block long, seq long, record long, at long")
    joined = parts.select("file", "block", "seq", "value").join(at, ["file", "block", "seq"])
    whole = joined.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
    return whole.select(F.array_join(F.transform("all", lambda x: x["value"]), OPEN).alias("value"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: warc_type,
    record_id, concurrent_to (array), uri, page_id, refers_to, digest, body
    (binary: the block) and its http_head, payload, payload_bytes and
    payload_digest (of a response: of the payload read; of a revisit: the one
    stated).  Missing and empty header lines are null; what is no record (junk
    before the first one) is left out.

    A record whose block is shorter than its Content-Length was cut at a
    version line inside the payload; the archives with such a record, and only
    those, are put together again by lengths."""
    raw = spark.read.option("lineSep", OPEN).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq")).where(F.octet_length("value") > 0)
    head = F.substring_index("value", END, 1)
    length = _header(head, "Content-Length").try_cast("long")
    parts = raw.withColumns({"head": head, "length": length})
    whole = F.octet_length("value") == F.octet_length("head") + F.col("length") + len(END) + len(END)
    bad = staged(parts.where(~F.coalesce(whole, F.lit(False))).select("file").distinct(), "cut")
    rows = parts.select("value")
    if not is_empty(bad):
        rows = parts.join(bad, "file", "left_anti").select("value").unionByName(
            _repaired(parts.join(bad, "file", "left_semi")))
    return _parsed(rows)


def _payload() -> Column:
    """What follows the HTTP head of a response."""
    start = (F.octet_length("http_head") + len(END) + 1).cast("int")
    return F.when(F.col("warc_type") == "response", F.substring(F.col("body"), start, F.octet_length("body")))


def _parsed(rows: DataFrame) -> DataFrame:
    head = F.substring_index("value", END, 1)
    data = F.col("value").cast("binary")
    first = (F.octet_length(head) + len(END) + 1).cast("int")
    cut = rows.select(head.alias("head"), F.substring(data, first, _header(head, "Content-Length").try_cast("int")).alias("body"))
    kind = _header(F.col("head"), "WARC-Type")
    http = F.substring_index(F.col("body").cast("string"), END, 1)
    with_head = cut.select("head", "body", F.when(kind.isin("response", "revisit", "request"), http).alias("http_head"),
                           kind.alias("warc_type"))
    ids = F.regexp_extract_all("head", F.lit(r"(?i)\r\nWARC-Concurrent-To:[ \t]*([^\r\n]+)"), F.lit(1))
    parsed = with_head.where("warc_type is not null").select(
        "warc_type", _header(F.col("head"), "WARC-Record-ID").alias("record_id"), ids.alias("concurrent_to"),
        _whole_line(_header(F.col("head"), "WARC-Target-URI")).alias("uri"),
        _header(F.col("head"), "X-Page-Id").try_cast("long").alias("page_id"),
        _header(F.col("head"), "X-Refers-To-Page-Id").try_cast("long").alias("refers_to"),
        F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        "body", "http_head", _payload().alias("payload"))
    is_response = F.col("warc_type") == "response"
    return parsed.withColumns({
        "payload_bytes": F.when(is_response, F.octet_length("payload").cast("long")).otherwise(
            _header(F.col("http_head"), "Content-Length").try_cast("long")),
        "payload_digest": F.when(is_response, sha1_base32(F.col("payload"))).otherwise(F.col("digest"))})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id (the record id of its response
    or revisit), response, request, metadata, n_requests, n_metadata.

    Request and metadata records belong to the response that they name in
    WARC-Concurrent-To, or that is named by a record which they name, or that
    names them.  Of several requests (or metadata records) of one capture the
    one with the smallest record id is shown; all are counted.  A response
    without them has nulls there; requests and metadata of no response come
    out as captures of their own under their own id, with a null response.
    Records without an id count as having an empty one.  The payload is taken
    from the body: ``records`` may come without it."""
    rows = records.withColumns({"record_id": F.coalesce("record_id", F.lit("")), "payload": _payload()})
    anchor = F.col("warc_type").isin("response", "revisit")
    sidekick = F.col("warc_type").isin("request", "metadata")
    # Which record belongs to which: from the ids alone, read from the archives once.
    ids = staged(rows.where(anchor | sidekick).select("record_id", "warc_type", "concurrent_to"), "links")
    slim = ids.where(sidekick)
    anchors = ids.where(anchor).select(F.col("record_id").alias("target")).distinct()
    direct = slim.select("record_id", F.explode("concurrent_to").alias("target")).join(anchors, "target")
    named = ids.where(anchor).select(F.explode("concurrent_to").alias("named"), F.col("record_id").alias("target"))
    known = direct.select("record_id", "target").unionByName(named.select(F.col("named").alias("record_id"), "target"))
    linked = staged(known.groupBy("record_id").agg(F.min("target").alias("target")), "linked")
    rest = slim.join(linked.select(F.col("record_id").alias("r")), F.col("record_id") == F.col("r"), "left_anti")
    via = rest.select("record_id", F.explode("concurrent_to").alias("other")).join(
        linked.select(F.col("record_id").alias("other"), "target"), "other")
    owner = staged(linked.unionByName(via.groupBy("record_id").agg(F.min("target").alias("target"))), "owners")
    main = rows.where(anchor).select(
        F.col("record_id").alias("capture_id"), "warc_type", "uri", "page_id", "refers_to", "payload_digest", "http_head",
        "payload", "payload_bytes")
    side = rows.where(sidekick).select("record_id", F.col("warc_type").alias("kind"), "uri", F.col("page_id").alias("side_page"), "body")
    sides = side.join(owner.withColumnRenamed("record_id", "r"), F.col("record_id") == F.col("r"), "left").select(
        F.coalesce("target", "record_id").alias("cid"), "kind",
        F.struct("record_id", "uri", F.col("side_page").alias("page_id"), "body").alias("rec"))
    by_capture = sides.groupBy("cid").agg(
        F.min(F.when(F.col("kind") == "request", F.col("rec"))).alias("request"),
        F.min(F.when(F.col("kind") == "metadata", F.col("rec"))).alias("metadata"),
        F.count(F.when(F.col("kind") == "request", 1)).alias("n_requests"),
        F.count(F.when(F.col("kind") == "metadata", 1)).alias("n_metadata"))
    response = F.when(F.col("capture_id").isNotNull(), F.struct(
        F.col("warc_type").alias("record_type"), "uri", "page_id", "refers_to", "payload_digest", "http_head", "payload",
        "payload_bytes"))
    return main.join(by_capture, F.col("capture_id") == F.col("cid"), "full").select(
        F.coalesce("capture_id", "cid").alias("capture_id"), response.alias("response"), "request", "metadata",
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))
