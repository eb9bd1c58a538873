"""WARC derivative builder: metadata and plain-text conversion records of responses.

Every response record gets a ``conversion`` record (its HTML as plain text) and a
``metadata`` record (fields about both), each naming the response in WARC-Refers-To and
keeping its target URI, date, HTTP headers and payload digest; the metadata record also
names the conversion.  A response's id derives from its page id, URL and payload digest, the
others from it, so reruns agree and the links hold without a join.  One narrow pass: no shuffle, and a record's text stays in its
row.

Defined results: a null payload is an empty one; a null URI, date or header gives no such
line; repeated responses give repeated derivatives; extra columns are ignored.
"""
from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import python_ready, tidied

DATE = "2024-01-01T00:00:00Z"
_DROPPED = r"(?is)<(?:!--.*?--|script\b.*?</script\s*|style\b.*?</style\s*)>"
_BLOCK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre"
          r"|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>")
_TAG = r"<[!/?a-zA-Z][^>]*>"


def plain_text(page: Column) -> Column:
    """Struct (text, words) of HTML: comments, scripts and styles dropped, block tags as
    line ends, other tags dropped, white space collapsed, entities decoded once, lines
    trimmed and empty ones dropped."""

    def finish(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            texts = ["\n".join(filter(None, (x.strip(" ") for x in html.unescape(t).split("\n")))) for t in texts]
            words = [sum(map(bool, t.replace("\n", " ").split(" "))) for t in texts]
            yield pd.DataFrame({"text": texts, "words": words})

    text = F.regexp_replace(F.coalesce(page, F.lit("")), _DROPPED, "")
    text = F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")  # a single space stays as it is
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _TAG, "")
    return F.pandas_udf(tidied(finish), "text string, words long")(text)


def record_id(kind: Column | str, *keys: Column) -> Column:
    """A urn:uuid derived from ``keys``, in which null and empty differ."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    h = F.md5(F.concat_ws("|", kind, *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in keys]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages: ``record_id, target_uri, date, http_headers, payload,
    payload_digest`` with the page's id.  The table has no headers and no date of its own:
    they say what any such response would, and ``date`` is the caller's."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col(id_col).alias("page_id"), record_id("response", F.col(id_col), F.col(url_col), _digest(payload)).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"),
        _digest(payload).alias("payload_digest"))


def derive(sources: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Two rows for every response: its ``metadata`` and ``conversion`` records."""
    python_ready(sources.sparkSession)
    keep = keep or []
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = sources.select(*keep, "record_id", "target_uri", "date", "http_headers", "payload_digest",
                          plain_text(payload).alias("plain"))
    rows = rows.withColumn("text_digest", _digest(F.col("plain.text")))
    meta_id, text_id = record_id("metadata", F.col("record_id")), record_id("conversion", F.col("record_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat_ws(
        "", line("source-record-id", F.col("record_id")), line("source-payload-digest", F.col("payload_digest")),
        line("source-http-headers", F.regexp_replace("http_headers", "\r\n", " | ")), line("conversion-record-id", text_id),
        line("conversion-block-digest", F.col("text_digest")), line("conversion-words", F.col("plain.words").cast("string")))

    def record(kind: str, own_id: Column, mime: str, block: Column, digest: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), own_id.alias("id"), F.lit(mime).alias("content_type"), block.alias("block"), digest.alias("digest"))

    both = F.array(record("metadata", meta_id, "application/warc-fields", fields, _digest(fields)),
                   record("conversion", text_id, "text/plain; charset=utf-8", F.col("plain.text"), F.col("text_digest")))
    return rows.withColumn("r", F.explode(both)).select(
        *keep, "r.record_type", F.col("r.id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers",
        "payload_digest", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), F.col("r.digest").alias("block_digest"), "r.block")


def serialised(records: DataFrame) -> DataFrame:
    """One column: the records as WARC/1.1 text (without the two closing line ends)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat_ws(
        "", F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")))
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one a task."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
