"""Quality rules with cross-document line frequency.

One pass over the texts measures each document and hashes its normalised lines (each line
once a document).  Lines are counted as distinct documents per host; those above the
limits are boilerplate.  A document loses its boilerplate lines, and one that is left with
too little is rejected.

A line is above the limits when more than ``max_docs`` documents of its host have it,
however large the host, or more than ``min_docs`` and more than ``max_share`` of them.  A document
is depleted when fewer than ``min_words`` words or less than ``min_left`` of its words
remain.  Counting combines on the map side, so a line or host with a third of all rows is
an ordinary key there; removals join the few boilerplate lines to the stored line hashes,
an inner equi-join whose large side adaptive execution may split.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a null text has none and fails
the base rules; lines without a word are neither counted nor removed; a null host is a
host of its own; repeated rows are documents of their own.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, python_ready, stored, text_words

SYMBOLS = "#*$%&|<>"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def normal_line(line: str) -> str:
    """Lower-cased, white space collapsed and trimmed, digit runs as ``0``."""
    return _DIGITS.sub("0", _SPACE.sub(" ", line).strip(" ").lower())


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(normal_line(line).encode("utf-8", "surrogatepass"))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:n]
    for j in range(1, window):
        _, code = np.unique(code * len(number) + ids[j : n + j], return_inverse=True)
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    covered = np.zeros(len(words), bool)
    for j in range(window):
        covered[twice + j] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line keys, words per line key)."""
    text = text or ""
    words = text_words(text)
    lines: dict[bytes, int] = {}
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if not _WORD.search(line):
            continue
        dups += line in seen
        seen.add(line)
        key = line_key(line)
        lines[key] = lines.get(key, 0) + len(text_words(line))
    blanks = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dups, repeated_words(words), list(lines), list(lines.values()))


def _frequent(max_docs: int, max_share: float) -> Column:
    """Whether ``n`` of the host's ``n_docs`` documents are above the limits."""
    return (F.col("n") > max_docs) | (F.col("n") > F.col("n_docs") * max_share)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10,
            max_docs: int = 100, max_share: float = 0.01, min_words: int = 20, min_left: float = 0.5) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``n_removed_words`` (words in
    boilerplate lines), ``depleted`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([measure(t if isinstance(t, str) else None) for t in pdf["text"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "host", pdf["host"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    kind = docs.schema[id_col].dataType
    measured = map_batches(rows, run, "doc_id string, host string, " + ", ".join(f"{n} long" for n in names[:5]) + ", lines array<binary>, line_words array<long>")
    measured = stored(measured.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("rid", F.monotonically_increasing_id()), "line-measures")

    lines = measured.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "rid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("host", "h")
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(min_docs, max_docs))
    frequent = stored(
        counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(_frequent(max_docs, max_share))
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line")), "frequent-lines")
    removed = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
        .groupBy("rid").agg(F.sum("words").alias("n_removed_words")))
    left = F.col("n_words") - F.col("n_removed_words")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.drop("lines", "line_words").join(removed, "rid", "left").fillna(0, ["n_removed_words"])
        .withColumn("base_failed", base_failed)
        .withColumn("depleted", (F.col("n_removed_words") > 0) & ((left < min_words) | (left < F.col("n_words") * min_left)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("rid"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text column without the lines whose keys are in ``removed`` (array<binary>)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keys in batches:
            out = []
            for t, k in zip(texts, keys):
                gone = set(map(bytes, k)) if k is not None else set()
                out.append(None if t is None else "\n".join(x for x in t.split("\n") if not (_WORD.search(x) and line_key(x) in gone)))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, removed)


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10,
            max_docs: int = 100, max_share: float = 0.01) -> DataFrame:
    """``docs`` with the text stripped of its host's boilerplate lines (rows as they are).

    The boilerplate lines of a host - at most all its lines divided by ``min_docs`` - reach
    its documents as one array.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, k) for h, t in zip(pdf["host"], pdf["text"]) if isinstance(t, str)
                    for k in {line_key(x) for x in t.split("\n") if _WORD.search(x)}]
            yield pd.DataFrame(rows, columns=["host", "line"])

    texts = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("host", "h")
    counts = map_batches(texts, run, "host string, line binary").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    gone = (
        counts.where(F.col("n") > min(min_docs, max_docs)).join(hosts, F.col("host").eqNullSafe(F.col("h")))
        .where(_frequent(max_docs, max_share))
        .groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_gone")))
    joined = docs.join(gone, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    return joined.withColumn(text_col, without_lines(F.col(text_col), F.col("_gone"))).select(*docs.columns)
