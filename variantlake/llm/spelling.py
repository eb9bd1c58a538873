"""Spelling variant grouping by dynamic programming over the sorted vocabulary.

Words one edit apart share their first half or their last half (half of the shorter one,
rounded down), so the vocabulary is sorted twice, by word and by reversed word, and each
list is range-partitioned into blocks of about ``BLOCK`` words.  A block is scanned by the
words that can meet one of its own: adjacent words with a common prefix of length ``d``
share the rows 0..d of the edit matrix, so one banded row (three cells around the diagonal)
stands for a whole range of the list; it is extended by one letter for each subrange, and a
range is skipped as soon as its row exceeds one edit.  The same scan over the blocks'
common prefixes says which blocks a word goes to, so a prefix with very many words costs
each of them a few blocks only.  All rows of a depth are computed together for a few
thousand words.

A pair is counted once: by the forward list if the first halves agree, else by the reversed
one.  Scans return one row per word and block (number of near words, the best one), never
pairs.  Forms are followed to the last by joins that double the distance each round; counts
grow tenfold along a chain, so there are few.

Defined results: null texts have no words, a null id is the empty string; words are
compared by code points; ties go to the smaller word in code-point order; a word without
near words stands alone; an empty table gives an empty one.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, python_ready, stored

LETTERS = r"A-Za-zÀ-ÿ"
BLOCK = 20_000
CELL_QUERIES = 60_000
CHUNK = 4_096
FAR = 9  # a cell outside the band or beyond the word
TOP = "\U0010ffff"


class _Codes:
    """Strings as one array of code points."""

    def __init__(self, strings: list[str]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(("".join(strings) + "\0").encode("utf-32-le", "surrogatepass"), np.int32)

    def at(self, i: np.ndarray, d: int) -> np.ndarray:
        """Code point ``d`` of strings ``i``; -1 outside."""
        ok = (d < self.length[i]) & (d >= 0)
        return np.where(ok, self.flat[np.where(ok, self.start[i] + d, 0)], -1)


class SortedList(_Codes):
    """Sorted distinct strings with the lengths of their common prefixes with the one before."""

    def __init__(self, words: list[str]):
        super().__init__(words)
        self.words = words
        self.lcp = np.full(len(words), -1, np.int64)
        left, d = np.arange(1, len(words)), 0
        while left.size:
            a = self.at(left, d)
            same = (a == self.at(left - 1, d)) & (a >= 0)
            self.lcp[left[~same]] = d
            left, d = left[same], d + 1


def scan(queries: list[str], listed: SortedList, prefixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) positions of all words exactly one edit away that share the first
    ``(length - 1) // 2`` letters; with ``prefixes``, of all entries that are, or are within
    one edit of, the beginning of such a word."""
    q = _Codes(queries)
    shared = np.maximum(q.length - 1, 0) // 2
    heads = [s[:k] for s, k in zip(queries, shared.tolist())]
    first = np.array([bisect_left(listed.words, h) for h in heads], np.int64)
    last = np.array([bisect_right(listed.words, h + TOP) for h in heads], np.int64)
    waiting = np.flatnonzero(first < last)
    waiting = waiting[np.argsort(shared[waiting], kind="stable")]
    found_q, found_w = [], []
    node = [np.zeros(0, np.int64)] * 6  # query, first and last word of the range, band at -1, 0, 1
    d = 0
    while waiting.size or node[0].size:
        if not node[0].size:
            d = int(shared[waiting[0]])
        come = waiting[: np.searchsorted(shared[waiting], d, "right")]
        waiting = waiting[come.size:]
        one = np.ones(come.size, np.int64)
        node = [np.concatenate(x) for x in zip(node, (come, first[come], last[come], one if d else one * FAR, one * 0, one))]
        who, lo, hi = node[:3]
        # subranges: a new one begins where the common prefix with the word before is d at most
        starts = np.append(np.flatnonzero(listed.lcp <= d), len(listed.words))
        s0, s1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        n = s1 - s0
        up = np.repeat(np.arange(n.size), n)
        at = np.arange(up.size) - np.repeat(np.cumsum(n) - n, n) + s0[up]
        who, lo, hi = who[up], starts[at], starts[at + 1]
        a, b, c = (x[up] for x in node[3:])
        size = q.length[who]
        ended = listed.length[lo] == d
        if ended.any():
            off = size[ended] - d
            hit = np.full(off.size, True) if prefixes else np.choose(np.clip(off + 1, 0, 2), [a[ended], b[ended], c[ended]]) == 1
            hit &= prefixes | (np.abs(off) <= 1)
            found_q.append(who[ended][hit])
            found_w.append(lo[ended][hit])
            who, lo, hi, a, b, c, size = (x[~ended] for x in (who, lo, hi, a, b, c, size))
        letter = listed.at(lo, d)
        new_a = np.where(size >= d, np.minimum(b + 1, a + (letter != q.at(who, d - 1))), FAR)
        new_b = np.where(size >= d + 1, np.minimum(np.minimum(c, new_a) + 1, b + (letter != q.at(who, d))), FAR)
        new_c = np.where(size >= d + 2, np.minimum(new_b + 1, c + (letter != q.at(who, d + 1))), FAR)
        keep = np.minimum(np.minimum(new_a, new_b), new_c) <= 1
        node = [x[keep] for x in (who, lo, hi, new_a, new_b, new_c)]
        d += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_q or none), np.concatenate(found_w or none)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least_count: int = 2,
                drop_one_in: int = 31) -> DataFrame:
    """``word, n`` over all texts: runs of letters, A-Z lower-cased; where the CRC of
    ``id:run`` is divisible by ``drop_one_in``, letter number CRC modulo length goes."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))  # shorter runs never qualify
    low = F.translate("run", ascii_uppercase, ascii_lowercase)
    crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("low")))
    at = (F.col("crc") % F.char_length("low")).cast("int")
    cut = F.concat(F.col("low").substr(F.lit(1), at), F.col("low").substr(at + 2, F.char_length("low")))
    words = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run")).select("id", low.alias("low")).withColumn("crc", crc)
        .select(F.when(F.col("crc") % drop_one_in == 0, cut).otherwise(F.col("low")).alias("word")))
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _blocks(listed: DataFrame) -> list[tuple[int, str, str]]:
    """(block, smallest, largest key): one row per ``BLOCK`` words."""
    found = listed.groupBy("block").agg(F.min("key"), F.max("key")).collect()
    return sorted((tuple(r) for r in found), key=lambda r: r[1])


def _routed(keys: DataFrame, blocks: list[tuple[int, str, str]]) -> DataFrame:
    """(block, key) of every block that may hold a near word of ``key``."""
    lows, highs = [b[1] for b in blocks], [b[2] for b in blocks]
    ids = np.array([b[0] for b in blocks], np.int64)
    by_prefix: dict[str, list[int]] = {}
    for i, (_, low, high) in enumerate(blocks):
        by_prefix.setdefault(commonprefix([low, high]), []).append(i)
    names = sorted(by_prefix)
    outer = {p for p in by_prefix}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = SortedList(names)
        for pdf in batches:
            every = pdf["key"].tolist()
            for at in range(0, len(every), CHUNK):
                queries = every[at: at + CHUNK]
                who, where = scan(queries, listed, prefixes=True)
                hits = [(i, names[w]) for i, w in zip(who.tolist(), where.tolist())]
                out_q, out_b = [], []
                for i, s in enumerate(queries):  # entries shorter than the shared half
                    hits += [(i, s[:k]) for k in range((len(s) - 1) // 2) if s[:k] in outer]
                span = [(bisect_left(highs, s[: (len(s) - 1) // 2]), bisect_right(lows, s[: (len(s) - 1) // 2] + TOP)) for s in queries]
                for i, p in hits:
                    for b in by_prefix[p]:
                        if span[i][0] <= b < span[i][1]:
                            out_q.append(queries[i])
                            out_b.append(b)
                yield pd.DataFrame({"block": ids[np.array(out_b, np.int64)], "key": out_q})

    return map_batches(keys, route, "block int, key string")


def _near_in(listed: DataFrame, backwards: bool) -> DataFrame:
    """``word, n_near, best_n, best`` per word and block of a stored list ``(key, n, block)``."""
    python_ready(listed.sparkSession)
    routed = stored(_routed(listed.select("key"), _blocks(listed)), "spelling-queries")
    slices = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("slices"))
    slice_of = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    slices = F.broadcast(slices)  # one row per block
    left = routed.join(slices, "block").withColumn("slice", slice_of).select("block", "slice", "key")
    right = listed.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        F.col("block").alias("block"), F.col("slice").alias("slice"), F.col("key").alias("key"), F.col("n").alias("n"))

    def meet(queries: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("key")
        names, n = words["key"].tolist(), words["n"].to_numpy()
        listed_words, every = SortedList(names), sorted(queries["key"].tolist())
        out = []
        for at in range(0, len(every), CHUNK):
            part = every[at: at + CHUNK]
            rows = []
            for i, j in zip(*(x.tolist() for x in scan(part, listed_words))):
                a, b = part[i], names[j]
                half = min(len(a), len(b)) // 2
                if (a[len(a) - half:] != b[len(b) - half:]) if backwards else (a[:half] == b[:half]):
                    rows.append((a, int(n[j]), b))
            if rows:
                pairs = pd.DataFrame(rows, columns=["word", "best_n", "best"])
                if backwards:
                    pairs["word"], pairs["best"] = pairs["word"].str[::-1], pairs["best"].str[::-1]
                pairs["n_near"] = pairs.groupby("word")["word"].transform("size")
                out.append(pairs.sort_values(["word", "best_n", "best"], ascending=[True, False, True]).drop_duplicates("word"))
        return pd.concat(out)[["word", "n_near", "best_n", "best"]] if out else pd.DataFrame(columns=["word", "n_near", "best_n", "best"])

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(meet, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every stored ``(word, n)`` that has a near word."""
    blocks = max(1, -(-words.count() // BLOCK))

    def listed(key: Column, name: str) -> DataFrame:
        return stored(words.select(key.alias("key"), "n").repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), name)

    found = _near_in(listed(F.col("word"), "spelling-words"), False).unionByName(_near_in(listed(F.reverse("word"), "spelling-reversed"), True))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every ``(word, form)``: the end of its chain."""
    rows = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = rows.select(F.col("word").alias("u_word"), F.col("root").alias("u_root"))
        rows = stored(rows.join(up, F.col("root") == F.col("u_word"), "left").select(
            "word", F.coalesce("u_root", "root").alias("root"), F.col("u_root").isNotNull().alias("moved")), "spelling-roots")
        if rows.where("moved").isEmpty():
            return rows.select("word", "root")
        rows = rows.select("word", "root")


def variants(words: DataFrame, *, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``(word, n)``: the form is the most frequent
    near word, if it occurs ``times`` as often as the word."""
    words = stored(words.select("word", "n"), "spelling-vocabulary")
    near = near_words(words).select(F.col("word").alias("near_word"), "n_near", "best_n", "best")
    found = stored(words.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(found.where(F.col("form").isNotNull())).select(F.col("word").alias("root_word"), "root")
    return found.join(roots, F.col("word") == F.col("root_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
