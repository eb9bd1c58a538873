"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents are tokenised, closed with a separator id, and cut only where they exceed the
capacity.  Packing needs the lengths alone: Spark counts the pieces of each length, the
plan is made on this histogram (at most ``capacity`` rows, whatever the corpus), and
pieces get their place by their rank among pieces of equal length.

The plan first fixes dominating sets (Martello and Toth): for a length j, a set {j}, {j, k}
or {j, k, b} is fixed when every other feasible bin with j could be exchanged for it
without needing more bins.  What no rule settles is packed best-fit, longest first.  Equal
lengths move in bulk, so the work follows the number of distinct lengths.

Tokenising splits texts at ASCII white space and does each distinct word of a group of
texts once, with a bounded per-task table of what was done before.  Its normaliser, pre-tokeniser and merges
never look across white space, so the ids are those of the whole text.  Words that are a
run of Latin letters and a tail of punctuation are two pre-tokens and are encoded apart.

Defined results: a null text is empty and gives the one separator id.  Repeated rows are
documents like others.  Every piece lands in exactly one sequence; offsets are gapless.
"""
from __future__ import annotations

import functools
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlake.llm.common import hand_back, python_ready, rank_in_group, stored, tidied

CAPACITY = 2048
SEPARATOR = 0
GROUP_BYTES = 1_000_000
ENCODED_WORDS = 512


class _WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes.

    What the tokenizer had to do is kept in two generations of bounded size: when the
    young one is full it becomes the old one, and words met again move back, so frequent
    words stay while rare ones are dropped.
    """

    LIMIT = 200_000
    _TAIL = b".,;:!?"

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.young, self.old, self.tails = _tokenizer(path), {}, {}, {}
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the (distinct) words.

        A run of Latin letters and a tail of punctuation are encoded apart, as the
        pre-tokeniser does; other words whole.
        """
        found: list = []
        whole = []
        tail_of, get = self._TAIL, self.young.get
        for at, word in enumerate(words):
            core = word.rstrip(tail_of)
            ids = get(low := core.lower())
            if ids is None:
                ids = self._letters(low)
                get = self.young.get  # a new generation may have begun
            if ids:
                found.append(ids if len(core) == len(word) else ids + self._tail(word[len(core) :]))
            else:
                found.append(b"")
                whole.append(at)
        for at, ids in zip(whole, self._encoded([words[at] for at in whole])):
            found[at] = ids
        return found

    def _letters(self, low: bytes) -> bytes:
        """Ids of a lower-cased run of letters - one pre-token, so only the byte mapping
        and the merges are left to do; empty for anything else."""
        ids = self.old.get(low)
        if ids is None:
            word = low.decode("utf-8", "surrogatepass")
            if not _plain(word):
                return self._keep(low, b"")
            word = word if word.isascii() else self.byte_level.pre_tokenize_str(word.lower())[0][0]
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        return self._keep(low, ids)

    def _keep(self, key: bytes, ids: bytes) -> bytes:
        if len(self.young) >= self.LIMIT:
            self.old, self.young = self.young, {}
        self.young[key] = ids
        return ids

    def _tail(self, tail: bytes) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._encoded([tail])[0]
            if len(self.tails) < 4096:
                self.tails[tail] = ids
        return ids

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        found: list[bytes] = []
        for at in range(0, len(words), ENCODED_WORDS):  # an encoding takes many times its ids' memory
            part = [w.decode("utf-8", "surrogatepass") for w in words[at : at + ENCODED_WORDS]]
            found += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return found


def _plain(word: str) -> bool:
    """Letters of the Latin blocks only, where normalising and lower-casing go letter by letter."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(texts: pa.Array, table: _WordIds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids with separators, end of each text in them) of groups of consecutive texts."""
    size = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), 1).cumsum()
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES, "right")))
        words = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, end - at), "").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        found = [*table.ids(distinct), np.array([SEPARATOR], "<u4").tobytes()]
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # word numbers of the texts with the separator's number after each text
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(per)
        number = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), stops, len(distinct))
        ends = np.cumsum(length[number])
        ids = np.frombuffer(b"".join(map(found.__getitem__, number.tolist())), "<u4")
        yield ids, ends[stops + np.arange(len(per))]
        at = end


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordIds(path)  # goes with the task
        for batch in batches:
            at, doc, piece, start, length, crc = 0, [], [], [], [], []
            for ids, ends in tokenised(batch.column("text"), table):
                raw, begin = memoryview(ids).cast("B"), 0
                for end in ends.tolist():
                    for k, s in enumerate(range(begin, end, capacity)):
                        e = min(end, s + capacity)
                        doc.append(at)
                        piece.append(k)
                        start.append(s - begin)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    begin, at = end, at + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
            hand_back()  # else the word table's new entries keep the freed memory between them

    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Multiset of lengths with ordered lookups."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length, m in Counter(lengths).items():
            self.n[length] -= m * times
            if not self.n[length]:
                del self.n[length]
                self.keys.pop(bisect_left(self.keys, length))

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.n.get(length, 0) // m for length, m in Counter(lengths).items())

    def largest(self, limit: int, used: tuple[int, ...]) -> int | None:
        """Largest length up to ``limit`` that is left besides ``used``."""
        for i in range(bisect_right(self.keys, limit) - 1, -1, -1):
            if self.n[self.keys[i]] > used.count(self.keys[i]):
                return self.keys[i]
        return None

    def smallest(self, count: int, used: tuple[int, ...]) -> int | None:
        """Sum of the ``count`` smallest lengths besides ``used``; None if there are fewer."""
        total = 0
        for k in self.keys:
            m = min(count, self.n[k] - used.count(k))
            total, count = total + m * k, count - m
            if not count:
                return total
        return None


def _dominating(left: _Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates all feasible bins with ``j``, if a rule proves one."""
    room = capacity - j
    k = left.largest(room, (j,))
    if k is None:
        return (j,)  # nothing fits beside j
    two, three = left.smallest(2, (j,)), left.smallest(3, (j,))
    if k == room or two is None or two > room:
        return (j, k)  # k fills the bin, or no two fit: any bin's rest fits in place of k
    if three is None or three > room:
        # at most two more fit: {x, y}, x >= y, has x <= k and y <= room / 2
        b = left.largest(room - k, (j, k))
        half = left.largest(room // 2, (j,))
        if b is not None and (half is None or b >= half):
            return (j, k, b)
    return None


def reduce_and_pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(bins as (lengths, how many such bins), number of bins that the reduction fixed)."""
    left, bins, fixed = _Lengths(counts), [], 0
    for j in sorted(left.n, reverse=True):
        while left.n.get(j) and (found := _dominating(left, j, capacity)) is not None:
            times = left.times(found)
            left.take(found, times)
            bins.append((found, times))
            fixed += times
    return bins + _best_fit(dict(left.n), capacity), fixed


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with equal bins and equal lengths moved in bulk."""
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, bins]
    gaps: list[int] = []

    def add(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if gap not in open_ or not open_[gap]:
            at = bisect_left(gaps, gap)
            if at == len(gaps) or gaps[at] != gap:
                gaps.insert(at, gap)
        open_[gap].append([lengths, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at < len(gaps):  # fullest bins with room: one more each
                gap = gaps[at]
                bin_ = open_[gap][-1]
                m = min(n, bin_[1])
                bin_[1] -= m
                if not bin_[1]:
                    open_[gap].pop()
                    if not open_[gap]:
                        gaps.pop(at)
                add(gap - length, (*bin_[0], length), m)
                n -= m
            else:  # new bins, as full of this length as they get
                per = capacity // length
                if n >= per:
                    add(capacity - per * length, (length,) * per, n // per)
                    n %= per
                else:
                    add(capacity - n * length, (length,) * n, 1)
                    n = 0
    return [(lengths, n) for group in open_.values() for lengths, n in group if n]


def placements(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces per sequence, offset)."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in bins:
        offset = 0
        for length, m in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, rank[length], rank[length] + n * m, sequence, m, offset))
            rank[length] += n * m
            offset += m * length
        sequence += n
    return rows


def pack(found: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark: SparkSession = found.sparkSession
    rows = stored(found.withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    bins, _ = reduce_and_pack(counts, capacity)
    plan = spark.createDataFrame(placements(bins) or [(0, 0, 0, 0, 1, 0)],
                                 "_len long, _from long, _to long, _seq long, _per long, _at long")
    ranked = rank_in_group(rows, ["length"], [F.col("_rid")], "_rank")
    inside = F.col("_rank") - F.col("_from")
    return (
        ranked.join(plan, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", (F.col("_seq") + F.floor(inside / F.col("_per"))).cast("long"))
        .withColumn("offset", (F.col("_at") + (inside % F.col("_per")) * F.col("length")).cast("long"))
        .select(*found.columns, "sequence_id", "offset"))
