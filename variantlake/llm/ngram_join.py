"""N-gram Jaccard self-join by MinHash banding.

Documents are sets of hashed word n-grams; two documents link when the Jaccard
similarity of their sets reaches the threshold.  Bands and rows are chosen for a target
recall at that threshold, reps are shuffled on their band hashes, and candidate pairs
are verified on the full n-gram sets.

Steps (``ngram_join``):

1. one pass hashes every text to its set, a 128-bit digest of the set and its band
   hashes; only the slim part is stored.  Documents with equal sets (exact copies and
   copies up to case and spacing) become one representative with a count, by a map-side
   combined aggregation: copies are never paired.
2. representatives are dealt out by band hash.  Buckets of several representatives are
   cut into blocks of about ``BLOCK``; a *cell* is a pair of blocks, so a hot bucket is
   many small cells.  A pair belongs to the first band on which it agrees, and only
   members with a pair of their own in a cell go on.
3. the texts of these are fetched once more, and their sets travel to the cells, where
   all pairs are verified.  A cell returns one row per linked member (its link count and
   the smallest digest of its local cluster), never the pairs.
4. link counts are summed, clusters are joined to classes by alternating large-star and
   small-star steps on stored edges.

Defined results: words are the lower-cased runs of non-space characters; a text of fewer
than n words has one n-gram (all its words); a text without words (or null) links to
nothing and is its own class.  Repeated rows and null ids are documents like others.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, stored

BLOCK = 256
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """word -> 64-bit hash, for one task; emptied when full."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value



def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): most rows per band - fewest false candidates - whose bands reach
    ``recall`` for a pair at ``threshold`` within ``max_hashes`` hash functions."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{max_hashes} hashes cannot reach recall {recall} at {threshold}")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_set(text: str | None, n: int, hashes_of: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(hashes_of.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    grams = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        grams = grams * _PRIME + hashes[j : len(words) - k + 1 + j]
    return np.unique(_mix(grams))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band (salted with the band's number) over its rows' minima."""
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * a + b
        low = np.minimum(low, part.min(axis=0) >> np.uint64(16))
    low = low.reshape(bands, rows)
    folded = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        folded = _mix(folded * _PRIME + low[:, r])
    return folded.view(np.int64)


def _digest(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by ``keys``, cut so that no key crosses batches, with the
    starts of the keys' runs (and the end)."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        cuts = _cuts(pdf, keys)
        last = cuts[-2] if len(cuts) > 1 else 0
        held = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last], cuts[:-1]
    if held is not None and len(held):
        held = held.reset_index(drop=True)
        yield held, _cuts(held, keys)


def _cuts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def _own_pairs(bands: np.ndarray, bucket: int, sizes: np.ndarray, block: np.ndarray, cross: bool,
               threshold: float) -> np.ndarray:
    """Boolean matrix (i < j) of a cell's own candidate pairs: no band before this one
    agrees, and the set sizes allow the threshold."""
    m = len(bands)
    own = np.triu(np.ones((m, m), bool), 1)
    if cross:
        own &= block[:, None] != block[None, :]
    own &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    at = np.flatnonzero((bands == bucket).all(axis=0))
    if not len(at):  # equal hashes of different bands: nothing agrees here
        return np.zeros((m, m), bool)
    for b in range(at[0]):
        own &= bands[:, b][:, None] != bands[:, b][None, :]
    return own


def _cells(pdf: pd.DataFrame, cuts: np.ndarray, threshold: float):
    """(start, end, own-pair matrix) of every cell that has own pairs."""
    bands = np.vstack(pdf["bands"].to_numpy())
    bucket, sizes = pdf["bucket"].to_numpy(), pdf["n_grams"].to_numpy()
    block, cross = pdf["block"].to_numpy(), (pdf["cell_i"] != pdf["cell_j"]).to_numpy()
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e - s < 2:
            continue
        if e - s == 2:  # the usual cell, without matrices
            small, large = sorted((sizes[s], sizes[s + 1]))
            if small < threshold * large or (cross[s] and block[s] == block[s + 1]):
                continue
            same = bands[s] == bands[s + 1]
            if bands[s][same.argmax()] == bucket[s] and same.any():
                yield s, e, np.array([[False, True], [False, False]])
            continue
        own = _own_pairs(bands[s:e], bucket[s], sizes[s:e], block[s:e], cross[s], threshold)
        if own.any():
            yield s, e, own


def _linked(sets: list[np.ndarray], own: np.ndarray, threshold: float) -> np.ndarray:
    """The own pairs whose full n-gram sets reach the threshold."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return own & (both >= threshold * (sizes.sum() - both) - 1e-9)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes))
    mark = np.zeros(len(ids), bool)
    linked = np.zeros_like(own)
    for i in np.flatnonzero(own.any(axis=1)):
        mine = ids[starts[i] : starts[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[ids], starts[:-1], dtype=np.int64)
        mark[mine] = False
        linked[i] = own[i] & (both >= threshold * (sizes[i] + sizes - both) - 1e-9)
    return linked


def _clusters(linked: np.ndarray) -> np.ndarray:
    """Smallest member index of each member's connected cluster."""
    root = np.arange(len(linked))
    i, j = np.nonzero(linked)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)``; root is the smallest node of its
    component.  Alternating large-star and small-star steps; each round's edges are
    stored, so no lineage grows and nothing but a count and a checksum reaches the driver."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(found)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
               threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key`` (md5 of the text), ``class_key``
    (smallest set digest of its class, hex; null without words), ``class_id`` (smallest
    doc_id of the class), ``n_links`` (other documents at or above the threshold, copies
    counted), ``n_text_links`` (the same, equal n-gram sets counted once)."""
    n_bands, n_rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("text_key", F.md5(F.col("text")))
    kind = docs.schema["doc_id"].dataType

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in batches:
            sets = [ngram_set(t, n, words) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "digest": [_digest(s) for s in sets],
                "n_grams": [len(s) for s in sets],
                "bands": [band_hashes(s, n_bands, n_rows) if len(s) else None for s in sets]})

    # ids travel as strings: pandas would round long ids of a batch with a null
    slim = map_batches(keyed.withColumn("doc_id", F.col("doc_id").cast("string")), hashed,
                       "doc_id string, text_key string, digest binary, n_grams long, bands array<long>")
    slim = stored(slim.withColumn("doc_id", F.col("doc_id").cast(kind)), "ngram-slim")
    reps = stored(
        slim.where("digest is not null").groupBy("digest").agg(
            F.min(F.struct("doc_id", "text_key")).alias("home"), F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        "ngram-reps")

    # cells: (bucket, block pair) with the members they compare
    dealt = reps.select("digest", F.explode("bands").alias("bucket"))
    shared = (dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    cells = (
        dealt.join(shared, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        .select("digest", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("digest", "bucket", "block", F.least("block", "other").alias("cell_i"), F.greatest("block", "other").alias("cell_j"))
    )
    cell = ["bucket", "cell_i", "cell_j"]

    def owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _runs(batches, cell):
            keep = np.zeros(len(pdf), bool)
            for s, e, own in _cells(pdf, cuts, threshold):
                keep[s:e] = own.any(axis=0) | own.any(axis=1)
            yield pdf.loc[keep, ["digest", *cell, "block"]]

    placed = cells.join(reps.select("digest", "n_grams", "bands"), "digest")
    owned = stored(map_batches(placed.repartition(*cell).sortWithinPartitions(*cell), owners,
                               "digest binary, bucket long, cell_i int, cell_j int, block int"), "ngram-owned")

    # full sets of the representatives that have something to verify
    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for pdf in batches:
            pdf["grams"] = [ngram_set(t, n, words).tobytes() for t in pdf["text"]]
            yield pdf.drop(columns="text")

    wanted = owned.select("digest").distinct().join(reps, "digest").select(
        "digest", "n_grams", "bands", "copies", F.col("home.doc_id").alias("home_id"), F.col("home.text_key").alias("home_key"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("home_id")) & (F.col("text_key") == F.col("home_key"))).select(
        "digest", "n_grams", "bands", "copies", "text")
    sets = map_batches(texts, with_sets, "digest binary, n_grams long, bands array<long>, copies long, grams binary").dropDuplicates(["digest"])

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _runs(batches, cell):
            digest, copies, grams = pdf["digest"].to_numpy(), pdf["copies"].to_numpy(), pdf["grams"].to_numpy()
            rows: list[tuple] = []
            for s, e, own in _cells(pdf, cuts, threshold):
                linked = _linked([np.frombuffer(g, np.uint64) for g in grams[s:e]], own, threshold)
                if not linked.any():
                    continue
                linked |= linked.T
                order = np.argsort(digest[s:e], kind="stable")
                root = digest[s:e][order][_clusters(linked[np.ix_(order, order)])]
                back = np.empty(e - s, np.int64)
                back[order] = np.arange(e - s)
                for i in np.flatnonzero(linked.any(axis=1)):
                    rows.append((digest[s + i], root[back[i]], int(copies[s:e][linked[i]].sum()), int(linked[i].sum())))
            yield pd.DataFrame(rows, columns=["digest", "root", "links", "text_links"])

    found = stored(map_batches(owned.join(sets, "digest").repartition(*cell).sortWithinPartitions(*cell), verified,
                               "digest binary, root binary, links long, text_links long"), "ngram-links")

    links = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "digest")
    classes = (
        reps.select("digest", "first_id", "copies").join(links, "digest", "left").join(roots, "digest", "left")
        .withColumn("root", F.coalesce("root", "digest")))
    firsts = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = classes.join(firsts, "root").select(
        "digest", F.lower(F.hex("root")).alias("class_key"), "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"))
    worded = slim.where("digest is not null").select("doc_id", "text_key", "digest").join(classes, "digest").drop("digest")
    empty = slim.where("digest is null").select(
        "doc_id", "text_key", F.lit(None).cast("string").alias("class_key"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return worded.unionByName(empty)


def one_per_class(docs: DataFrame, joined: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of ``ngram_join``'s result: the one with
    the smallest (id, text key); documents without words all stay.  Of repeated rows with
    equal id and text one stays."""
    worded = joined.where("class_key is not null")
    kept = worded.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"))).alias("k"))
    kept = kept.select("k.k_id", "k.k_key")
    marked = docs.withColumn("_key", F.md5(F.col(text_col)))
    held = marked.join(kept, F.col(id_col).eqNullSafe(F.col("k_id")) & (F.col("_key") == F.col("k_key"))).drop("k_id", "k_key")
    held = held.dropDuplicates([id_col, "_key"]).drop("_key")
    worded_text = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return held.unionByName(docs.where(~worded_text))
