"""Centroid clustering with heap-ordered bounds.

A vector's *gap* is the lower bound of its distance to every other centroid less the upper
bound of its distance to its own.  When centroids move, the gaps of a cluster's vectors
shrink by at most the cluster's own drift plus the largest drift of another centroid, the
same for all of them; so a heap holds ``gap + drift of the cluster until then``, which never
changes, and a round pops the vectors whose key is below the drift accumulated by now.
Only those are rescanned against all centroids, exactly, and pushed with their new gap.

The heaps are written tables: every round appends one *layer* of the vectors it rescanned,
sorted by (cluster, key) within each task, and never touches older ones.  A vector counts in
the layer where its key is still above its cluster's drift; the ones to pop have keys
between the drift of the last round and that of this one, a range that Parquet's statistics
prune.  Sums of clusters are kept up to date by the vectors that moved.  Between rounds the
driver holds clusters x dimensions numbers and nothing that grows with the rows.

Components are integers ``floor(scale * x)``, so distances and sums are exact (below 2^53
for a distance; larger ones are rounded, and cut at 2^63 - 1).  Ties go to the smaller
cluster: a vector whose gap is not clearly positive is always popped.

Defined results: only vectors of exactly ``dim`` finite components take part; repeated rows
are vectors like others, and may start several centroids; null ids start a centroid only
when there are too few others; with fewer vectors than clusters there are as many clusters
as vectors; an empty table gives an empty one; empty clusters keep their centroid.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, stored

MOST_NUMBERS = 1 << 22  # components of all centroids, which travel with every task
LARGEST = 2**63 - 1


@dataclass
class Clusters:
    """``layers``: (rid, vec, cluster, key) tables; ``drift``: what each cluster's keys must
    exceed; ``popped``: rows rescanned in every assignment, the first one included."""

    centroids: list[list[int]]
    layers: list[DataFrame]
    drift: list[float]
    popped: list[int]


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact for integers as long as they stay below 2^53."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1), 0)


def _rescanned(rows: DataFrame, centroids: list[list[int]], drift: list[float]) -> DataFrame:
    """``rows(rid, vec, old)`` with the nearest cluster and the key of its heap."""
    c, moved = np.array(centroids, float), np.array(drift)
    size = float(np.sqrt((c * c).sum(axis=1)).max(initial=0))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy())
            d = _distances(x, c)
            own = d.argmin(axis=1)
            upper = np.sqrt(d[np.arange(len(d)), own])
            d[np.arange(len(d)), own] = np.inf
            gap = np.sqrt(d.min(axis=1, initial=np.inf)) - upper
            slack = 1e-9 * (1 + size + np.sqrt((x * x).sum(axis=1)))  # of all rounding, now and in the drift
            yield pd.DataFrame({"rid": pdf["rid"], "vec": pdf["vec"], "old": pdf["old"], "cluster": own.astype(np.int32), "key": gap - slack + moved[own]})

    found = map_batches(rows, scan, "rid long, vec array<double>, old int, cluster int, key double")
    return found.sortWithinPartitions("cluster", "key")


def _below(drift: list[float]) -> Column:
    """Keys that have expired at ``drift``: one range a cluster, so scans skip the rest."""
    return reduce(lambda a, b: a | b, [(F.col("cluster") == j) & (F.col("key") <= d) for j, d in enumerate(drift)])


def _sums(rows: DataFrame, clusters: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact component sums and counts that ``rows(vec, cluster, old)`` add to each cluster
    and take from the old ones: summed per batch, then per (cluster, component)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.stack(pdf["vec"].to_numpy()), np.ones(len(pdf))])
            total = np.zeros((clusters, dim + 1))
            np.add.at(total, pdf["cluster"].to_numpy(), x)
            was = pdf["old"].to_numpy()
            np.subtract.at(total, was[was >= 0], x[was >= 0])
            j, at = np.nonzero(total)
            yield pd.DataFrame({"cluster": j, "at": at, "total": total[j, at]})

    parts = map_batches(rows.select("vec", "cluster", "old"), add, "cluster int, at int, total double")
    sums = [[0] * (dim + 1) for _ in range(clusters)]
    for j, at, total in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        sums[j][at] = int(total)
    return np.array([s[:-1] for s in sums], object).reshape(clusters, dim), np.array([s[-1] for s in sums], object)


def starts(vectors: DataFrame, n_clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest ``sha256(seed:id)``, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(rank.asc_nulls_last(), "vec").limit(n_clusters).select("vec").collect()
    return [[int(v) for v in r[0]] for r in first]


def fit(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> Clusters:
    """``rounds`` of assignment and update over stored ``vectors(rid, vec)``, then one more assignment."""
    k, dim = len(centroids), len(centroids[0])
    if k * dim > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dim} components do not travel with tasks")
    state = Clusters(centroids, [], [0.0] * k, [])
    rows = vectors.select("rid", "vec", F.lit(-1).alias("old"))
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    for turn in range(rounds + 1):
        state.layers.append(stored(_rescanned(rows, state.centroids, state.drift), f"heap-{turn}"))
        layer = state.layers[-1]
        state.popped.append(layer.count())
        if turn == rounds:
            return state
        more, n = _sums(layer.where("old <> cluster"), k, dim)
        sums, counts = sums + more, counts + n
        new = [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, state.centroids)]
        step = [float(np.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(p, q)))) for p, q in zip(new, state.centroids)]
        other = [max([0.0, *step[:j], *step[j + 1:]]) for j in range(k)]
        before, state.centroids = state.drift, new
        state.drift = [(d + a + b) * (1 + 1e-12) for d, a, b in zip(before, step, other)]
        older = [heap.where(_below(state.drift) & ~_below(before)) for heap in state.layers[:-1]]
        expired = [*older, layer.where(_below(state.drift))]  # the newest also holds gaps that were never positive
        rows = reduce(DataFrame.unionByName, [e.select("rid", "vec", F.col("cluster").alias("old")) for e in expired])
    return state


def assigned(state: Clusters) -> DataFrame:
    """(rid, cluster, distance) of every vector: rows of the newest layer, and those of older
    layers that have not been popped."""
    c = np.array(state.centroids, float)
    last = len(state.layers) - 1
    kept = [layer if i == last else layer.where(~_below(state.drift)) for i, layer in enumerate(state.layers)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            off = np.stack(pdf["vec"].to_numpy()) - c[pdf["cluster"].to_numpy()]
            d = (off * off).sum(axis=1)
            yield pd.DataFrame({"rid": pdf["rid"], "cluster": pdf["cluster"], "distance": np.where(d < 2.0**63, d, 0).astype(np.int64) + np.where(d < 2.0**63, 0, LARGEST)})

    rows = reduce(DataFrame.unionByName, [k.select("rid", "vec", "cluster") for k in kept])
    return map_batches(rows, measure, "rid long, cluster int, distance long")


def cluster(vectors: DataFrame, *, n_clusters: int = 16, dim: int = 64, rounds: int = 3, scale: float = 64.0, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance`` of every vector with ``cluster_inertia, inertia`` and
    ``centroid_sha256`` of its cluster."""
    vec = F.col(f"`{vector_col}`")
    fit_for = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stored(vectors.where(F.coalesce(fit_for, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), integers(vec, scale).alias("vec")), "cluster-vectors")
    first = starts(rows, n_clusters, seed)
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").select(
            F.col("vec_id").cast(rows.schema["id"].dataType), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    state = fit(rows, first, rounds)
    found = stored(assigned(state), "clustered")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    whole = min(LARGEST, sum(inertia.values()))
    about = [(j, min(LARGEST, inertia.get(j, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(state.centroids)]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(rows.select("rid", F.col("id").alias("vec_id")), "rid").join(F.broadcast(about), "cluster")  # one row a cluster
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
