"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is cut into 1, 4, 16 and 32 segments; with the mean and deviation of each
segment the squared distance of two vectors is at least
``sum(len * ((m1 - m2)^2 + (s1 - s2)^2))``, and so, by
``2 <q, x> = |q|^2 + |x|^2 - d^2``, their inner product is at most
``sum(len * (m1 * m2 + s1 * s2))``.  Candidates are bounded coarse to fine, and exact
products are computed for the survivors only.

1. Rows are dealt into *blocks* of bounded size: the signs of random projections, seeded by
   the vector length, keep similar vectors together, and a sign pattern with many rows is
   split by a hash of the row.
2. Each block is read once.  It yields the ranges of its members' segment statistics, and
   for each query that lives there a threshold: the k-th best exact product at home.  The
   k-th best of all rows is no worse, so the threshold holds everywhere.
3. Groups of queries (of one home) meet the ranges of all blocks; a block whose ranges bound
   every product below every threshold of the group is never sent to it.
4. The remaining (group, block) *cells* go through the levels.  Cells return at most k rows a
   query, merged by rank.

Both sides of a cell are bounded, whatever the table's size.  Statistics are made where they
are used: that takes one pass over a cell's vectors, less than they would cost to move.
``survival`` tells how many pairs each level left.

Defined results: vectors that are null or hold a null or non-finite component take no
part; vectors meet those of their own length only; a row never meets itself, repeated
rows meet each other; ties go to the smaller id, null ids last; ids may repeat.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantlake.llm.common import map_batches, python_ready, stored

CELL_NUMBERS = 1 << 20  # components of a cell's candidates; its queries are an eighth
SEGMENTS = (1, 4, 16, 32)
BLOCK_SEGMENTS = 16  # resolution of a block's ranges
BOXES_PER_TASK = 4096
MOST_BITS = 40
QUERY_STEP = 128
GATHER = 16  # a product of gathered rows costs about as much as so many in one matrix product
BLOCK, GROUP = ["dim", "bucket", "salt"], ["dim", "q_bucket", "q_salt", "q_part"]
FOUND = "q_rid long, query_id long, rid long, vec_id long, no_id boolean, score long, level int, pairs long"


def segment_features(x: np.ndarray, n_segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the dot product of two rows
    bounds the vectors' inner product from above."""
    edges = np.unique(np.linspace(0, x.shape[1], min(n_segments, x.shape[1]) + 1).astype(int))
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
    means = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    deviations = [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(means + deviations, axis=1) if parts else np.zeros((len(x), 1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def sign_bucket(x: np.ndarray, bits: int) -> np.ndarray:
    """The signs of ``bits`` projections of each row, as one number."""
    axes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], MOST_BITS))[:, :bits]
    return (x @ axes > 0).astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def home_thresholds(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query (a position in ``x``) with the other rows."""
    least = np.full(len(queries), -np.inf)
    if len(x) > k:
        for at in range(0, len(queries), QUERY_STEP):
            own = queries[at : at + QUERY_STEP]
            score = x[own] @ x.T
            score[np.arange(len(own)), own] = -np.inf
            least[at : at + len(own)] = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
    return least


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the dot products of each row of ``q`` with any row in each range."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def survivors_only(a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The products of rows of ``a`` and ``b`` where ``left``, -inf elsewhere: all at once
    while many are left, else pair by pair."""
    if np.count_nonzero(left) * GATHER > left.size:
        return np.where(left, a @ b.T, -np.inf)
    out = np.full(left.shape, -np.inf)
    for row, keep, to in zip(a, left, out):
        pos = np.flatnonzero(keep)
        to[pos] = b[pos] @ row
    return out


def left_over(a: np.ndarray, b: np.ndarray, left: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """The pairs of ``left`` whose bound is at least ``bar``."""
    return left & (survivors_only(a, b, left) >= bar[:, None])


def cell_top(q: np.ndarray, least: np.ndarray, x: np.ndarray, own: list[np.ndarray], ids: np.ndarray, k: int):
    """For each query the positions and scores of its best ``k`` candidates with a score of at
    least ``least``, and the number of pairs each level left; ``own``: the positions of the
    query's own row, ``ids``: the order among ties."""
    qf, xf = [segment_features(q, s) for s in SEGMENTS], [segment_features(x, s) for s in SEGMENTS]
    slack = 1e-9 * _norms(q) * max(1.0, float(_norms(x).max(initial=0)))
    found, survivors = [], np.zeros(len(SEGMENTS), np.int64)
    for at in range(0, len(q), QUERY_STEP):
        step = slice(at, at + QUERY_STEP)
        bar = least[step].copy()
        coarse = qf[0][step] @ xf[0].T + slack[step, None]
        for i, bound in enumerate(coarse):
            bound[own[at + i]] = -np.inf
            if not np.isfinite(bar[i]) and len(x) > k:  # home was too small
                first = np.argpartition(-bound, k - 1)[:k]
                if np.isfinite(bound[first]).all():
                    bar[i] = np.sort(x[first] @ q[at + i])[0]
        left = (coarse >= bar[:, None]) & (coarse > -np.inf)
        survivors[0] += np.count_nonzero(left)
        for level, (a, b) in enumerate(zip(qf[1:], xf[1:]), 1):
            left = left_over(a[step], b, left, bar - slack[step])
            survivors[level] += np.count_nonzero(left)
        score = survivors_only(q[step], x, left)
        left &= score >= bar[:, None]
        for keep, row in zip(left, score):
            pos = np.flatnonzero(keep)
            best = np.lexsort((ids[pos], -row[pos]))[:k]
            found.append((pos[best], row[pos[best]]))
    return found, survivors


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float) -> tuple[DataFrame, DataFrame]:
    """(queries with their homes, what the cells found)."""
    python_ready(vectors.sparkSession)
    vec = F.col(vector_col)
    fit = vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = stored(
        vectors.where(fit).select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("vec_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
            F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"),
            F.size(vec).alias("dim"), F.monotonically_increasing_id().alias("rid")), "vectors")

    # 1. blocks
    room = F.greatest(F.lit(256), F.floor(F.lit(CELL_NUMBERS) / F.greatest("dim", F.lit(1)))).cast("long")
    lengths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("dim").alias("b_dim"), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / room)))).cast("int").alias("bits"))
    wide = rows.join(lengths, F.col("dim") == F.col("b_dim")).drop("b_dim")  # one row per vector length

    def place(batches):
        for pdf in batches:
            pdf["bucket"] = np.int64(0)
            for (dim, bits), at in pdf.groupby(["dim", "bits"]).groups.items():
                if dim and bits:
                    pdf.loc[at, "bucket"] = sign_bucket(_matrix(pdf.loc[at, "vec"]), bits)
            yield pdf[["rid", "bucket"]]

    buckets = map_batches(wide.select("rid", "dim", "bits", "vec"), place, "rid long, bucket long")
    placed = stored(rows.join(buckets, "rid"), "vectors_placed")
    sizes = placed.groupBy("dim", "bucket").agg(
        F.ceil(F.count(F.lit(1)) / F.first(room)).cast("int").alias("n_salts"),
        F.ceil(8 * F.count_if("is_query") / F.first(room)).cast("int").alias("n_parts")).select(
            F.col("dim").alias("s_dim"), F.col("bucket").alias("s_bucket"), "n_salts", F.greatest(F.lit(1), F.ceil(F.col("n_parts") / F.col("n_salts"))).cast("int").alias("n_parts"))
    blocks = placed.join(sizes, (F.col("dim") == F.col("s_dim")) & (F.col("bucket") == F.col("s_bucket"))).select(
        "rid", "vec_id", "no_id", "is_query", "vec", "dim", "bucket",
        F.pmod(F.xxhash64("rid"), "n_salts").cast("int").alias("salt"),
        F.pmod(F.xxhash64("rid", F.lit(1)), "n_parts").cast("int").alias("part"))

    # 2. ranges and thresholds
    def visit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["vec"])
        f = segment_features(x, BLOCK_SEGMENTS)
        at = np.flatnonzero(pdf["is_query"].to_numpy(bool))
        least = home_thresholds(x, at, k)
        wide = float(_norms(x).max())
        box = pd.DataFrame([{"low": f.min(axis=0), "high": f.max(axis=0), "reach": wide}])
        mine = pd.DataFrame({"rid": pdf["rid"].to_numpy()[at], "part": pdf["part"].to_numpy()[at], "low": list(f[at]), "high": list(f[at]), "least": least, "reach": _norms(x)[at]})
        out = pd.concat([box.astype("object"), mine.astype("object")])  # objects: ids stay exact beside a null
        return out.assign(dim=key[0], bucket=key[1], salt=key[2]).reindex(columns=["dim", "bucket", "salt", "rid", "part", "low", "high", "least", "reach"])

    visited = stored(
        blocks.select("rid", "part", "is_query", "vec", *BLOCK).groupBy(*BLOCK).applyInPandas(
            visit, "dim int, bucket long, salt int, rid long, part int, low array<double>, high array<double>, least double, reach double"), "blocks")
    boxes = visited.where("rid is null").select(*[F.col(c).alias(c) for c in (*BLOCK, "low", "high", "reach")])
    queries = visited.where("rid is not null").select(
        "dim", F.col("bucket").alias("q_bucket"), F.col("salt").alias("q_salt"), F.col("part").alias("q_part"), "rid", "low", "least", "reach")

    # 3. cells: a group of queries keeps the blocks that may beat one of its thresholds
    chunks = max(1, -(-boxes.count() // BOXES_PER_TASK))
    spread = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    groups = queries.select(*[F.col(c).alias(c) for c in GROUP]).distinct()
    dealt = boxes.withColumn("chunk", F.pmod(F.xxhash64("bucket", "salt"), F.lit(chunks)).cast("int")).join(groups, "dim")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*GROUP, "bucket", "salt"])
        bound = box_bounds(_matrix(left["low"]), _matrix(right["low"]), _matrix(right["high"]))
        slack = 1e-9 * left["reach"].to_numpy()[:, None] * np.maximum(1.0, right["reach"].to_numpy())
        keep = (bound + slack >= left["least"].to_numpy()[:, None]).any(axis=0)
        return right.loc[keep, [*GROUP, "bucket", "salt"]]

    cells = stored(
        spread.groupBy(*GROUP, "chunk").cogroup(dealt.groupBy(*GROUP, "chunk")).applyInPandas(
            meet, "dim int, q_bucket long, q_salt int, q_part int, bucket long, salt int"), "cells")

    # 4. the levels
    ask = queries.select(F.col("rid").alias("a_rid"), "least")
    asking = blocks.where("is_query").join(ask, F.col("rid") == F.col("a_rid")).select(
        "dim", F.col("bucket").alias("q_bucket"), F.col("salt").alias("q_salt"), F.col("part").alias("q_part"), "rid", "vec_id", "vec", "least").join(cells, GROUP)
    asked = blocks.select("rid", "vec_id", "no_id", "vec", *BLOCK).join(cells, BLOCK)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q_rid", "query_id", "rid", "vec_id", "no_id", "score", "level", "pairs"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        q, x = _matrix(left["vec"]), _matrix(right["vec"])
        rid, vec_id, no_id = (right[c].to_numpy() for c in ("rid", "vec_id", "no_id"))
        by_id = np.lexsort((rid, vec_id, no_id))
        order = np.empty(len(by_id), np.int64)
        order[by_id] = np.arange(len(by_id))
        at = {r: i for i, r in enumerate(rid)}
        own = [np.array([at[r]] if r in at else [], np.int64) for r in left["rid"]]
        tops, survivors = cell_top(q, left["least"].to_numpy(), x, own, order, k)
        n = [len(pos) for pos, _ in tops]
        pos, score = (np.concatenate([t[i] for t in tops]).astype(np.int64) for i in (0, 1))
        found = pd.DataFrame({"q_rid": np.repeat(left["rid"].to_numpy(), n), "query_id": np.repeat(left["vec_id"].to_numpy(), n),
                              "rid": rid[pos], "vec_id": vec_id[pos], "no_id": no_id[pos], "score": score})
        levels = pd.DataFrame({"level": SEGMENTS, "pairs": survivors})
        return pd.concat([found.astype("object"), levels.astype("object")]).reindex(columns=names)

    cell = [*GROUP, "bucket", "salt"]
    asking, asked = (side.select(*[F.col(c).alias(c) for c in names]) for side, names in (
        (asking, ["rid", "vec_id", "vec", "least", *cell]), (asked, ["rid", "vec_id", "no_id", "vec", *cell])))  # columns of their own
    return rows, asking.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q_rid").orderBy(F.col("score").desc(), "no_id", "vec_id", "rid")
    return found.where("q_rid is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")


def top_k(vectors: DataFrame, *, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's ``k`` best by inner product of
    ``floor(scale * x)``; scores are exact below 2^53."""
    return _ranked(_search(vectors, is_query, k, id_col, vector_col, scale)[1], k)


def survival(vectors: DataFrame, *, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
             scale: float = 64.0) -> DataFrame:
    """(level, pairs, share): pairs of a query and a candidate of its length, left by the
    bounds of each number of segments; level 0 counts all pairs."""
    rows, found = _search(vectors, is_query, k, id_col, vector_col, scale)
    per = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("nq"))
    every = per.agg(F.coalesce(F.sum(F.col("nq") * (F.col("n") - 1)), F.lit(0)).alias("every"))  # a single row
    left = found.where("level is not null").groupBy("level").agg(F.sum("pairs").alias("pairs"))
    levels = left.unionByName(every.select(F.lit(0).alias("level"), F.col("every").alias("pairs")))
    total = F.max(F.when(F.col("level") == 0, F.col("pairs"))).over(Window.partitionBy(F.lit(0)))  # one row per level
    return levels.withColumn("share", F.when(total > 0, F.col("pairs") / total))
