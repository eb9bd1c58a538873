"""K-d tree sharding: leaves of near equal bytes over metadata dimensions.

A node that stands for ``k`` shards is split along its widest dimension (range relative
to the root's) at the weighted quantile that leaves ``k // 2`` shards' bytes on one side,
until every leaf is one shard.  With a power of two this is the weighted median.  Numbers
are dimensions as they are, strings by the dense rank of their distinct values.

Quantiles are distributed: all nodes of a level search together, and each pass sums bytes
in ``BINS`` ranges of every node's bracket; the driver sees nodes x bins sums and narrows
the brackets until at most ``FEW`` rows are left, which the next pass names.  Rows are ordered by (dimension, hash of the row,
row number), so ties of any size - a source with a third of all rows, thousands of
copies - are split like anything else.  The tree has fewer than two nodes a shard, so it travels
with the tasks; rows are read from a stored slim table and never sorted as a whole.

Defined results: null texts have no bytes; null dimensions come just before the smallest
value; repeated rows are rows like others; of an empty table nothing is returned.  Shards
may be empty when there are fewer rows than shards.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from variantlake.llm.common import map_batches, rank_in_group, stored
from variantlake.operators.ranking import group_index

BINS = 512
FEW = 1024  # rows of a bracket that the driver may see one by one
LEAST = -(2**63)


@dataclass
class _Node:
    """A node and the state of its search; ``key`` is the bracket's level: 0 the
    dimension, 1 the row hash, 2 the row number, with the ones before fixed."""

    first: int  # shards [first, first + count)
    count: int
    dim: int = 0
    key: int = 0
    low: int = 0
    high: int = 0
    few: bool = False
    fixed: list[int] = field(default_factory=list)
    before: float = 0.0  # bytes of the node below the bracket
    goal: float = 0.0  # bytes wanted on the left side
    cut: tuple[int, int, int] | None = None  # first row of the right side, in key order
    left: int = -1
    right: int = -1

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))


class _Tree:
    """Nodes as arrays; rows are ``values`` (dimensions x rows), ``tie`` and ``rid``."""

    def __init__(self, nodes: list[_Node], searching: list[int] = ()):
        self.left, self.right, self.dim, self.key = (np.array([getattr(n, c) for n in nodes], np.int64) for c in ("left", "right", "dim", "key"))
        self.low, self.high = (np.array([getattr(n, c) for n in nodes], np.int64) for c in ("low", "high"))
        self.cut = np.array([n.cut or (0, 0, 0) for n in nodes], np.int64)
        self.fixed = np.array([[*n.fixed, 0, 0][:2] for n in nodes], np.int64)
        self.width = np.array([n.width for n in nodes], np.uint64)
        self.few = np.array([n.few for n in nodes])
        self.searching = np.isin(np.arange(len(nodes)), list(searching))

    def place(self, values: np.ndarray, tie: np.ndarray, rid: np.ndarray) -> np.ndarray:
        """Node of every row: all rows go down a level at a time."""
        at = np.zeros(len(tie), np.int64)
        here = np.flatnonzero(self.left[at] >= 0)
        while here.size:
            i = at[here]
            v, t, r = values[self.dim[i], here], tie[here], rid[here]
            a, b, c = self.cut[i].T
            left = (v < a) | ((v == a) & ((t < b) | ((t == b) & (r < c))))
            at[here] = np.where(left, self.left[i], self.right[i])
            here = here[self.left[at[here]] >= 0]
        return at

    def brackets(self, values: np.ndarray, tie: np.ndarray, rid: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """Bytes, rows and key range of each bin; rows one by one (bin -1) where few are left."""
        at = self.place(values, tie, rid)
        here = np.flatnonzero(self.searching[at])
        i = at[here]
        v, t, r = values[self.dim[i], here], tie[here], rid[here]
        key = np.choose(self.key[i], [v, t, r])
        inside = (key >= self.low[i]) & (key <= self.high[i])
        inside &= ((self.key[i] < 1) | (v == self.fixed[i, 0])) & ((self.key[i] < 2) | (t == self.fixed[i, 1]))
        here, i, v, t, r, key = (x[inside] for x in (here, i, v, t, r, key))
        few = self.few[i]
        bins = ((key.view(np.uint64) - self.low[i].view(np.uint64)) // self.width[i]).astype(np.int64)  # exact over the whole range of 64 bits
        frame = pd.DataFrame({"node": i, "bin": bins, "key": key, "size": size[here]})
        sums = frame[~few].groupby(["node", "bin"]).agg(bytes=("size", "sum"), n=("size", "count"), lo=("key", "min"), hi=("key", "max")).reset_index()
        zero = np.zeros(len(sums), np.int64)
        rows = pd.DataFrame({"node": i, "bin": -1, "bytes": size[here], "n": 1, "lo": 0, "hi": 0, "v": v, "t": t, "r": r})[few]
        return pd.concat([sums.assign(v=zero, t=zero, r=zero), rows])


def _columns(pdf: pd.DataFrame, n_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dims = [pdf[f"_d{i}"].to_numpy(np.int64) for i in range(n_dims)] or [np.zeros(len(pdf), np.int64)]
    return np.stack(dims), pdf["_tie"].to_numpy(np.int64), pdf["_rid"].to_numpy(np.int64)


def _ranges(rows: DataFrame, nodes: list[_Node], n_dims: int) -> dict:
    """node -> (bytes, rows, [(min, max) of each dimension])."""
    tree = _Tree(nodes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols = _columns(pdf, n_dims)
            frame = pd.DataFrame({"node": tree.place(*cols), "size": pdf["_size"].to_numpy(), **{f"d{i}": cols[0][i] for i in range(n_dims)}})
            agg = {"bytes": ("size", "sum"), "n": ("size", "count")}
            for i in range(n_dims):
                agg |= {f"lo{i}": (f"d{i}", "min"), f"hi{i}": (f"d{i}", "max")}
            yield frame.groupby("node").agg(**agg).reset_index()

    dims = "".join(f", lo{i} long, hi{i} long" for i in range(n_dims))
    parts = map_batches(rows, measure, f"node long, bytes long, n long{dims}")
    found = parts.groupBy("node").agg(
        F.sum("bytes"), F.sum("n"), *[f(x) for i in range(n_dims) for f, x in ((F.min, f"lo{i}"), (F.max, f"hi{i}"))]).collect()
    return {r[0]: (r[1], r[2], [(r[3 + 2 * i], r[4 + 2 * i]) for i in range(n_dims)]) for r in found}


def _sums(rows: DataFrame, nodes: list[_Node], searching: list[int], n_dims: int) -> dict:
    """node -> sorted [(bin, bytes, rows, smallest, largest key, dimension, hash, row number)] inside its bracket."""
    tree = _Tree(nodes, searching)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield tree.brackets(*_columns(pdf, n_dims), pdf["_size"].to_numpy(np.int64))

    parts = map_batches(rows, measure, "node long, bin long, bytes long, n long, lo long, hi long, v long, t long, r long")
    found: dict = {}
    for r in parts.groupBy("node", "bin", "v", "t", "r").agg(F.sum("bytes"), F.sum("n"), F.min("lo"), F.max("hi")).collect():
        found.setdefault(r[0], []).append((r[1], *r[5:], *r[2:5]))
    return {k: sorted(v, key=lambda x: (x[0], x[5:])) for k, v in found.items()}


def _narrow(node: _Node, sums: list[tuple], largest_rid: int) -> None:
    """Keep the bin in which the goal lies; set ``cut`` when its rows are named."""
    below = node.before
    for k, (_, size, n, lo, hi, *row) in enumerate(sums):
        if below + size >= node.goal or k == len(sums) - 1:
            break
        below += size
    if node.few:  # the row stays on the side that comes nearer to the goal
        v, t, r = row
        node.cut = (v, t, r if node.goal - below < below + size - node.goal else r + 1)
        return
    node.before, node.low, node.high, node.few = below, lo, hi, n <= FEW
    if lo == hi and not node.few:
        node.fixed.append(lo)
        node.key += 1
        node.low, node.high = (0, 2**63 - 1) if node.key == 1 else (0, largest_rid)


def kd_tree(rows: DataFrame, n_dims: int, n_shards: int) -> list[_Node]:
    """The tree over stored ``rows(_d0.., _tie, _rid, _size)``."""
    nodes = [_Node(0, n_shards)]
    largest_rid = rows.agg(F.max("_rid")).first()[0] or 0
    frontier, root = [0], None
    while frontier := [i for i in frontier if nodes[i].count > 1]:
        ranges = _ranges(rows, nodes, n_dims)
        root = root or ranges.get(0, (0, 0, [(0, 0)] * n_dims))
        searching = []
        for i in frontier:
            size, n, dims = ranges.get(i, (0, 0, [(0, 0)] * n_dims))
            node = nodes[i]
            spread = [(hi - lo) / max(1, r_hi - r_lo) for (lo, hi), (r_lo, r_hi) in zip(dims, root[2])]
            node.dim = int(np.argmax(spread))
            node.low, node.high = dims[node.dim]
            node.goal, node.few = size * (node.count // 2) / node.count, n <= FEW
            if n == 0:
                node.cut = (0, 0, 0)
            else:
                searching.append(i)
        while searching:
            sums = _sums(rows, nodes, searching, n_dims)
            for i in searching:
                _narrow(nodes[i], sums[i], largest_rid)
            searching = [i for i in searching if nodes[i].cut is None]
        children = []
        for i in frontier:
            node, half = nodes[i], nodes[i].count // 2
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [_Node(node.first, half), _Node(node.first + half, node.count - half)]
            children += [node.left, node.right]
        frontier = children
    return nodes


def _ranked(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with string column ``col`` replaced by the dense rank of its value, nulls kept."""
    values = group_index(rows.where(F.col(col).isNotNull()).select(F.col(col).alias("_value")).distinct(), [], ["_value"], out="_rank")
    return rows.join(values, F.col(col) == F.col("_value"), "left").drop(col, "_value").withColumnRenamed("_rank", col)


def kd_shards(docs: DataFrame, *, size: Column, dims: list[Column], keep: dict[str, Column], n_shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``shard`` and ``slot`` (gapless within the shard).

    ``dims``: numeric or string metadata columns; give ``n_shards`` or ``target_bytes`` a leaf.
    """
    n_dims = len(dims)
    names = [f"_d{i}" for i in range(n_dims)]
    tie = F.shiftrightunsigned(F.xxhash64(*keep.values(), size, *dims), 1)
    slim = docs.select(*[v.alias(k) for k, v in keep.items()], size.cast("long").alias("_size"), tie.alias("_tie"), *[d.alias(n) for d, n in zip(dims, names)])
    for name in names:
        if isinstance(slim.schema[name].dataType, StringType):
            slim = _ranked(slim, name)
    rows = stored(slim.withColumns({n: F.col(n).cast("long") for n in names}).withColumn("_rid", F.monotonically_increasing_id()), "kd-rows")
    if n_shards is None:
        n_shards = max(1, round((rows.agg(F.sum("_size")).first()[0] or 0) / target_bytes))
    lows = rows.agg(*[F.min(n) for n in names]).first() if names else ()
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(max(LEAST, (0 if low is None else low) - 1))) for n, low in zip(names, lows)})
    keys = rows.select("_size", "_tie", "_rid", *names)
    nodes = kd_tree(keys, n_dims, n_shards)
    shard_of, tree = np.array([n.first for n in nodes]), _Tree(nodes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["shard"] = shard_of[tree.place(*_columns(pdf, n_dims))].astype(np.int32)
            yield pdf.drop(columns=names)

    # kept numbers travel as strings: pandas would round long ones of a batch with a null
    kinds = dict(rows.dtypes)
    texts = [k for k in keep if isinstance(rows.schema[k].dataType, IntegralType)]
    schema = ", ".join(f"`{c}` {'string' if c in texts else kinds[c]}" for c in rows.columns if c not in names) + ", shard int"
    placed = map_batches(rows.withColumns({k: F.col(f"`{k}`").cast("string") for k in texts}), assign, schema)
    placed = stored(placed.withColumns({k: F.col(f"`{k}`").cast(kinds[k]) for k in texts}), "kd-shards")
    return rank_in_group(placed, ["shard"], [F.col("_rid")], "slot").select(*[F.col(f"`{k}`") for k in keep], "shard", "slot")
