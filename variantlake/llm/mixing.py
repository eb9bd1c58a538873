"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words in proportion to their weights.  A source whose share
would exceed ``max_epochs`` times its size is clamped there and the excess goes to the
others, again in proportion, until no share is above its cap.  A source's target is then
met by whole repetitions of all its documents plus a seeded part of them once more: those
whose hash is below a threshold, chosen so that their words come nearest to the rest of
the target.

The threshold is the weighted quantile of the hashes, found by two rounds of sums over
1,024 hash ranges a source; only the documents of one last range (a millionth of a
source) are ordered.  Source tables have one row per source and stay DataFrames; the only
numbers on the driver are the water level and its sums.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``, null and empty texts have none.
Sources are ordered by code point, null is a source of its own and comes last.  Repeated
rows hash alike and are told apart by their row number where the threshold falls among
them.  Documents without words are never extra: they are taken as often as all of their
source are.  A source without words has target 0 and none of its documents is taken.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantlake.llm.common import python_ready, rank_in_group, stored, text_words, tidied

RANGES = 1024


def word_count(text: Column) -> Column:
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([len(text_words(t)) for t in texts], dtype="int64")

    return F.pandas_udf(tidied(run), "long")(text)


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sources(source, ...)`` with ``weight``: the cycle's values by the sources' code-point order."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.element_at(values, (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, total: float, max_epochs: float = 3.0) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target`` double.

    Each round clamps the sources whose share is above their cap and raises the level
    (words per weight) for the rest; the level only rises, so it alone is the state.
    """
    cap, weight = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    level = 0.0
    while True:
        clamped = cap < weight * F.lit(level)
        held, free = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(weight))).first()
        new = (total - (held or 0.0)) / free if free else level
        if new <= level:
            return sources.withColumn("target", F.least(cap, weight * F.lit(level)))
        level = new


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: int = 20_240_501,
        keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``size``, ``source_size``, ``target``, ``reps`` (times the mix takes
    the document) and ``taken`` (words, repeats counted); columns of these names are replaced."""
    python_ready(docs.sparkSession)
    added = ["size", "source_size", "target", "reps", "taken"]
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in added and (keep is None or c in keep)]
    size = word_count(F.col(text_col))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.col(text_col)), F.length(text_col)), 1)
    rows = stored(docs.select(F.struct(*columns).alias("row"), F.col(source_col).alias("source"), size.alias("size"),
                              order.alias("hash"), F.monotonically_increasing_id().alias("rid")), "mix-rows")

    sources = stored(cycled_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sources, float(total), max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(share + 1e-12)).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = stored(plan.select("source", "source_size", "target", "whole", "rest"), "mix-plan")

    bounds = stored(_thresholds(rows, plan), "mix-bounds")
    key = bounds.select(F.col("source").alias("_s"), "source_size", "target", "whole", "hash_at", "n_at")
    marked = rows.join(key, F.col("source").eqNullSafe(F.col("_s")))
    below = marked.where(F.col("hash_at").isNull() | (F.col("hash") != F.col("hash_at"))).withColumn(
        "extra", F.when(F.col("hash") < F.col("hash_at"), 1).otherwise(0))
    at = rank_in_group(marked.where(F.col("hash") == F.col("hash_at")), ["source"], [F.col("rid")], "_rank")
    at = at.withColumn("extra", F.when(F.col("_rank") < F.col("n_at"), 1).otherwise(0)).drop("_rank")
    extra = F.when(F.col("size") > 0, F.col("extra")).otherwise(0)
    done = below.unionByName(at).withColumn("reps", (F.col("whole") + extra).cast("int"))
    return done.select("row.*", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).cast("long").alias("taken"))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``hash_at`` and ``n_at``: a source's extra documents are those with a
    smaller hash, and ``n_at`` of those with just this hash."""
    bits = (53, 43)
    state = plan.withColumn("prefix", F.lit(0).cast("long"))
    for level, shift in enumerate(bits):
        # sums over RANGES hash ranges inside the range kept so far
        inside = _within(rows, state, bits[level - 1] if level else 63)
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("part")).agg(F.sum("size").alias("words"))
        sums = sums.join(state.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        last = (sums.where(F.col("before") <= F.col("rest")).groupBy("source")
                .agg(F.max(F.struct("part", "before")).alias("last")))
        state = _with(state.drop("prefix"), last).withColumn("prefix", F.col("last.part")).withColumn(
            "rest", F.col("rest") - F.coalesce(F.col("last.before"), F.lit(0))).drop("last")
        state = stored(state, "mix-range")
    # rows of the last range, equal hashes together (they are repetitions and have one size)
    ties = _within(rows, state, bits[-1]).groupBy("source", "hash").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    ties = ties.join(state.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    run = Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    each = F.greatest(F.col("words") / F.col("n"), F.lit(1.0))
    n_at = F.least(F.col("n"), F.round((F.col("rest") - F.col("before")) / each).cast("long"))
    last = (ties.where(F.col("before") <= F.col("rest")).withColumn("n_at", n_at).groupBy("source")
            .agg(F.max(F.struct("hash", "n_at")).alias("last")))
    found = _with(state, last)
    return found.select("source", "source_size", "target", "whole", F.col("last.hash").alias("hash_at"), F.col("last.n_at").alias("n_at"))


def _within(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Rows of the hash range that ``state`` keeps of their source."""
    kept = state.select(F.col("source").alias("_s"), "prefix")
    slim = rows.select("source", "hash", "size")
    return slim.join(kept, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift) == F.col("prefix"))).drop("_s", "prefix")


def _with(state: DataFrame, extra: DataFrame) -> DataFrame:
    extra = extra.withColumnRenamed("source", "_s")
    return state.join(extra, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    return mixed.where("reps > 0").withColumn("_copy", F.explode(F.expr("sequence(1, reps)"))).drop("_copy")
