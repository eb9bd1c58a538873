"""Skew-safe ordering helpers shared by several operators.

A window ``PARTITION BY g ORDER BY k`` sends every row of a group to one task; with
one group holding a third of the data that task becomes the job.  ``group_index``
numbers rows inside their group without that: a range partitioning on
``(group, order)`` spreads a hot group over many tasks, each task numbers its rows
locally, and a small per-(task, group) count table supplies the offsets.  The
ordered data is checkpointed once so task ids and local positions stay consistent
between the count table and the rows (and survive executor loss).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantlake.session import shared_dir


def group_index(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group under a total ``order_cols`` order.

    ``order_cols`` must make the order total (add every remaining column as a
    tie-break), otherwise positions of equal rows may swap between runs.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group_cols, *order_cols]]
    ordered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_gi_pid", F.spark_partition_id())
        .withColumn("_gi_mid", F.monotonically_increasing_id())
    )
    # partition ids are only meaningful for one materialisation: pin it (reliable
    # checkpoint in the shared folder) before deriving offsets from it
    shared_dir(spark)
    ordered = ordered.checkpoint(eager=True)
    stats = ordered.groupBy("_gi_pid", *group_cols).agg(
        F.min("_gi_mid").alias("_gi_first"), F.count(F.lit(1)).alias("_gi_cnt")
    )
    # at most one row per (partition, group): the window below is over tiny groups
    before = Window.partitionBy(*group_cols).orderBy("_gi_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_gi_off", F.coalesce(F.sum("_gi_cnt").over(before), F.lit(0)))
    # rows of a NULL group are a group like others: match null-safe
    stats = stats.select(F.col("_gi_pid").alias("_s_pid"), "_gi_first", "_gi_off", *[F.col(c).alias(f"_s_{i}") for i, c in enumerate(group_cols)])
    same = F.col("_gi_pid") == F.col("_s_pid")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{i}"))
    joined = ordered.join(stats, same).drop("_s_pid", *[f"_s_{i}" for i in range(len(group_cols))])
    return joined.withColumn(
        out, (F.col("_gi_off") + F.col("_gi_mid") - F.col("_gi_first")).cast("long")
    ).drop("_gi_pid", "_gi_mid", "_gi_first", "_gi_off")


def first_per_group(df: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """The first row of each group under ``order_cols`` - an aggregation, not a window.

    ``min(struct(order..., row...))`` is combined map-side, so a hot group costs one
    partial aggregate per task instead of one giant sort.
    """
    others = [c for c in df.columns if c not in group_cols and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in others])
    best = df.groupBy(*group_cols).agg(F.min(packed).alias("_fpg"))
    return best.select(*group_cols, *[F.col("_fpg")[c].alias(c) for c in [*order_cols, *others]]).select(*df.columns)


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per group.

    ``row_number() <= n`` is planned as a ``WindowGroupLimit`` that keeps only n rows
    per group inside every task before the shuffle, so a hot group ships at most
    ``n`` rows per task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    col = out or "_rn"
    ranked = df.withColumn(col, F.row_number().over(w)).where(F.col(col) <= n)
    return ranked if out else ranked.drop(col)
