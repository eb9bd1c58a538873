"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantlake.session import scratch_path, ship_package

ROWS_PER_BUCKET = 50_000
TEXT_BATCH = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, the rows are
    computed once, and they survive the loss of an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the workers, and let whole texts travel to them in batches of
    at most ``TEXT_BATCH`` rows (a session setting, never raised here): a batch exists
    several times over on its way, so its size bounds the memory of a Python stage."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def hand_back() -> None:
    """Return freed memory of Arrow and the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim is not None:
            trim(0)


def tidied(fn: Callable) -> Callable:
    """``fn`` (batches -> batches) that hands freed memory back when its task ends: a
    worker waits for its next task with what it once needed at most, and an executor's
    workers share its memory with the JVM."""

    @functools.wraps(fn)
    def run(batches):
        yield from fn(batches)
        gc.collect()
        hand_back()

    return run


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` by workers that are ready for it."""
    python_ready(df.sparkSession)
    return df.mapInPandas(tidied(fn), schema)


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Gapless 0-based position of each row within its group, without one task per group.

    A group is cut by a hash of the row's order keys into buckets of about
    ``ROWS_PER_BUCKET`` rows; each bucket is numbered on its own and starts where the
    buckets before it end.  The number of buckets follows the row count, so a group with
    a third of all rows is spread like the rest.  ``df`` must be stable (a stored table);
    ``order`` must tell all rows apart but exact repetitions, which are interchangeable.
    """
    buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), "_start")
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        df.withColumn("_inside", inside).join(starts, same)
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_b", "_start", *[f"_g{i}" for i in range(len(group))])
    )


def text_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8.

    ``bytes.split()`` splits at exactly these six bytes, none of which occurs inside a
    multi-byte character.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []
