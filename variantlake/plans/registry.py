"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def task_count(df: DataFrame, rows: int, batches: int = 1) -> int:
    """The number of tasks of about ``rows`` rows that ``df`` makes, a multiple of ``batches``."""
    return batches * max(1, -(-df.count() // (rows * batches)))


def spread(df: DataFrame, rows: int = 10_000, of: DataFrame | None = None) -> DataFrame:
    """``df`` dealt among tasks of about ``rows`` rows each, by the count of ``of`` (``df`` itself).

    A driver table may be one row group, so one task, and texts made of its narrow rows are
    alike and compress to little: a split by bytes leaves most of the work to few tasks.
    """
    return df.repartition(task_count(df if of is None else of, rows))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (both sides of an oracle check round the same way)."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def load_all() -> None:
    # importing the modules registers their queries
    from variantlake.plans import (  # noqa: F401
        metric_queries, text_queries, scoring_queries, tree_queries, io_queries, coverage_queries, incremental_queries)


def sql_on(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run ``sql`` (written against plain table names, as the oracles are) with each
    name bound to a DataFrame through a uniquely named temporary view, so a
    caller's own views of the same name are never replaced."""
    import re
    import uuid

    suffix = uuid.uuid4().hex[:12]
    for name, df in tables.items():
        view = f"vl_{name}_{suffix}"
        df.createOrReplaceTempView(view)
        sql = re.sub(rf"(?<![\w.'`]){re.escape(name)}(?![\w'`])", view, sql)
    return spark.sql(sql)
