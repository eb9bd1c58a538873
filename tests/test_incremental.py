"""Loads one after another equal one run over all of them."""
import random

import pytest
from pyspark.sql import functions as F

from variantlake.operators import incremental as I
from variantlake.operators.dedup import dedup_exact
from variantlake.operators.metrics import census


def _rows(spark, n=600, seed=4):
    rng = random.Random(seed)
    rows = [(i * 3 // n, i, rng.choice(["q1", "q2", None, "q1:"]), rng.choice(["", None, "1:a", "é"]) if i % 5 else f"v{rng.randrange(60)}",
             rng.choice(["easier", "harder", None])) for i in range(n)]
    return spark.createDataFrame(rows, "load int, request_order long, question string, variant string, difficulty string")


@pytest.mark.parametrize("expected", [1, 1_000_000])  # a filter of one block, and a roomy one
def test_loads_keep_what_one_run_keeps(spark, tmpdir_path, expected):
    rows = _rows(spark)
    path = f"{tmpdir_path}/published"
    I.create_published(spark, path, expected)
    got = []
    for load in range(3):
        kept = I.dedup_batch(rows.where(F.col("load") == load), path, load)
        got += [r.request_order for r in kept.collect()]
    assert sorted(got) == sorted(r.request_order for r in dedup_exact(rows).collect())
    again = I.dedup_batch(rows.where("load = 2"), path, 2)  # the latest load runs again
    assert sorted(r.request_order for r in again.collect()) == sorted(o for o in got if o >= 400)
    with pytest.raises(ValueError):
        I.dedup_batch(rows.where("load = 0"), path, 0)
    assert I.dedup_batch(rows.limit(0), path, 3).count() == 0
    assert I.dedup_batch(rows, path, 4).count() == 0  # all published


def test_filter_passes_published_rows_and_few_others(spark, tmpdir_path):
    path = f"{tmpdir_path}/published"
    I.create_published(spark, path, 20_000)
    old = spark.range(5000).select(F.lit("q").alias("question"), F.col("id").cast("string").alias("variant"), F.col("id").alias("request_order"))
    I.dedup_batch(old, path, 0)
    both = spark.range(10_000).select(F.lit("q").alias("question"), F.col("id").cast("string").alias("variant"), "id")
    maybe = I.may_be_published(both.withColumn("_digest", I._digest(["question", "variant"])), path, 1)
    n = {r.old: r.n for r in maybe.groupBy((F.col("id") < 5000).alias("old")).agg(F.count_if("_maybe").alias("n")).collect()}
    assert n[True] == 5000 and n[False] < 100


def test_census_of_loads_equals_census_of_all(spark, tmpdir_path):
    rows = _rows(spark, seed=9).withColumn("question", F.coalesce("variant", "question"))
    path = f"{tmpdir_path}/census"
    I.create_census(spark, path)
    for load in (0, 1, 2, 2):  # the last one twice
        I.add_census(rows.where(F.col("load") == load), path, load)
    key = lambda r: (r.difficulty or "", r.variants, r.questions, r.mean)
    assert sorted(map(key, I.read_census(spark, path).collect())) == sorted(map(key, census(rows).collect()))
    ids = [r.id for r in spark.read.schema(I.QUESTIONS).parquet(f"{path}/questions").collect()]
    assert sorted(ids) == list(range(len(ids)))
    with pytest.raises(ValueError):
        I.add_census(rows, path, 1)


def test_empty_census(spark, tmpdir_path):
    path = f"{tmpdir_path}/census"
    I.create_census(spark, path)
    I.add_census(_rows(spark).limit(0), path, 0)
    assert [tuple(r) for r in I.read_census(spark, path).collect()] == [("total", 0, 0, None)]
