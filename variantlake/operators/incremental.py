"""D4, A9 over loads: exact dedup against what was published, and a census that merges.

Both keep small tables under a path of the caller, a directory per load, so that a new load
is worked up without reading the rows of earlier ones.  Loads are numbered and come in
order; the latest may run again (its directories are overwritten), an earlier one may not.

*Published set.*  Each kept row leaves the SHA-256 digest of its key, and three bits in a
blocked Bloom filter whose blocks are bitmaps of 32,768 bits.  A row of a new batch is
looked up in its block alone; only a row whose bits are all set can have been published and
meets the digests in an anti-join.  The filter saves work and decides nothing.

*Census.*  Questions get dense numbers from a dictionary that each load extends, and a load
stores its counts and, per difficulty, bitmaps of the questions that have it.  Counts add
up, bitmaps merge by or: distinct questions stay exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlake.operators.dedup import dedup_exact
from variantlake.operators.ranking import group_index

BLOCK_BITS = 32_768  # bits of a bitmap of the bitmap functions
PROBES = 3
DIGESTS = "digest binary, load int"
BLOOM = "block int, bitmap binary, load int"
LAYOUT = "blocks int"
QUESTIONS = "question string, id long, load int"
COUNTS = "difficulty string, variants long, load int"
BITMAPS = "difficulty string, bucket long, bitmap binary, load int"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _put(df: DataFrame, path: str, name: str, load: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/load={load}")


def _create(spark: SparkSession, path: str, tables: dict[str, str]) -> None:
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.partitionBy("load").parquet(f"{path}/{name}")  # raises where there is one


def _check_latest(table: DataFrame, load: int) -> None:
    last = table.agg(F.max("load")).first()[0]
    if last is not None and last > load:
        raise ValueError(f"load {load} comes after load {last}, which builds on the loads before it")


# --- D4 ---
def create_published(spark: SparkSession, path: str, expected: int = 100_000_000) -> None:
    """An empty published set.  ``expected`` digests get 16 filter bits each; more of them
    only make the filter pass more rows on to the exact join."""
    blocks = max(1, -(-expected * 16 // BLOCK_BITS))
    _create(spark, path, {"digests": DIGESTS, "bloom": BLOOM})
    spark.createDataFrame([(blocks,)], LAYOUT).write.parquet(f"{path}/layout")


def _digest(keys: list[str]) -> Column:
    """A digest of the key columns that tells null from text and one column from two."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _bits(digest: Column) -> Column:
    """``PROBES`` bit positions, 0 to 32,767, two bytes of the digest each."""
    return F.array(*[F.conv(F.substring(F.hex(digest), 4 * i + 1, 4), 16, 10).cast("int") % BLOCK_BITS for i in range(PROBES)])


def _has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.substring(F.hex(bitmap), 2 * F.floor(bit / 8).cast("int") + 1, F.lit(2)), 16, 10).cast("long")
    return F.getbit(byte, bit % 8) == 1


def may_be_published(rows: DataFrame, path: str, load: int) -> DataFrame:
    """``rows`` with ``_digest`` and ``_maybe``: whether all its bits are set by earlier loads."""
    spark = rows.sparkSession
    blocks = _table(spark, path, "layout", LAYOUT).first()["blocks"]
    earlier = _table(spark, path, "bloom", BLOOM).where(F.col("load") < load).groupBy(F.col("block").alias("_f_block")).agg(F.bitmap_or_agg("bitmap").alias("_bitmap"))
    placed = rows.withColumn("_block", _block(F.col("_digest"), blocks))
    met = placed.join(earlier, F.col("_block") == F.col("_f_block"), "left")
    return met.withColumn("_maybe", F.col("_bitmap").isNotNull() & F.forall(_bits(F.col("_digest")), lambda b: F.coalesce(_has_bit(F.col("_bitmap"), b), F.lit(False)))) \
        .drop("_block", "_f_block", "_bitmap")


def dedup_batch(batch: DataFrame, path: str, load: int, keys=("question", "variant"), order=("request_order",)) -> DataFrame:
    """The rows of ``batch`` that neither an earlier row of it nor an earlier load has, by
    equal ``keys`` (null equals null); they are published as ``load`` and read back.

    Several loads keep what one ``dedup_exact`` over all of them in order would keep.
    """
    spark = batch.sparkSession
    digests = _table(spark, path, "digests", DIGESTS)
    _check_latest(digests, load)
    first = dedup_exact(batch, keys=keys, order=order).withColumn("_digest", _digest(list(keys)))
    looked = may_be_published(first, path, load)
    earlier = digests.where(F.col("load") < load).select(F.col("digest").alias("_old"))
    seen = looked.where("_maybe").join(earlier, F.col("_digest") == F.col("_old"), "left_anti")
    _put(looked.where("not _maybe").unionByName(seen).drop("_maybe"), path, "kept", load)
    kept = spark.read.parquet(f"{path}/kept/load={load}")
    blocks = _table(spark, path, "layout", LAYOUT).first()["blocks"]
    bits = kept.select(_block(F.col("_digest"), blocks).alias("block"), F.explode(_bits(F.col("_digest"))).alias("bit"))
    # the filter first: with bits but without digests a load that failed halfway costs a join, never a row
    _put(bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap")), path, "bloom", load)
    _put(kept.select(F.col("_digest").alias("digest")).sortWithinPartitions("digest"), path, "digests", load)
    return kept.drop("_digest")


# --- A9 ---
def create_census(spark: SparkSession, path: str) -> None:
    _create(spark, path, {"questions": QUESTIONS, "counts": COUNTS, "bitmaps": BITMAPS})


def add_census(variants: DataFrame, path: str, load: int, question="question", difficulty="difficulty") -> None:
    """Store a load's counts and question bitmaps; new questions extend the dictionary."""
    spark = variants.sparkSession
    known = _table(spark, path, "questions", QUESTIONS)
    _check_latest(_table(spark, path, "counts", COUNTS), load)
    known = known.where(F.col("load") < load)
    pairs = variants.groupBy(F.col(question).cast("string").alias("question"), F.col(difficulty).cast("string").alias("difficulty")).agg(F.count(F.lit(1)).alias("variants"))
    _put(pairs, path, "pairs", load)  # read three times below, and small beside the variants
    pairs = spark.read.parquet(f"{path}/pairs/load={load}")
    new = pairs.where("question is not null").select("question").distinct().join(known.hint("merge"), "question", "left_anti")
    after = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    by_digest = new.withColumn("_digest", F.sha2("question", 256))  # any order does; that of the texts would send the driver a sample of them
    _put(group_index(by_digest, [], ["_digest"], out="id").withColumn("id", F.col("id") + after).drop("_digest"), path, "questions", load)
    ids = _table(spark, path, "questions", QUESTIONS).where(F.col("load") <= load).select("question", "id")
    numbered = pairs.join(ids.hint("merge"), "question")  # texts may be small as files and large in memory: never broadcast
    _put(numbered.groupBy("difficulty", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")), path, "bitmaps", load)
    _put(pairs.groupBy("difficulty").agg(F.sum("variants").alias("variants")), path, "counts", load)


def read_census(spark: SparkSession, path: str, difficulty="difficulty") -> DataFrame:
    """``metrics.census`` of all loads, from the stored counts and bitmaps alone."""
    counts = _table(spark, path, "counts", COUNTS).groupBy("difficulty").agg(F.sum("variants").alias("variants"))
    merged = _table(spark, path, "bitmaps", BITMAPS).groupBy("difficulty", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    questions = merged.groupBy(F.col("difficulty").alias("_d")).agg(F.sum(F.bitmap_count("bitmap")).alias("questions"))
    per = counts.join(questions, F.col("difficulty").eqNullSafe(F.col("_d")), "left").select(
        "difficulty", "variants", F.coalesce("questions", F.lit(0)).cast("long").alias("questions"))
    every = merged.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("questions"))
    sums = counts.select("variants", F.lit(0).cast("long").alias("questions")).unionByName(every.select(F.lit(0).cast("long").alias("variants"), "questions"))
    total = sums.agg(F.lit("total").alias("difficulty"), F.coalesce(F.sum("variants"), F.lit(0)).alias("variants"), F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"))
    return per.unionByName(total).withColumn("mean", F.when(F.col("questions") > 0, F.col("variants") / F.col("questions"))).withColumnRenamed("difficulty", difficulty)
