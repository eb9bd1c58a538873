"""Queries over several loads: dedup against a published set, a census that merges."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from variantlake.operators import incremental as I
from variantlake.plans.registry import ORACLES, register, rounded, table
from variantlake.session import scratch_path

LOADS = 3
LOAD_SQL = f"(coalesce(doc_id, 0) % {LOADS} + {LOADS}) % {LOADS}"


def _loads(docs):
    """The documents as three loads, every row in one."""
    of = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(LOADS))
    return [docs.where(of == load) for load in range(LOADS)]


# --- D4 in three loads: documents with doc_id % 3 = 0 were published first ---
@register("dedup_incremental", f"""
SELECT doc_id, load, question, n_chars FROM (
  SELECT doc_id, CAST({LOAD_SQL} AS INTEGER) AS load, source AS question, length(text) AS n_chars,
         row_number() OVER (PARTITION BY source, text ORDER BY {LOAD_SQL}, doc_id NULLS FIRST) AS nth FROM documents)
WHERE nth = 1
""")
def q_dedup_incremental(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("question"), F.col("text").alias("variant"))
    path = scratch_path(spark, "published")
    I.create_published(spark, path)
    kept = [I.dedup_batch(batch, path, load, order=("doc_id",)).withColumn("load", F.lit(load)) for load, batch in enumerate(_loads(docs))]
    return reduce(lambda a, b: a.unionByName(b), kept).select("doc_id", "load", "question", F.length("variant").cast("long").alias("n_chars"))


# --- A9 in three loads ---
@register("census_merged", ORACLES["census"].replace("source", "text"))
def q_census_merged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("difficulty"))
    path = scratch_path(spark, "census")
    I.create_census(spark, path)
    for load, batch in enumerate(_loads(docs)):
        I.add_census(batch, path, load)
    return rounded(I.read_census(spark, path))
