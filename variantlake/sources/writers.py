"""K1-K8: sinks.  Partitioned file writes only; nothing passes through the driver.

Eval logs are JSON with an explicit schema on read: bounds are +-Infinity, which
Spark's JSON writer quotes and its reader turns back into doubles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantlake.operators.flatten import formatted_questions

PROMPT_COLUMNS = ["data_source", "prompt", "ability", "reward_model", "extra_info"]

EVAL_LOG = T.StructType([
    T.StructField("rollout_id", T.StringType()), T.StructField("question_index", T.IntegerType()),
    T.StructField("tree_id", T.StringType()), T.StructField("var", T.StringType()),
    T.StructField("lb", T.DoubleType()), T.StructField("ub", T.DoubleType()),
    T.StructField("level", T.IntegerType()), T.StructField("is_definite", T.BooleanType()),
    T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("agent_response", T.StringType()), T.StructField("judge_response", T.StringType()),
    T.StructField("judge_status", T.StringType()), T.StructField("formal_status", T.StringType()),
    T.StructField("judge_result", T.IntegerType()), T.StructField("formal_result", T.DoubleType()),
    T.StructField("eval_step", T.IntegerType()),
])


def write_prompts(df: DataFrame, path: str, also_json: bool = False, mode: str = "overwrite", row_group_bytes: int = 16 << 20,
                  files: int | None = None) -> None:
    """K1/K2: prompt records in one directory per ``split`` (train / eval), clustered by tree.

    Rows are range-partitioned and sorted by (split, tree, question), so a file covers a range
    of trees, however many trees there are, and a large tree spreads over several.  Row groups
    carry the range of their trees and a Bloom filter, by which ``read_prompts`` passes over
    those without the trees it looks for.  ``files`` is the number of ranges; by default the
    shuffled bytes decide, which are few where the prompts are alike.  The JSON twin is made of
    the Parquet rows, so that the prompts are made and sorted once (an append makes them again:
    the folder holds earlier rows).
    """
    order = ["split", "tree_id", F.col("extra_info.question_index")] if "question_index" in df.select("extra_info.*").columns else ["split", "tree_id"]
    records = df.select(*PROMPT_COLUMNS, "tree_id", "split")
    out = records.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    (out.write.mode(mode).partitionBy("split").option("parquet.bloom.filter.enabled#tree_id", "true")
     .option("parquet.block.size", row_group_bytes).parquet(f"{path}/parquet"))
    if also_json:
        rows = records.sparkSession.read.schema(records.schema).parquet(f"{path}/parquet") if mode == "overwrite" else out
        rows.write.mode(mode).partitionBy("split").json(f"{path}/json")


def eval_log_rows(scored: DataFrame, step="step", response="response") -> DataFrame:
    """extra_info fields, then reward_model fields (which win on a name clash),
    then the scores, as one flat row per rollout (joined by key, never by position)."""
    extra = scored.select("*", "extra_info.*").drop("extra_info") if "extra_info" in scored.columns else scored
    if "reward_model" in extra.columns:
        rm = [f.name for f in scored.schema["reward_model"].dataType.fields]
        extra = extra.drop(*[c for c in rm if c in extra.columns]).select("*", "reward_model.*").drop("reward_model")
    return extra.withColumns({"agent_response": F.col(response), "eval_step": F.col(step).cast("int")}) \
        .select(*[f.name for f in EVAL_LOG.fields])


MAX_RECORDS_PER_FILE = 1_000_000


def write_eval_log(rows: DataFrame, path: str, mode: str = "append", clustered: bool = False) -> None:
    """K3: one JSON-lines directory per eval step, files compressed (their records repeat the names).

    ``rebalance`` brings a step's rows together and lets AQE split a step that holds
    most of them over as many writers as its size asks for.  ``clustered`` rows have been
    brought together before, while they were narrow.
    """
    rows = rows if clustered else rows.hint("rebalance", "eval_step")
    (rows.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).option("compression", "gzip")
     .partitionBy("eval_step").json(path))


def stream_eval_log(rows: DataFrame, path: str, checkpoint: str) -> None:
    """K3 as a committed log: rows of a stream appended to ``path``, one directory per eval step.

    Tasks write files of their own, and a batch becomes visible when the driver adds its
    files to the manifest that lies with the log; ``read_eval_log`` reads what the manifest
    lists.  Files of a failed batch are never seen, and a batch that runs again after a
    failure is in the log once.  Files are compressed as those of ``write_eval_log``.
    """
    (rows.writeStream.format("json").option("compression", "gzip").partitionBy("eval_step").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def read_eval_log(spark, path: str) -> DataFrame:
    return spark.read.schema(EVAL_LOG).json(path)


def write_metrics(df: DataFrame, path: str, by: str = "phase", mode: str = "overwrite") -> None:
    """K4: metrics (e.g. pass@k) as JSON, one directory per phase."""
    df.write.mode(mode).partitionBy(by).json(path)


def write_report(per_question: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: legacy report - per-question rows and a summary table, both JSON."""
    per_question.write.mode(mode).json(f"{path}/questions")
    summary.write.mode(mode).json(f"{path}/summary")


def write_formatted(variants: DataFrame, path: str, question="question", mode: str = "overwrite") -> None:
    """K6: formatted questions ``{question, variants: [...]}`` as JSON lines."""
    formatted_questions(variants, question).write.mode(mode).json(path)


def write_question_list(df: DataFrame, path: str, question="question", mode: str = "overwrite") -> None:
    """K7: all test questions."""
    df.select(question).write.mode(mode).json(path)


def write_generated(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: processed generated variants."""
    df.write.mode(mode).json(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """``df`` as the table ``name`` under ``path``, in sorted buckets of ``keys``.

    Tables with the same number of buckets on the same keys join without an exchange (X6).  The
    rows are shuffled once, here, and every task writes the file of one bucket.
    """
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
     .mode("overwrite").saveAsTable(name))
    return df.sparkSession.table(name)
