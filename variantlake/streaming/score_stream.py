"""Score rollouts as they arrive (Structured Streaming).

The original scores one training step's batch per call and appends to a log.
Here rollout files land in a folder; ``readStream`` picks them up, duplicates of a
rollout are dropped within a watermark, and every micro-batch is scored with the
same batch job as ``score_rollouts``, once.  Each batch's output goes to its own
``epoch=<id>`` folder in overwrite mode, so a replayed batch after a failure
rewrites the same folder instead of duplicating rows.  Status counts per time
window are a native streaming aggregation (``windowed_status_counts``) on the
row-wise scored stream.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantlake import constants as K
from variantlake.functions import text as TX
from variantlake.operators import verify as V
from variantlake.operators.metrics import batch_metrics
from variantlake.session import ship_package


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def rollout_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "parquet",
                   ts: str = "ts", watermark: str = "1 day", max_files: int | None = None) -> DataFrame:
    """A deduplicated stream of rollout rows from files arriving in ``source``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(source)
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["rollout_id"])


def score_batches_to(sink: str, method: str = "strict", policy: str = "compat", metrics_sink: str | None = None,
                     step: str = "step"):
    """A ``foreachBatch`` function: score the batch once, write the log, and take the
    per-step metrics from what was written."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        out = f"{sink}/epoch={epoch_id}"
        V.score_rollouts(batch, method=method, policy=policy).write.mode("overwrite").parquet(out)
        if metrics_sink:
            written = batch.sparkSession.read.parquet(out)
            batch_metrics(written, by=[step]).write.mode("overwrite").parquet(f"{metrics_sink}/epoch={epoch_id}")
    return per_batch


def score_stream(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                 processing_time: str = "30 seconds", **kwargs):
    """Start the scoring query; with ``available_now`` process what is there and stop.

    Then no batch without rows follows, whose only work would be to take the ids that the
    watermark has passed out of the state: the first batch of the next run does that.
    """
    spark = stream.sparkSession
    ship_package(spark)
    writer = stream.writeStream.foreachBatch(score_batches_to(sink, **kwargs)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    before = spark.conf.get(_EMPTY_BATCHES)
    try:
        if available_now:
            spark.conf.set(_EMPTY_BATCHES, "false")
        handle = writer.start()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
    if available_now:
        handle.awaitTermination()
    return handle


def score_rows(stream: DataFrame, response="response", truth="ground_truth", var="var", lb="lb", ub="ub",
               method: str = "strict", policy: str = "compat") -> DataFrame:
    """Numeric scoring on a stream: the batch job is a narrow pass and runs as it is."""
    answered = stream.withColumn("_ans", TX.extract_answer(F.col(response), method))
    return V.score_answers(answered, answer="_ans", truth=truth, var=var, lb=lb, ub=ub, policy=policy).drop("_ans", "formal_successes")


def windowed_status_counts(scored: DataFrame, ts: str = "ts", window: str = "1 day",
                           watermark: str = "1 day", by: tuple = ()) -> DataFrame:
    """Windowed counts per window and ``by`` columns (e.g. the training step): every formal
    status and the formal reward, and with a judge status also its counts, the confusion
    cells and the summed lengths.  The status domains are listed, so no pivot is needed."""
    def count(name, cond):
        return F.count_if(cond).alias(name)

    formal = F.col("formal_status")
    aggs = [count(f"formal_{s}", formal == s) for s in K.FORMAL_STATUSES]
    if "judge_status" in scored.columns:
        judge = F.col("judge_status")
        aggs += [count(f"judge_{s}", judge == s) for s in K.JUDGE_STATUSES]
        aggs += [count(f"cell_{c}", (formal == f) & (judge == j))
                 for c, f, j in (("TP", "OK", "OK"), ("FP", "NO_OK", "OK"), ("TN", "NO_OK", "NO_OK"), ("FN", "OK", "NO_OK"))]
    if "response_tokens" in scored.columns:
        aggs.append(F.sum(F.col("response_tokens").cast("long")).alias("agent_len"))
    if "judge_response" in scored.columns:
        aggs.append(F.sum(F.length(F.coalesce("judge_response", F.lit(""))).cast("long")).alias("judge_len"))
    return (scored.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("window"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("formal_result").alias("formal_reward"), *aggs))


def write_window_counts(counts: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there and emit every window, open ones too: update mode, each
    batch's changed windows in a folder of its own (a replayed batch rewrites it)."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    (counts.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_window_counts(spark: SparkSession, sink: str, by: tuple = ()) -> DataFrame:
    """The latest state of every window of ``write_window_counts``."""
    rows = spark.read.parquet(sink)
    values = [c for c in rows.columns if c not in ("window", *by, "epoch")]
    last = rows.groupBy("window", *by).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return last.select("window", *by, "v.*")
