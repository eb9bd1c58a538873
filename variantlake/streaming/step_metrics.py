"""Metrics of a training step whose rollouts arrive over many batches.

Every task first sums its rows per step, so a step that holds most of a batch reaches the
stateful operator as a few partial rows.  There each step keeps its sums and counts as
arbitrary state and gives its totals after every batch that adds to it.  A step without
new rows for ``expiry`` of event time is closed: a timer gives its totals once more, as
final, and drops the state.  Rows that come later open another *part* of the step (named by
the watermark at which it began); ``read_step_metrics`` takes the last totals of every part
and adds the parts up, so a step is one row a metric however it arrived.

The totals of a batch go to ``epoch=<id>`` in overwrite mode: a batch replayed after a
failure restores the state of the last checkpoint and rewrites the same folder.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from variantlake.operators.metrics import metric_values
from variantlake.session import ship_package

_TOTALS = "n long, counts array<long>, sums array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(step, n, counts, sums, latest) of each batch of ``(step, ts, a column per metric)``."""
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf.iloc[:, 2:].to_numpy(float)  # null: NaN
        out = []
        for step, at in pdf.groupby("step", dropna=False).indices.items():
            own = values[at]
            out.append((step, len(at), (~np.isnan(own)).sum(axis=0).tolist(), np.nansum(own, axis=0).tolist(), pdf["ts"].iloc[at].max()))
        yield pd.DataFrame(out, columns=["step", "n", "counts", "sums", "latest"])


class _StepTotals(StatefulProcessor):
    """State of one step: part, totals and the latest event time."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", f"part long, latest long, {_TOTALS}")

    def _row(self, key, part, closed, n, counts, sums):
        return pd.DataFrame({"step": [key[0]], "part": [part], "closed": [closed], "n": [n], "counts": [list(counts)], "sums": [list(sums)]})

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        part, latest, n, counts, sums = held if held else (timerValues.getCurrentWatermarkInMs(), 0, 0, None, None)
        for pdf in rows:
            for more_n, more_counts, more_sums, at in zip(pdf["n"], pdf["counts"], pdf["sums"], pdf["latest"]):
                n += int(more_n)
                counts = np.add(counts, more_counts) if counts is not None else np.array(more_counts)
                sums = np.add(sums, more_sums) if sums is not None else np.array(more_sums)
                if not pd.isna(at):
                    latest = max(latest, int(at.timestamp() * 1000))
        counts, sums = [int(c) for c in counts], [float(v) for v in sums]
        self.state.update((part, latest, n, counts, sums))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.expiry_ms)
        yield self._row(key, part, False, n, counts, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            part, _, n, counts, sums = self.state.get()
            self.state.clear()
            yield self._row(key, part, True, n, counts, sums)

    def close(self) -> None:
        pass


def step_totals(scored: DataFrame, step: str = "step", ts: str = "ts", watermark: str = "1 day", expiry_seconds: int = 7 * 86400) -> DataFrame:
    """A stream of ``step, part, closed, n, counts, sums`` (in the order of ``metric_values``)."""
    ship_package(scored.sparkSession)
    found = [v.cast("double").alias(f"m{i}") for i, (_, v) in enumerate(metric_values(scored.columns))]
    slim = scored.withWatermark(ts, watermark).select(F.col(step).alias("step"), F.col(ts).alias("ts"), *found)
    kind = slim.schema["step"].dataType.simpleString()
    partial = slim.mapInPandas(_partial_sums, f"step {kind}, {_TOTALS}, latest timestamp")
    return partial.groupBy("step").transformWithStateInPandas(
        _StepTotals(expiry_seconds * 1000), f"step {kind}, part long, closed boolean, {_TOTALS}", "Append", "EventTime")


def write_step_totals(totals: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there, each batch's totals in a folder of its own."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    conf = totals.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # what arbitrary state needs; a query keeps the settings it starts with
    try:
        query = (totals.writeStream.outputMode("append").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)
    query.awaitTermination()


def read_step_metrics(spark: SparkSession, sink: str, columns: list[str]) -> DataFrame:
    """``step, n, closed, metric, mean, sum`` as ``batch_metrics`` has them; ``columns``: those
    of the scored rows.  A step is closed when all its parts are."""
    names = [m for m, _ in metric_values(columns)]
    last = spark.read.parquet(sink).groupBy("step", "part").agg(F.max_by(F.struct("closed", "n", "counts", "sums"), F.struct("epoch", "closed")).alias("v"))
    each = last.select("step", "v.closed", "v.n", F.posexplode(F.arrays_zip("v.counts", "v.sums")).alias("at", "m"))
    total = each.groupBy("step", "at").agg(F.sum("n").alias("n"), F.bool_and("closed").alias("closed"), F.sum("m.counts").alias("c"), F.sum("m.sums").alias("s"))
    some = lambda v: F.when(F.col("c") > 0, v)
    return total.select("step", "n", "closed", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("metric"),
                        some(F.col("s") / F.col("c")).alias("mean"), some(F.col("s")).alias("sum"))
