"""Scheduled and streaming synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seamline.engine import Engine
from seamline.operators.incremental import Ledger


def sweep(engine: Engine) -> dict[str, dict[str, int]]:
    """Sync every registered codebase; one that fails doesn't keep the others from it."""
    out = {}
    for row in engine.codebases().select("codebase").toLocalIterator():
        try:
            out[row.codebase] = engine.sync(row.codebase)
        except OSError as e:
            out[row.codebase] = {"failed": -1, "error": str(e)}
    return out


def schedule(engine: Engine, checkpoint: str, every: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """A streaming query that sweeps at each trigger; with `once` a single time."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, __: sweep(engine) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def consume(spark: SparkSession, source: DataFrame, ledger: Ledger, scope: str, seq: str, process: Callable[[DataFrame, int], DataFrame], checkpoint: str) -> StreamingQuery:
    """Process each numbered record of a stream once; the rows that `process` returns become visible in `ledger.outputs`.

    A batch's numbers already in the ledger are skipped; the output of the others is committed together with their numbers by one entry, so
    that a batch replayed after a crash neither loses nor repeats records, wherever the crash was.
    """
    from seamline.operators import intervals

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        gaps = ledger.pending(intervals.from_numbers(held, scope, seq, ledger.block))
        fresh = intervals.members(held, scope, seq, gaps, ledger.block)
        if not fresh.isEmpty():
            ledger.commit(gaps, process(fresh, number))
        held.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(window_start, event_type, n_events, sum_value) of an event stream or table, late rows allowed up to `late`."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return (
        rows.groupBy(F.window(time, width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("sum_value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value")
    )
