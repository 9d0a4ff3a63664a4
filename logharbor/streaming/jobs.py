"""Structured Streaming jobs.

Sinks write each micro-batch to its own folder with overwrite, so a batch that is
replayed after a failure replaces itself.  Windowed queries run in update mode;
``latest_windows`` keeps the last emission of every window, which equals the batch
result once the stream is drained, in whatever order the rows came.

By default there is no watermark, because one drops late rows: the state then keeps
one small row per window, or one key per row for replays, in the state store.  A
``delay`` bounds that state, at the price of rows later than it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logharbor import constants as K
from logharbor.operators.detection import (
    flag_anomalies,
    reconnects,
    redis_failures,
    threshold_alerts,
    window_rates,
)
from logharbor.operators.maintenance import latest_by_key
from logharbor.operators.metrics import error_rate, is_error
from logharbor.session import cut_lineage
from logharbor.sources.readers import parse_lines

# ---------------------------------------------------------------- sources and sinks

def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """New files of a folder as a stream (S7); Kafka works the same through ``readStream``."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    trigger: dict | None = None,
) -> None:
    """Run a stream until its present input is drained (or with the given trigger)."""
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into one folder per micro-batch and return the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    run_batches(stream, write, checkpoint, mode)
    schema = stream.schema.add("batch_id", "long")
    return stream.sparkSession.read.schema(schema).parquet(out)


def latest_windows(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted value of every window."""
    return latest_by_key(table, keys, "batch_id").drop("batch_id")


# ---------------------------------------------------------------- ingest

def ingest_stream(
    lines: DataFrame, out: str, checkpoint: str, ingest_time: Column | None = None
) -> DataFrame:
    """Parse live lines and append the rows."""
    now = F.current_timestamp() if ingest_time is None else ingest_time
    return write_batches(parse_lines(lines, now, source="websocket"), out, checkpoint)


def flag_stream(
    logs: DataFrame, out: str, checkpoint: str, seconds: int = K.ANOMALY_WINDOW_SECONDS
) -> DataFrame:
    """Flag anomalies while rows arrive.

    Each micro-batch writes its counts per window, and its rows with the flags that
    the counts so far give them.  A window may still grow in later batches, so the
    returned table scores the rows again with the counts of all batches: it equals
    the batch result for rows in any order, and no window is forgotten.  Both tables
    are kept by batch, so a replayed batch replaces its own part.
    """
    spark = logs.sparkSession
    counts, rows = f"{out}/window_counts", f"{out}/rows"
    schema = "window_start timestamp, total bigint, errors bigint, batch_id bigint"

    def rates_to(batch_id: int | None) -> DataFrame:
        known = spark.read.schema(schema).parquet(counts)
        if batch_id is not None:
            known = known.filter(F.col("batch_id") <= batch_id)
        summed = known.groupBy("window_start").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
        return summed.withColumn("error_rate", F.col("errors") / F.col("total"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for its counts and for its rows
        try:
            mine = window_rates(batch, seconds).select("window_start", "total", "errors")
            mine.write.mode("overwrite").parquet(batch_folder(counts, batch_id))
            flagged = flag_anomalies(batch, seconds, rates_to(batch_id))
            flagged.write.mode("overwrite").parquet(batch_folder(rows, batch_id))
        finally:
            batch.unpersist()

    run_batches(logs, write, checkpoint)
    return flag_anomalies(spark.read.parquet(rows), seconds, cut_lineage(rates_to(None)))


def drop_replays(logs: DataFrame, key: str = "id", delay: str | None = None) -> DataFrame:
    """Rows whose id was seen before are dropped; with a ``delay``, seen within it."""
    if delay is None:
        return logs.dropDuplicates([key])
    return logs.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- windows

def _windowed(logs: DataFrame, size: int, slide: int | None, delay: str | None):
    length = f"{size} seconds"
    window = F.window("timestamp", length, f"{slide} seconds") if slide else F.window("timestamp", length)
    if delay is not None:
        logs = logs.withWatermark("timestamp", delay)
    return logs.groupBy(window.alias("w"))


def level_counts_stream(
    logs: DataFrame, size: int = K.ANOMALY_WINDOW_SECONDS, slide: int | None = None, delay: str | None = None
) -> DataFrame:
    """Rows, errors and error rate per tumbling or sliding window."""
    return _windowed(logs, size, slide, delay).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("level") == level).alias(level.lower()) for level in K.LEVELS],
        error_rate().alias("error_rate"),
    ).select(F.col("w.start").alias("window_start"), "*").drop("w")


def events_per_second_stream(logs: DataFrame, size: int = K.RATE_WINDOW_SECONDS, delay: str | None = None) -> DataFrame:
    """Events per second for every window."""
    rate = F.count("*") / F.lit(float(size))
    return _windowed(logs, size, None, delay).agg(rate.alias("events_per_second")).select(
        F.col("w.start").alias("window_start"), "events_per_second"
    )


def timeline_stream(logs: DataFrame, size: int = K.TIMELINE_BUCKET_SECONDS, delay: str | None = None) -> DataFrame:
    """Events and errors per bucket."""
    return _windowed(logs, size, None, delay).agg(
        F.count("*").alias("events"), F.count_if(is_error()).alias("errors")
    ).select(F.col("w.start").alias("bucket"), "events", "errors")


def alert_measures_stream(logs: DataFrame, size: int, delay: str | None = None) -> DataFrame:
    """Rule values per window: failures, reconnects and, with a ``depth`` column, backlog."""
    names = [r[0] for r in K.ALERT_RULES]
    values = [redis_failures().alias("a"), reconnects().alias("b")]
    stack = f"stack(2, '{names[0]}', a, '{names[1]}', b)"
    if "depth" in logs.columns:
        values.append(F.max("depth").alias("c"))
        stack = f"stack(3, '{names[0]}', a, '{names[1]}', b, '{names[2]}', c)"
    return _windowed(logs, size, None, delay).agg(*values).select(
        F.col("w.start").alias("window_start"), F.expr(f"{stack} AS (alert_type, actual)")
    )


def alert_stream(measures: DataFrame, rules: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """One alert per rule and window; a window that grows updates its alert."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fired = threshold_alerts(batch, rules, "window_start")
        fired.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    run_batches(measures, write, checkpoint, "update")
    return latest_by_key(measures.sparkSession.read.parquet(out), ["id"], "batch_id")
