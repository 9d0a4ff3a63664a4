"""Streams over several micro-batches against the batch result."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logharbor.operators import detection as D
from logharbor.operators import metrics as A
from logharbor.session import new_folder
from logharbor.streaming import jobs as J

LOG = "id string, timestamp timestamp, level string, service string, message string"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def source(spark):
    """Three files, in time order."""
    folder = new_folder(spark, "source")
    levels = ["ERROR", "INFO", "WARNING", "CRITICAL", "INFO"]
    for part in range(3):
        rows = [(f"l{i:03d}", T0 + timedelta(seconds=7 * i), levels[i % 5], "redis" if i % 2 else "gw", "will reconnect" if i % 3 else "disk full")
                for i in range(part * 50, part * 50 + 50)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, source):
    schema = spark.read.parquet(source).schema
    return J.file_stream(spark, source, schema, maxFilesPerTrigger=1)


def folders(spark):
    return new_folder(spark, "out"), new_folder(spark, "state")


def same(a, b):
    columns = sorted(b.columns)
    return sorted(a.select(columns).collect(), key=repr) == sorted(b.select(columns).collect(), key=repr)


def test_windows_equal_batch(spark, source):
    table = J.write_batches(J.level_counts_stream(stream(spark, source)), *folders(spark), "update")
    assert table.select("batch_id").distinct().count() > 1
    latest = J.latest_windows(table, ["window_start"])
    batch = D.window_rates(spark.read.parquet(source)).select("window_start", "total")
    assert same(latest.select("window_start", "total"), batch)


def test_timeline_equals_batch(spark, source):
    table = J.write_batches(J.timeline_stream(stream(spark, source)), *folders(spark), "update")
    assert same(J.latest_windows(table, ["bucket"]), A.events_timeline(spark.read.parquet(source)))


def test_alerts_once_per_window(spark, source):
    measures = J.alert_measures_stream(stream(spark, source), 300)
    fired = J.alert_stream(measures, D.alert_rules(spark), *folders(spark))
    batch = spark.read.parquet(source).withColumn("w", A.window_start("timestamp", 300))
    want = D.threshold_alerts(D.rule_measures(batch, ["w"]), D.alert_rules(spark), "w")
    assert want.count() > 0
    assert same(fired.select("id", "actual_value"), want.select("id", "actual_value"))


def test_flags_equal_batch(spark, source):
    rows = J.flag_stream(stream(spark, source), *folders(spark))
    assert same(rows.select("id", "is_anomaly", "anomaly_score"),
                D.flag_anomalies(spark.read.parquet(source)).select("id", "is_anomaly", "anomaly_score"))


def test_rows_out_of_order_are_not_lost(spark, source):
    """Five files, each spread over all times and one of them days before the others."""
    rows = spark.read.parquet(source).withColumn(
        "timestamp", F.expr("IF(pmod(xxhash64(id), 5) = 3, timestamp - INTERVAL 3 DAYS, timestamp)"))
    folder = new_folder(spark, "shuffled")
    for part in range(5):
        rows.filter(F.expr(f"pmod(xxhash64(id), 5) = {part}")).coalesce(1).write.mode("append").parquet(folder)
    table = J.write_batches(J.level_counts_stream(stream(spark, folder)), *folders(spark), "update")
    assert table.select("batch_id").distinct().count() == 5
    assert same(J.latest_windows(table, ["window_start"]).select("window_start", "total"),
                D.window_rates(rows).select("window_start", "total"))
    flagged = J.flag_stream(stream(spark, folder), *folders(spark), seconds=3600)
    assert same(flagged.select("id", "anomaly_score"), D.flag_anomalies(rows, 3600).select("id", "anomaly_score"))
    assert J.write_batches(J.drop_replays(stream(spark, folder)), *folders(spark)).count() == 150
    measures = J.alert_measures_stream(stream(spark, folder), 300)
    fired = J.alert_stream(measures, D.alert_rules(spark), *folders(spark))
    want = D.threshold_alerts(D.rule_measures(rows.withColumn("w", A.window_start("timestamp", 300)), ["w"]), D.alert_rules(spark), "w")
    assert same(fired.select("id", "actual_value"), want.select("id", "actual_value"))


def test_replays_are_dropped_across_batches(spark, source):
    folder = new_folder(spark, "twice")
    rows = spark.read.parquet(source)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(folder)
    kept = J.write_batches(J.drop_replays(stream(spark, folder), delay="1 hour"), *folders(spark))
    assert kept.count() == 150 and kept.select("id").distinct().count() == 150


def test_restart_continues_and_replay_is_idempotent(spark, source, now):
    out, state = folders(spark)
    lines = lambda: stream(spark, source).select("id", F.concat_ws(" ", "level", "message").alias("line"))
    first = J.ingest_stream(lines(), out, state, now)
    assert first.count() == 150
    again = J.ingest_stream(lines(), out, state, now)  # same checkpoint: nothing new
    assert again.count() == 150
    other = J.ingest_stream(lines(), out, new_folder(spark, "fresh"), now)  # full replay of the same batches
    assert other.count() == 150
    assert other.filter("source <> 'websocket'").count() == 0
