"""Log rows, live messages and audit rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X

JSON = {"ignoreNullFields": "false"}


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows to a table partitioned by event date.

    The rebalance gathers small dates into few files and splits a hot date over
    several tasks.
    """
    dated = logs.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def log_messages(logs: DataFrame) -> DataFrame:
    payload = F.struct(
        "id",
        X.iso_text(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        F.substring("message", 1, K.FEED_CHARS).alias("message"),
        "is_anomaly",
    )
    message = F.struct(F.lit("log_entry").alias("type"), payload.alias("payload"))
    return logs.select("id", F.to_json(message, JSON).alias("value"))


def incident_messages(incidents: DataFrame) -> DataFrame:
    payload = F.struct(
        "id", "title", "severity", X.iso_text(F.col("detected_at")).alias("detected_at")
    )
    message = F.struct(F.lit("incident").alias("type"), payload.alias("payload"))
    return incidents.select("id", F.to_json(message, JSON).alias("value"))


def live_messages(logs: DataFrame, incidents: DataFrame, rows: int = 10) -> DataFrame:
    """The batch's first rows and all its new incidents as typed JSON."""
    first = logs.orderBy("timestamp", "id").limit(rows)
    return log_messages(first).unionByName(incident_messages(incidents))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alerts as typed JSON."""
    message = F.struct(
        F.lit("alert").alias("type"), "alert_type", "title", "severity",
        X.iso_text(F.col("fired_at")).alias("timestamp"),
    )
    return alerts.select("id", F.to_json(message, JSON).alias("value"))


def session_audit(
    counts: DataFrame, source: str, started_at: Column, completed_at: Column,
    status: str = "completed",
) -> DataFrame:
    """One audit row per session from its line counts."""
    return counts.select(
        F.col("session_id").alias("id"),
        F.lit(source).alias("source"),
        "total_lines", "processed_lines", "error_lines",
        F.lit(status).alias("status"),
        started_at.alias("started_at"),
        completed_at.alias("completed_at"),
    )


def ingestion_result(counts: DataFrame, incidents: DataFrame, clusters: DataFrame) -> DataFrame:
    """Line, incident and cluster counts of one run in one row.

    Only one-row aggregates meet here; they are stacked and summed.
    """
    names = ["total_lines", "processed_lines", "error_lines", "incidents_detected", "clusters_updated"]
    parts = [
        counts.agg(*[F.sum(c).alias(c) for c in names[:3]]),
        incidents.agg(F.count("*").alias("incidents_detected")),
        clusters.agg(F.count("*").alias("clusters_updated")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
