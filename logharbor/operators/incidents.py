"""Incidents from severe clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions import text as X
from logharbor.operators.relations import affected_services


def detect_incidents(clusters: DataFrame, logs: DataFrame) -> DataFrame:
    """One open incident per high or critical cluster, with its services."""
    severe = clusters.filter(F.col("severity").isin("high", "critical"))
    title = F.concat(F.col("name"), F.lit(" — "), F.upper("severity"), F.lit(" Incident"))
    incidents = severe.select(
        X.row_id(F.lit("incident"), F.col("id")).alias("id"),
        title.alias("title"), "description", "severity",
        F.lit("open").alias("status"),
        F.col("id").alias("cluster_id"),
        "log_count",
        F.col("first_seen").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    return incidents.join(affected_services(incidents, logs), "id")
