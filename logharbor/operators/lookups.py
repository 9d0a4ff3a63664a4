"""Filters, pages and top-k.

Every page is ordered by a unique key at the end, so it is deterministic, and
compiles to a per-task top-k followed by a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor import constants as K


def by_id(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(key) == value)


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in the given order (F2)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def session_logs(logs: DataFrame, session_id: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Logs of one session, oldest first."""
    return page(logs.filter(F.col("session_id") == session_id), ["timestamp", "id"], offset, limit)


def anomalies_since(logs: DataFrame, since: Column | None = None, limit: int = 50) -> DataFrame:
    """Flagged logs, newest first."""
    hits = logs.filter("is_anomaly")
    if since is not None:
        hits = hits.filter(F.col("timestamp") >= since)
    return page(hits, [F.desc("timestamp"), "id"], 0, limit)


def unclustered(logs: DataFrame, limit: int | None = 200) -> DataFrame:
    """Rows without a cluster (F5): the oldest ``limit``, or all of them without one."""
    todo = logs.filter(F.col("cluster_id").isNull())
    return todo if limit is None else page(todo, ["created_at", "id"], 0, limit)


def filter_incidents(
    incidents: DataFrame, status: str | None = None, severity: str | None = None
) -> DataFrame:
    if status is not None:
        incidents = incidents.filter(F.col("status") == status)
    if severity is not None:
        incidents = incidents.filter(F.col("severity") == severity)
    return incidents


def list_incidents(
    incidents: DataFrame, status: str | None = None, severity: str | None = None,
    offset: int = 0, limit: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A page, newest first, and the total of the filtered set."""
    hits = filter_incidents(incidents, status, severity)
    total = hits.agg(F.count("*").alias("total"))
    return page(hits, [F.desc("detected_at"), "id"], offset, limit), total


def firing_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Firing alerts, newest first (F8)."""
    return page(alerts.filter(F.col("status") == "firing"), [F.desc("fired_at"), "id"], 0, limit)


def text_search(logs: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive contains over message, service and level."""
    needle = needle.lower()
    hit = F.lit(False)
    for name in ("message", "service", "level"):
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(needle)
    return logs.filter(hit)


def metadata_filter(
    df: DataFrame, level: str | None = None, service: str | None = None
) -> DataFrame:
    """Level and service predicates ahead of any ranking."""
    if level is not None:
        df = df.filter(F.col("level") == level)
    if service is not None:
        df = df.filter(F.col("service") == service)
    return df


def top_clusters(clusters: DataFrame, limit: int = 10) -> DataFrame:
    """Largest clusters."""
    return page(clusters, [F.desc("log_count"), "id"], 0, limit)


def recent_incidents(incidents: DataFrame, limit: int = 5) -> DataFrame:
    """Newest incidents."""
    return page(incidents, [F.desc("detected_at"), "id"], 0, limit)


def first_per_group(df: DataFrame, group: str, order: list, rows: int) -> DataFrame:
    """The first ``rows`` rows of every group with their rank.

    The rank limit is applied per task before the shuffle, so a group that holds
    a third of all rows sends at most ``rows`` rows per task.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows)


def join_ranked(df: DataFrame, group: str, text: str, separator: str = "\n") -> DataFrame:
    """Ranked text of each group, joined in rank order."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", text)))
    joined = F.array_join(F.transform(ranked, lambda r: r[text]), separator)
    return df.groupBy(group).agg(joined.alias(text))


def latest_feed(logs: DataFrame, limit: int = 200) -> DataFrame:
    """Newest rows of the live feed."""
    return page(logs, [F.desc("timestamp"), F.desc("id")], 0, limit)
