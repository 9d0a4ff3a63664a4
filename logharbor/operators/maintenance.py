"""Table maintenance as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of rows with one version, always the same.

    An aggregate, so a key with a third of all versions is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    hashed = [f.name for f in df.schema if f.name in rest and "map<" not in f.dataType.simpleString()]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(version), F.xxhash64(*hashed))).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both sides, newest version per key."""
    return latest_by_key(table.unionByName(changes), keys, version)


def apply_incident_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status, severity and description changes (M1).

    ``changes`` has id, version, changed_at and the three nullable fields, applied
    in the order of version: each field takes its last set value, and
    ``resolved_at`` the time of the last change to resolved.
    """
    last = changes.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"new_{c}")
          for c in ("status", "severity", "description")],
        F.max_by("changed_at", F.when(F.col("status") == "resolved", F.col("version"))).alias("last_resolved"),
    )
    joined = incidents.join(last, "id", "left")
    return joined.withColumns({
        "resolved_at": F.coalesce("last_resolved", "resolved_at"),
        "status": F.coalesce("new_status", "status"),
        "severity": F.coalesce("new_severity", "severity"),
        "description": F.coalesce("new_description", "description"),
    }).drop("new_status", "new_severity", "new_description", "last_resolved")


def add_members(clusters: DataFrame, new_logs: DataFrame) -> DataFrame:
    """Add new members to cluster counts and move last_seen forward (M2)."""
    added = new_logs.groupBy("cluster_id").agg(
        F.count("*").alias("_n"), F.max("timestamp").alias("_last")
    )
    joined = clusters.join(added.withColumnRenamed("cluster_id", "id"), "id", "left")
    return joined.withColumns({
        "log_count": F.col("log_count") + F.coalesce("_n", F.lit(0)),
        "last_seen": F.greatest("last_seen", "_last"),
    }).drop("_n", "_last")


def split_expired(
    embeddings: DataFrame, logs: DataFrame, cutoff: Column
) -> tuple[DataFrame, DataFrame]:
    """Embeddings to keep, and those of logs created before the cutoff (M3)."""
    old = logs.filter(F.col("created_at") < cutoff).select(F.col("id").alias("log_entry_id"))
    return (
        embeddings.join(old, "log_entry_id", "left_anti"),
        embeddings.join(old, "log_entry_id", "left_semi"),
    )


def replace_rows(table: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Update rows by key and append new ones (M4)."""
    return table.join(changed.select(key), key, "left_anti").unionByName(changed)


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Delete rows by key (M4)."""
    return table.join(ids.select(key), key, "left_anti")
