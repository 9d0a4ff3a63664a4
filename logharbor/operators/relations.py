"""Joins between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions import text as X
from logharbor.operators.lookups import first_per_group, page


def without_embedding(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Logs that have no embedding record; null-safe, unlike NOT IN."""
    done = embeddings.select(F.col("log_entry_id").alias("id"))
    return logs.join(done, "id", "left_anti")


def pending_embeddings(logs: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs still to embed (J1): all of them, or the ``limit`` oldest."""
    todo = without_embedding(logs, embeddings)
    return todo if limit is None else page(todo, ["created_at", "id"], 0, limit)


def with_relations(incidents: DataFrame, alerts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Incidents with their alerts (one row each) and their summary.

    Alerts stay rows: an incident may have any number of them.
    """
    a = alerts.select(
        F.col("incident_id").alias("id"), F.col("id").alias("alert_id"), "alert_type", "fired_at"
    )
    s = summaries.select(F.col("incident_id").alias("id"), "executive_summary", "model_used")
    return incidents.join(a, "id", "left").join(s, "id", "left")


def attach_clusters(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Write the cluster id back to its member logs.

    ``labels`` has one row per distinct embedding text.
    """
    text = X.embedding_text(F.col("level"), F.col("service"), F.col("message"))
    keyed = logs.drop("cluster_id").withColumn("text", text)
    return keyed.join(labels.select("text", "cluster_id"), "text", "left").drop("text")


def affected_services(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Distinct services of each incident's logs, null when there are none.

    (cluster, service) pairs are made distinct before the join.
    """
    pairs = (
        logs.filter(F.col("service").isNotNull() & (F.col("service") != ""))
        .select("cluster_id", "service").distinct()
    )
    joined = incidents.join(pairs, "cluster_id", "left")
    services = F.sort_array(F.collect_set("service"))
    return joined.groupBy("id").agg(
        F.when(F.size(services) > 0, services).alias("affected_services")
    )


def vectors_for_ids(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored vectors of the given log ids, found by their stable key."""
    keys = ids.select(F.col("id").alias("log_id"), X.vector_id(F.col("id")).alias("chroma_id"))
    return keys.distinct().join(vectors, "chroma_id")


def logs_for_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """Logs of an id list."""
    return logs.join(ids.select("id"), "id", "left_semi")


def incident_logs(incidents: DataFrame, logs: DataFrame, limit: int = 50) -> DataFrame:
    """The first logs of every incident's cluster.

    Logs are limited per cluster before they meet the incidents.
    """
    first = first_per_group(
        logs.filter(F.col("cluster_id").isNotNull()), "cluster_id", ["timestamp", "id"], limit
    )
    return incidents.select(F.col("id").alias("incident_id"), "cluster_id").join(first, "cluster_id")


def set_null_on_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents keep their row and lose the key."""
    gone = deleted.select(F.col("id").alias(key)).distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col(key))
    return child.join(gone, key, "left").withColumn(key, kept).drop("_gone")


def cascade_on_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents go too."""
    return child.join(deleted.select(F.col("id").alias(key)), key, "left_anti")
