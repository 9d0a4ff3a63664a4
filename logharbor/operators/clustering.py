"""Density clustering of log lines and cluster records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.operators.components import connected_components
from logharbor.operators.detection import cluster_names, message_rank
from logharbor.operators.lookups import first_per_group
from logharbor.operators.relations import attach_clusters
from logharbor.operators.token_similarity import (
    distinct_texts,
    rank_tokens,
    similar_pairs,
    similarity_links,
)
from logharbor.session import cut_lineage


def cluster_points(points: DataFrame, edges: DataFrame, min_samples: int) -> DataFrame:
    """Components of weighted points; small ones are noise (V7).

    ``points`` has id and weight.  Returns ``id``, ``cluster_id`` (smallest member
    id) for the points in components whose weight reaches ``min_samples``.
    """
    roots = connected_components(edges)
    labelled = points.join(roots, "id", "left").withColumn("cluster_id", F.coalesce("root", "id"))
    heavy = (
        labelled.groupBy("cluster_id").agg(F.sum("weight").alias("size"))
        .filter(F.col("size") >= min_samples).select("cluster_id")
    )
    return labelled.join(heavy, "cluster_id", "left_semi").select("id", "cluster_id")


def cluster_by_density(points: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """General density clustering from similar pairs ``id_a``, ``id_b``.

    A point is core when the weight of its neighbourhood, itself included, reaches
    ``min_samples``.  Clusters are components of core points; any other point next
    to a core point joins the cluster with the smallest id.
    """
    both = pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    weight = points.select(F.col("id").alias("v"), F.col("weight").alias("w"))
    around = both.join(weight, "v").groupBy("u").agg(F.sum("w").alias("around"))
    total = F.col("weight") + F.coalesce("around", F.lit(0))
    core = cut_lineage(
        points.join(around.withColumnRenamed("u", "id"), "id", "left")
        .filter(total >= min_samples).select("id")
    )
    inner = both.join(core.withColumnRenamed("id", "u"), "u", "left_semi").join(
        core.withColumnRenamed("id", "v"), "v", "left_semi"
    )
    roots = connected_components(inner)
    labels = core.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster_id"))
    edge_of = both.join(core.withColumnRenamed("id", "u"), "u", "left_anti")
    border = (
        edge_of.join(labels.withColumnRenamed("id", "v"), "v")
        .groupBy(F.col("u").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    )
    return labels.unionByName(border)


def cluster_logs(
    logs: DataFrame, threshold: tuple[int, int] = K.SIMILARITY, min_samples: int = K.MIN_SAMPLES
) -> DataFrame:
    """Cluster of every distinct embedding text: text, id, weight, cluster_id (V6).

    With ``min_samples`` 2 each point with a neighbour is core, so the clusters
    are the components of the similarity graph, for which linear links suffice.
    More samples need the neighbour weights and so all similar pairs.
    """
    texts = cut_lineage(distinct_texts(logs))
    ranked = cut_lineage(rank_tokens(texts))
    points = texts.select("id", "weight")
    if min_samples <= 2:
        labels = cluster_points(points, similarity_links(ranked, threshold), min_samples)
    else:
        labels = cluster_by_density(points, similar_pairs(ranked, threshold), min_samples)
    return texts.join(labels, "id")


def clustered_logs(logs: DataFrame, **options) -> DataFrame:
    """Logs with their cluster id, null for noise."""
    return attach_clusters(logs, cluster_logs(logs, **options))


def noise_count(logs_with_clusters: DataFrame) -> DataFrame:
    """Clustered and noise rows (V7)."""
    return logs_with_clusters.agg(
        F.count("cluster_id").alias("clustered"),
        F.count_if(F.col("cluster_id").isNull()).alias("noise"),
    )


def cluster_summary(members: DataFrame, first_messages: int = 5) -> DataFrame:
    """One cluster record per cluster id.

    Message ranks, services and time bounds combine map-side; only the first
    messages of each cluster are ever listed.
    """
    members = members.filter(F.col("cluster_id").isNotNull())
    services = F.collect_set(F.when(F.col("service") != "", F.col("service")))
    totals = members.groupBy("cluster_id").agg(
        F.count("*").alias("log_count"),
        F.max(message_rank(F.col("message"))).alias("rank"),
        F.sort_array(services).alias("tags"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    first = first_per_group(
        members.select("cluster_id", "timestamp", "id", "message"),
        "cluster_id", ["timestamp", "id"], first_messages,
    )
    return cluster_records(totals, first)


def cluster_records(totals: DataFrame, first: DataFrame) -> DataFrame:
    """Cluster records from counts per cluster and its ranked first messages."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "message")))
    listed = first.groupBy("cluster_id").agg(
        F.transform(ranked, lambda r: r["message"]).alias("representative_messages")
    )
    names = cluster_names(first)
    return totals.join(listed, "cluster_id").join(names, "cluster_id").select(
        F.col("cluster_id").alias("id"),
        "name",
        F.concat(F.lit("Auto-clustered "), F.col("log_count").cast("string"),
                 F.lit(" events via embedding similarity")).alias("description"),
        "log_count",
        X.severity_name(F.col("rank")).alias("severity"),
        "representative_messages", "tags", "first_seen", "last_seen",
    )


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group (V12); combines map-side per position."""
    means = (
        vectors.select(group, F.posexplode(vector).alias("pos", "x"))
        .groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["mean"]).alias("centroid"))
