"""Counts, rates and detection rules (A1-A17, R1-R12, the flagship query)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.operators import detection as D
from logharbor.operators import lookups as L
from logharbor.operators import metrics as A
from logharbor.plans import tables as T
from logharbor.plans.ingest_queries import DAILY_ALERTS, daily_alerts, ingest_time
from logharbor.plans.registry import query
from logharbor.plans.snippets import ALERTS, CLUSTERS, ERRORS, FLAGS, INCIDENTS, LABELS, LOGS, PARSED, hits, sql
from logharbor.session import cut_lineage
from logharbor.sources.readers import parse_lines


# ---------------------------------------------------------------- flagship

@query("e01_hourly_anomalies", sql(PARSED + f""",
rates AS (SELECT date_trunc('hour', timestamp) AS w, avg(CASE WHEN {ERRORS} THEN 1.0 ELSE 0.0 END) AS r FROM parsed GROUP BY 1)
""", f"""
SELECT w AS hour, level, count(*) AS n,
       count(*) FILTER (WHERE {hits('message', K.CRITICAL_PHRASES)} OR (r > 0.3 AND level IN ('ERROR', 'CRITICAL', 'WARNING'))) AS anomalies
FROM parsed JOIN rates ON date_trunc('hour', timestamp) = w GROUP BY 1, 2
"""))
def hourly_anomalies(spark, sf_dir):
    """Raw lines are parsed, scored against their hour's error rate and counted."""
    lines = T.logs(spark, sf_dir).select("id", F.col("raw_line").alias("line"))
    counts = D.anomaly_counts(parse_lines(lines, ingest_time()), 3600)
    return counts.withColumnRenamed("window_start", "hour")


# ---------------------------------------------------------------- metrics

@query("a01_level_counts", sql(LOGS, """
SELECT level, count(*) AS n FROM logs WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 300 SECONDS GROUP BY 1
"""))
def level_counts(spark, sf_dir):
    return A.level_counts(T.logs(spark, sf_dir))


@query("a01_level_counts_tumbling", sql(LOGS, """
SELECT time_bucket(INTERVAL 300 SECONDS, timestamp, TIMESTAMP '1970-01-01') AS window_start, level, count(*) AS n FROM logs GROUP BY 1, 2
"""))
def level_counts_tumbling(spark, sf_dir):
    return A.tumbling_levels(T.logs(spark, sf_dir), 300)


@query("a02_events_per_second", sql(LOGS, """
SELECT count(*) / 60.0::DOUBLE AS events_per_second FROM logs
WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 60 SECONDS
"""))
def events_per_second(spark, sf_dir):
    return A.events_per_second(T.logs(spark, sf_dir))


@query("a03_error_rate", sql(LOGS, f"""
SELECT date_trunc('day', timestamp) AS day, round(avg(CASE WHEN {ERRORS} THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM logs GROUP BY 1
"""))
def error_rate(spark, sf_dir):
    return T.logs(spark, sf_dir).groupBy(A.window_start("timestamp", 86400).alias("day")).agg(A.error_rate().alias("error_rate"))


HEATMAP = f"""
SELECT hour(timestamp) AS hour, dayofweek(timestamp) AS day, count(*) AS count FROM logs
WHERE {ERRORS} AND timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 7 DAYS GROUP BY 1, 2
"""


@query("a04_error_heatmap", sql(LOGS, HEATMAP))
def error_heatmap(spark, sf_dir):
    return A.error_heatmap(T.logs(spark, sf_dir))


@query("a05_incidents_by_status", sql(INCIDENTS, "SELECT status, count(*) AS n FROM incidents GROUP BY 1"))
def incidents_by_status(spark, sf_dir):
    return A.incidents_by_status(T.incidents(spark, sf_dir))


@query("a06_table_counts", sql(f"{LOGS}, {INCIDENTS}, {ALERTS}", """
SELECT 'logs' AS table_name, count(*) AS n FROM logs UNION ALL SELECT 'incidents', count(*) FROM incidents
UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'embeddings', count(*) FROM embeddings
"""))
def table_counts(spark, sf_dir):
    return A.table_counts({
        "logs": T.logs(spark, sf_dir), "incidents": T.incidents(spark, sf_dir),
        "alerts": T.alerts(spark, sf_dir), "embeddings": T.vectors(spark, sf_dir)})


@query("a06_alert_counts", sql(ALERTS, "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'firing') AS firing_count FROM alerts"))
def alert_counts(spark, sf_dir):
    return A.alert_counts(T.alerts(spark, sf_dir))


@query("a07_cluster_summary", sql(CLUSTERS, """
SELECT id, name, description, log_count, severity, representative_messages, tags, first_seen, last_seen FROM clusters
"""))
def cluster_summary(spark, sf_dir):
    from logharbor.operators.clustering import cluster_summary as summary

    return summary(T.clustered(spark, sf_dir))


DEPTHS = "depths AS (SELECT ts, concat('q', CAST(user_id % 4 AS VARCHAR)) AS queue, event_id % 1500 AS depth FROM events)"


def depths(spark, sf_dir) -> DataFrame:
    events = T._utc(T.table(spark, sf_dir, "events"))
    queue = F.concat(F.lit("q"), (F.col("user_id") % 4).cast("string"))
    return events.select("ts", queue.alias("queue"), (F.col("event_id") % 1500).alias("depth"))


SNAPSHOT = f"""
SELECT max(timestamp) AS timestamp,
       round(count(*) FILTER (WHERE timestamp >= m - INTERVAL 60 SECONDS) / 60.0::DOUBLE, 2) AS events_per_second,
       (SELECT count(*) FROM incidents) AS incident_count,
       (SELECT count(*) FROM incidents WHERE status = 'open') AS open_incident_count,
       (SELECT count(*) FROM incidents WHERE severity = 'critical') AS critical_incident_count,
       (SELECT count(*) FROM clusters) AS cluster_count,
       count(*) AS total_log_count,
       round(count(*) FILTER (WHERE {ERRORS} AND timestamp >= m - INTERVAL 300 SECONDS)::DOUBLE
             / greatest(count(*) FILTER (WHERE timestamp >= m - INTERVAL 300 SECONDS), 1), 4) AS error_rate,
       (SELECT sum(d)::BIGINT FROM (SELECT arg_max(depth, ts) AS d FROM depths GROUP BY queue)) AS queue_size,
       0.0::DOUBLE AS processing_latency_ms,
       count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
       (SELECT count(*) FROM alerts WHERE status = 'firing') AS firing_alert_count
FROM flagged, (SELECT max(timestamp) AS m FROM flagged)
"""


def snapshot(spark, sf_dir) -> DataFrame:
    queue_size = A.last_queue_depth(depths(spark, sf_dir)).agg(F.sum("depth").alias("queue_size"))
    return A.metrics_snapshot(
        D.flag_anomalies(T.logs(spark, sf_dir), 3600), T.incidents(spark, sf_dir), T.clusters(spark, sf_dir),
        T.alerts(spark, sf_dir), queue_size)


@query("a08_metrics_snapshot", sql(f"{CLUSTERS}, {INCIDENTS}, {ALERTS}, {DEPTHS}", SNAPSHOT))
def metrics_snapshot(spark, sf_dir):
    return snapshot(spark, sf_dir)


def dashboard(spark, sf_dir) -> dict[str, DataFrame]:
    """The parts of the dashboard bundle as frames."""
    logs = T.logs(spark, sf_dir)
    return {
        "metrics": snapshot(spark, sf_dir),
        "recent_incidents": L.recent_incidents(T.incidents(spark, sf_dir)),
        "top_clusters": L.top_clusters(T.clusters(spark, sf_dir), 5),
        "error_heatmap": A.error_heatmap(logs),
        "events_timeline": A.events_timeline(logs, K.TIMELINE_BUCKET_SECONDS, K.TIMELINE_BUCKETS),
    }


@query("a09_dashboard", sql(f"{CLUSTERS}, {INCIDENTS}", f"""
SELECT 'metrics' AS part, 'total_log_count' AS key, count(*) AS value FROM logs
UNION ALL SELECT 'recent_incidents', id, 1 FROM (SELECT id FROM incidents ORDER BY detected_at DESC, id LIMIT 5)
UNION ALL SELECT 'top_clusters', id, log_count FROM (SELECT id, log_count FROM clusters ORDER BY log_count DESC, id LIMIT 5)
UNION ALL SELECT 'error_heatmap', concat(hour, '/', day), count FROM ({HEATMAP})
UNION ALL SELECT 'events_timeline', strftime(b, '%Y-%m-%d %H:%M:%S'), count(*) FROM (
  SELECT time_bucket(INTERVAL 30 SECONDS, timestamp, TIMESTAMP '1970-01-01') AS b FROM logs
  WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 600 SECONDS) GROUP BY 2
"""))
def dashboard_rows(spark, sf_dir):
    parts = dashboard(spark, sf_dir)
    keys = {
        "metrics": (F.lit("total_log_count"), F.col("total_log_count")),
        "recent_incidents": (F.col("id"), F.lit(1)),
        "top_clusters": (F.col("id"), F.col("log_count")),
        "error_heatmap": (F.concat_ws("/", "hour", "day"), F.col("count")),
        "events_timeline": (F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"), F.col("events")),
    }
    return reduce(DataFrame.unionByName, [
        parts[name].select(F.lit(name).alias("part"), k.alias("key"), v.cast("long").alias("value"))
        for name, (k, v) in keys.items()])


@query("a10_incident_counts", sql(INCIDENTS, """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open_count,
       count(*) FILTER (WHERE severity = 'critical') AS critical_count FROM incidents
"""))
def incident_counts(spark, sf_dir):
    return A.incident_counts(T.incidents(spark, sf_dir))


@query("a11_counter_rollups", sql(f"{LOGS}, {INCIDENTS}, {ALERTS}", """
SELECT 'log_ingestion' AS counter, 'file_upload' AS label, level AS label2, count(*) AS n FROM logs GROUP BY level
UNION ALL SELECT 'incident', severity, '', count(*) FROM incidents GROUP BY severity
UNION ALL SELECT 'alert_fired', alert_type, severity, count(*) FROM alerts GROUP BY alert_type, severity
UNION ALL SELECT 'embedding_processed', '', '', count(*) FROM embeddings
UNION ALL SELECT 'clustering_runs', '', '', count(DISTINCT label) FROM embeddings
"""))
def counter_rollups(spark, sf_dir):
    logs = T.logs(spark, sf_dir).withColumn("source", F.lit("file_upload"))
    v = T.vectors(spark, sf_dir)
    parts = [
        ("log_ingestion", A.counter_rollup(logs, ["source", "level"]), "source", "level"),
        ("incident", A.counter_rollup(T.incidents(spark, sf_dir), ["severity"]), "severity", None),
        ("alert_fired", A.counter_rollup(T.alerts(spark, sf_dir), ["alert_type", "severity"]), "alert_type", "severity"),
        ("embedding_processed", A.counter_rollup(v, []), None, None),
        ("clustering_runs", A.counter_rollup(v.select("label").distinct(), []), None, None),
    ]
    label = lambda c: F.col(c) if c else F.lit("")
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("counter"), label(a).alias("label"), label(b).alias("label2"), "n")
        for name, df, a, b in parts])


@query("a12_gauges", sql(f"{LOGS}, {INCIDENTS}, {DEPTHS}", f"""
SELECT 'active_incidents' AS gauge, severity AS label, count(*)::DOUBLE AS value FROM incidents WHERE status = 'open' GROUP BY severity
UNION ALL SELECT 'queue_size', queue, arg_max(depth, ts)::DOUBLE FROM depths GROUP BY queue
UNION ALL SELECT 'events_per_second', '', count(*) / 60.0::DOUBLE FROM logs
          WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 60 SECONDS
UNION ALL SELECT 'error_rate', '', round(coalesce(avg(CASE WHEN {ERRORS} THEN 1.0 ELSE 0.0 END), 0), 4) FROM logs
          WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 300 SECONDS
"""))
def gauges(spark, sf_dir):
    logs, opened = T.logs(spark, sf_dir), L.filter_incidents(T.incidents(spark, sf_dir), "open")
    parts = [
        ("active_incidents", A.counter_rollup(opened, ["severity"]), F.col("severity"), F.col("n")),
        ("queue_size", A.last_queue_depth(depths(spark, sf_dir)), F.col("queue"), F.col("depth")),
        ("events_per_second", A.events_per_second(logs), F.lit(""), F.col("events_per_second")),
        ("error_rate", A.last_seconds(logs, 300).agg(A.error_rate().alias("r")), F.lit(""), F.col("r")),
    ]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("gauge"), label.alias("label"), value.cast("double").alias("value"))
        for name, df, label, value in parts])


STAGE = "CASE event_type WHEN 'error' THEN 'analysis' WHEN 'click' THEN 'embedding' ELSE 'pipeline' END"
_edges = ", ".join(f"('{s}', {float(e)}, '{e:.2f}')" for s, es in K.LATENCY_EDGES.items() for e in es)


@query("a13_latency_histogram", f"""
WITH s AS (SELECT {STAGE} AS stage, value AS seconds FROM events),
edges AS (SELECT * FROM (VALUES {_edges}) AS e(stage, edge, le)),
totals AS (SELECT stage, round(sum(seconds), 4) AS sum, count(*) AS count FROM s GROUP BY 1)
SELECT e.stage, e.le, count(*) FILTER (WHERE s.seconds <= e.edge) AS bucket_count, any_value(t.sum) AS sum, any_value(t.count) AS count
FROM edges e JOIN s USING (stage) JOIN totals t USING (stage) GROUP BY 1, 2
UNION ALL SELECT stage, '+Inf', count, sum, count FROM totals
""")
def latency_histogram(spark, sf_dir):
    samples = T.table(spark, sf_dir, "events").selectExpr(f"{STAGE} AS stage", "value AS seconds")
    return A.latency_histogram(samples).withColumn("sum", F.round("sum", 4))


@query("a14_events_timeline", sql(LOGS, f"""
SELECT time_bucket(INTERVAL 30 SECONDS, timestamp, TIMESTAMP '1970-01-01') AS bucket, count(*) AS events,
       count(*) FILTER (WHERE {ERRORS}) AS errors FROM logs GROUP BY 1
"""))
def events_timeline(spark, sf_dir):
    return A.events_timeline(T.logs(spark, sf_dir))


@query("a15_latency_percentiles", """
SELECT date_trunc('hour', ts) AS window_start, round(quantile_cont(value, 0.5), 6) AS p50_ms,
       round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY 1
""")
def latency_percentiles(spark, sf_dir):
    samples = T._utc(T.table(spark, sf_dir, "events")).select("ts", F.col("value").alias("ms"))
    out = A.latency_percentiles(samples, 3600)
    return out.select("window_start", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")])


@query("a15_percentiles_by_selection", """
SELECT date_trunc('day', ts) AS window_start, round(quantile_cont(value, 0.5), 6) AS p50_ms,
       round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY 1
""")
def percentiles_by_selection(spark, sf_dir):
    """The way of windows with more values than a task may gather."""
    samples = T._utc(T.table(spark, sf_dir, "events"))
    counted = samples.groupBy(A.window_start("ts", 86400).alias("window_start"), F.col("value").alias("ms")).agg(F.count("*").alias("n"))
    ranks = (0.5, 0.95, 0.99)
    found = A.percentiles_by_selection(cut_lineage(counted), ranks)
    return found.groupBy("window_start").agg(*[
        F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(c) for p, c in zip(ranks, ("p50_ms", "p95_ms", "p99_ms"), strict=True)])


@query("a15_rolled_up_sketches", """
SELECT date_trunc('day', ts) AS window_start, count(*) AS n, true AS p50_close, true AS p95_close, true AS p99_close FROM events GROUP BY 1
""")
def rolled_up_sketches(spark, sf_dir):
    """Daily percentiles from hourly sketches; close if their rank is within 5 % of the wanted one."""
    samples = T._utc(T.table(spark, sf_dir, "events")).select("ts", F.col("value").alias("ms"))
    rolled = A.rolled_up_percentiles(A.latency_sketches(samples, 3600), 86400)
    joined = samples.select(A.window_start("ts", 86400).alias("window_start"), "ms").join(rolled, "window_start")
    close = [((F.avg((F.col("ms") < F.col(c)).cast("int")) <= p + 0.05) & (F.avg((F.col("ms") <= F.col(c)).cast("int")) >= p - 0.05)).alias(
        f"{c[:3]}_close") for p, c in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))]
    return joined.groupBy("window_start", "n").agg(*close)


@query("a16_running_totals", sql(LOGS, """
SELECT batch, n, sum(n) OVER (ORDER BY batch)::BIGINT AS running_total
FROM (SELECT date_trunc('hour', timestamp) AS batch, count(*) AS n FROM logs GROUP BY 1)
"""))
def running_totals(spark, sf_dir):
    batches = T.logs(spark, sf_dir).groupBy(A.window_start("timestamp", 3600).alias("batch")).agg(F.count("*").alias("n"))
    return A.running_totals(batches, "batch", "n")


@query("a17_feed_stats", sql(FLAGS, f"""
SELECT count(*) AS entries, count(*) FILTER (WHERE {ERRORS}) AS errors, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM flagged
"""))
def feed_stats(spark, sf_dir):
    return A.feed_stats(D.flag_anomalies(T.logs(spark, sf_dir), 3600))


# ---------------------------------------------------------------- detection rules

_rank = "CASE " + " ".join(
    f"WHEN {hits('message', words)} THEN {K.SEVERITIES.index(name) + 1}" for name, words in K.SEVERITY_WORDS) + " ELSE 1 END"


@query("r01_severity", sql(LABELS, f"""
SELECT cluster_id, ['low', 'medium', 'high', 'critical'][max({_rank})] AS severity FROM members WHERE cluster_id IS NOT NULL GROUP BY 1
"""))
def severity(spark, sf_dir):
    members = T.clustered(spark, sf_dir).filter("cluster_id IS NOT NULL")
    worst = members.groupBy("cluster_id").agg(F.max(D.message_rank(F.col("message"))).alias("rank"))
    return worst.select("cluster_id", X.severity_name(F.col("rank")).alias("severity"))


@query("r02_rule_names", sql(LOGS + f""",
named AS (SELECT id, lower(message) AS txt FROM logs)""", "SELECT id, CASE " + " ".join(
    f"WHEN {hits('txt', words)} THEN '{name}'" for name, words in K.CLUSTER_NAMES) + " END AS name FROM named"))
def rule_names(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", D.rule_name(F.lower("message")).alias("name"))


@query("r03_cluster_names", sql(CLUSTERS, "SELECT cluster_id, name FROM names"))
def cluster_names(spark, sf_dir):
    members = T.clustered(spark, sf_dir).filter("cluster_id IS NOT NULL")
    return D.cluster_names(L.first_per_group(members, "cluster_id", ["timestamp", "id"], 5))


@query("r04_anomalies", sql(FLAGS, "SELECT id, is_anomaly, anomaly_score FROM flagged"))
def anomalies(spark, sf_dir):
    return D.flag_anomalies(T.logs(spark, sf_dir), 3600).select("id", "is_anomaly", "anomaly_score")


@query("r05_spikes", sql(LOGS, f"""
SELECT time_bucket(INTERVAL 300 SECONDS, timestamp, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total,
       count(*) FILTER (WHERE {ERRORS}) AS errors, count(*) FILTER (WHERE {ERRORS}) / count(*) > 0.3 AS is_spike
FROM logs GROUP BY 1
"""))
def spikes(spark, sf_dir):
    return D.with_spikes(D.window_rates(T.logs(spark, sf_dir))).drop("error_rate")


@query("r06_incidents", sql(CLUSTERS, """
SELECT id, title, description, severity, status, cluster_id, log_count, detected_at, affected_services FROM cases
"""))
def incidents(spark, sf_dir):
    from logharbor.operators.incidents import detect_incidents

    return detect_incidents(T.clusters(spark, sf_dir), T.clustered(spark, sf_dir)).drop("resolved_at")


@query("r07_redis_failures", sql(DAILY_ALERTS, "SELECT w AS window_start, a AS actual FROM measured WHERE a >= 5"))
def redis_failures(spark, sf_dir):
    logs = T.logs(spark, sf_dir)
    counted = logs.groupBy(A.window_start("timestamp", 86400).alias("window_start")).agg(D.redis_failures().alias("actual"))
    return counted.filter(F.col("actual") >= K.ALERT_RULES[0][3])


@query("r08_reconnect_storm", sql(DAILY_ALERTS, "SELECT w AS window_start, b AS actual FROM measured WHERE b >= 10"))
def reconnect_storm(spark, sf_dir):
    logs = T.logs(spark, sf_dir)
    counted = logs.groupBy(A.window_start("timestamp", 86400).alias("window_start")).agg(D.reconnects().alias("actual"))
    return counted.filter(F.col("actual") >= K.ALERT_RULES[1][3])


@query("r09_queue_saturation", sql(DEPTHS, """
SELECT w AS window_start, queue, 'queue_saturation' AS alert_type,
       concat('Queue size ', d, ' exceeds threshold 1000') AS message, d::DOUBLE AS actual_value
FROM (SELECT date_trunc('hour', ts) AS w, queue, max(depth) AS d FROM depths GROUP BY 1, 2) WHERE d >= 1000
"""))
def queue_saturation(spark, sf_dir):
    windowed = depths(spark, sf_dir).withColumn("window_start", A.window_start("ts", 3600))
    measured = D.queue_measures(windowed, ["window_start", "queue"])
    parts = D.threshold_alerts(measured, D.alert_rules(spark), "window_start", keep=["queue"])
    return parts.select(F.col("fired_at").alias("window_start"), "queue", "alert_type", "message", "actual_value")


@query("r10_alerts", sql(DAILY_ALERTS, """
SELECT alert_type, title, message, severity, 'firing' AS status, threshold_value, actual::DOUBLE AS actual_value, w AS fired_at FROM fired
"""))
def alerts(spark, sf_dir):
    return daily_alerts(spark, sf_dir).drop("id", "incident_id")


@query("r11_baseline_spikes", sql(LOGS + f""",
rates AS (SELECT date_trunc('hour', timestamp) AS w, count(*) FILTER (WHERE {ERRORS}) / count(*) AS r FROM logs GROUP BY 1),
based AS (SELECT w, r, avg(r) OVER (ORDER BY w RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 HOURS PRECEDING) AS b FROM rates)
""", """
SELECT w AS window_start, round(r, 6) AS error_rate, round(b, 6) AS baseline, coalesce(r > 3.0 * b, false) AS is_spike FROM based
"""))
def baseline_spikes(spark, sf_dir):
    rates = D.window_rates(T.logs(spark, sf_dir), 3600)
    out = D.baseline_spikes(rates, 3600, 24)
    return out.select("window_start", F.round("error_rate", 6).alias("error_rate"), F.round("baseline", 6).alias("baseline"), "is_spike")


@query("r12_isolated", sql(LABELS, """
SELECT id, level, service FROM members WHERE cluster_id IS NULL OR cluster_id NOT IN (
  SELECT cluster_id FROM members WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 300)
"""))
def isolated(spark, sf_dir):
    members = T.clustered(spark, sf_dir)
    big = members.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n >= 300 AND cluster_id IS NOT NULL")
    known = members.join(big.select("cluster_id"), "cluster_id", "left_semi")
    return D.isolated(members, known).select("id", "level", "service")
