"""Lookups, joins, top-k and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions import text as X
from logharbor.operators import lookups as L
from logharbor.operators import maintenance as M
from logharbor.operators import relations as J
from logharbor.plans import tables as T
from logharbor.plans.registry import query
from logharbor.plans.snippets import ALERTS, CLUSTERS, FLAGS, INCIDENTS, LABELS, LOGS, sql

INCIDENT_COLUMNS = ["id", "title", "severity", "status", "detected_at"]


# ---------------------------------------------------------------- lookups

@query("f01_point_lookup", sql(LOGS, "SELECT id, session_id, timestamp, level, service, message FROM logs WHERE id = '42'"))
def point_lookup(spark, sf_dir):
    return L.by_id(T.logs(spark, sf_dir), "42").select("id", "session_id", "timestamp", "level", "service", "message")


@query("f02_page", sql(INCIDENTS, "SELECT id, title, severity, status, detected_at FROM incidents ORDER BY id LIMIT 50 OFFSET 100"))
def page(spark, sf_dir):
    return L.page(T.incidents(spark, sf_dir).select(*INCIDENT_COLUMNS), ["id"], 100, 50)


@query("f03_session_logs", sql(LOGS, """
SELECT id, timestamp, level, message FROM logs WHERE session_id = 's7' ORDER BY timestamp, id LIMIT 100 OFFSET 20
"""))
def session_logs(spark, sf_dir):
    return L.session_logs(T.logs(spark, sf_dir), "s7", 20, 100).select("id", "timestamp", "level", "message")


@query("f04_anomalies", sql(FLAGS, """
SELECT id, timestamp, level, anomaly_score FROM flagged
WHERE is_anomaly AND timestamp >= TIMESTAMP '2024-01-15' ORDER BY timestamp DESC, id LIMIT 50
"""))
def anomalies(spark, sf_dir):
    since = F.lit("2024-01-15").cast("timestamp")
    flagged = T.flag_anomalies(T.logs(spark, sf_dir), 3600)
    return L.anomalies_since(flagged, since).select("id", "timestamp", "level", "anomaly_score")


@query("f05_unclustered", sql(LOGS, """
SELECT id, timestamp AS created_at FROM logs WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
ORDER BY timestamp, id LIMIT 200
"""))
def unclustered(spark, sf_dir):
    given = T.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("cluster_id"))
    logs = T.logs(spark, sf_dir).join(given, "id", "left")
    return L.unclustered(logs).select("id", "created_at")


@query("f06_filtered_incidents", sql(INCIDENTS, """
SELECT id, title, severity, status, detected_at, (SELECT count(*) FROM incidents WHERE status = 'open' AND severity = 'high') AS total
FROM incidents WHERE status = 'open' AND severity = 'high' ORDER BY detected_at DESC, id LIMIT 50
"""))
def filtered_incidents(spark, sf_dir):
    rows, total = L.list_incidents(T.incidents(spark, sf_dir), "open", "high")
    return rows.select(*INCIDENT_COLUMNS).withColumn("total", total.scalar())


@query("f07_open_incidents", sql(INCIDENTS, """
SELECT id, title, severity, status, detected_at FROM incidents WHERE status = 'open' ORDER BY detected_at DESC, id LIMIT 50
"""))
def open_incidents(spark, sf_dir):
    return L.list_incidents(T.incidents(spark, sf_dir), "open")[0].select(*INCIDENT_COLUMNS)


@query("f08_firing_alerts", sql(ALERTS, """
SELECT id, incident_id, alert_type, severity, fired_at FROM alerts WHERE status = 'firing' ORDER BY fired_at DESC, id LIMIT 50
"""))
def firing_alerts(spark, sf_dir):
    return L.firing_alerts(T.alerts(spark, sf_dir)).select("id", "incident_id", "alert_type", "severity", "fired_at")


@query("f09_text_search", sql(LOGS, """
SELECT id, level, service, message FROM logs
WHERE contains(lower(message), 'queue') OR contains(lower(service), 'queue') OR contains(lower(level), 'queue')
"""))
def text_search(spark, sf_dir):
    return L.text_search(T.logs(spark, sf_dir), "Queue").select("id", "level", "service", "message")


@query("f10_embedding_of_log", """
SELECT CAST(vec_id AS VARCHAR) AS log_entry_id, substring(sha256(CAST(vec_id AS VARCHAR)), 1, 32) AS chroma_id,
       len(embedding) AS embedding_dimension FROM embeddings WHERE vec_id = 17
""")
def embedding_of_log(spark, sf_dir):
    found = L.by_id(T.embedding_records(spark, sf_dir), "17", "log_entry_id")
    return found.select("log_entry_id", "chroma_id", "embedding_dimension")


@query("f11_metadata_filter", sql(LOGS, """
SELECT id, level, service FROM logs JOIN embeddings ON id = CAST(vec_id AS VARCHAR) WHERE level = 'ERROR' AND service = 'redis'
"""))
def metadata_filter(spark, sf_dir):
    corpus = T.logs(spark, sf_dir).join(T.vectors(spark, sf_dir), "id")
    return L.metadata_filter(corpus, "ERROR", "redis").select("id", "level", "service")


# ---------------------------------------------------------------- joins

@query("j01_without_embedding", sql(LOGS, """
SELECT id, timestamp AS created_at FROM logs WHERE id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)
"""))
def without_embedding(spark, sf_dir):
    pending = J.pending_embeddings(T.logs(spark, sf_dir), T.embedding_records(spark, sf_dir))
    return pending.select("id", "created_at")


@query("j02_incident_relations", sql(f"{INCIDENTS}, {ALERTS}", """
SELECT i.id, i.title, a.id AS alert_id, a.alert_type, a.fired_at, md5(d.text) AS summary
FROM incidents i LEFT JOIN alerts a ON a.incident_id = i.id LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = i.id
"""))
def incident_relations(spark, sf_dir):
    summaries = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("incident_id"),
        F.col("text").alias("executive_summary"), F.lit("m").alias("model_used"))
    joined = J.with_relations(T.incidents(spark, sf_dir).select("id", "title"), T.alerts(spark, sf_dir), summaries)
    return joined.select("id", "title", "alert_id", "alert_type", "fired_at", F.md5("executive_summary").alias("summary"))


@query("j03_cluster_ids", sql(LABELS, "SELECT id, cluster_id FROM members"))
def cluster_ids(spark, sf_dir):
    return J.attach_clusters(T.logs(spark, sf_dir), T.labels(spark, sf_dir)).select("id", "cluster_id")


@query("j04_affected_services", sql(CLUSTERS, """
SELECT c.id, array_to_string(list_sort(list_distinct(list(m.service))), '|') AS affected_services
FROM cases c LEFT JOIN members m ON m.cluster_id = c.cluster_id GROUP BY c.id
"""))
def affected_services(spark, sf_dir):
    cases = T.cluster_incidents(spark, sf_dir).select("id", "cluster_id")
    return J.affected_services(cases, T.clustered(spark, sf_dir))


@query("j05_vectors_for_ids", sql(LOGS, """
SELECT l.id AS log_id, len(e.embedding) AS dimension,
       array_to_string(list_transform(e.embedding, lambda x: CAST(floor(x::DOUBLE * 1000000) AS BIGINT)), '|') AS vector
FROM logs l JOIN embeddings e ON l.id = CAST(e.vec_id AS VARCHAR) WHERE l.level = 'ERROR'
"""))
def vectors_for_ids(spark, sf_dir):
    ids = T.logs(spark, sf_dir).filter("level = 'ERROR'").select("id")
    found = J.vectors_for_ids(ids, T.embedding_records(spark, sf_dir))
    whole = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string")), "|")
    return found.select("log_id", F.size("embedding").alias("dimension"), whole.alias("vector"))


@query("j06_logs_for_ids", sql(LOGS, "SELECT id, level, message FROM logs WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def logs_for_ids(spark, sf_dir):
    ids = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return J.logs_for_ids(T.logs(spark, sf_dir), ids).select("id", "level", "message")


@query("j07_incident_logs", sql(CLUSTERS, """
SELECT c.id AS incident_id, m.id, m.timestamp, m.rn AS rank FROM cases c JOIN (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS rn FROM members) m
ON m.cluster_id = c.cluster_id WHERE m.rn <= 50
"""))
def incident_logs(spark, sf_dir):
    found = J.incident_logs(T.cluster_incidents(spark, sf_dir), T.clustered(spark, sf_dir))
    return found.select("incident_id", "id", "timestamp", "rank")


DELETED = "gone AS (SELECT id FROM incidents WHERE status = 'resolved' AND severity = 'low')"


@query("j08_delete_set_null", sql(f"{INCIDENTS}, {ALERTS}, {DELETED}", """
SELECT a.id, CASE WHEN g.id IS NULL THEN a.incident_id END AS incident_id FROM alerts a LEFT JOIN gone g ON g.id = a.incident_id
"""))
def delete_set_null(spark, sf_dir):
    gone = T.incidents(spark, sf_dir).filter("status = 'resolved' AND severity = 'low'")
    return J.set_null_on_delete(T.alerts(spark, sf_dir), gone, "incident_id").select("id", "incident_id")


@query("j08_delete_cascade", sql(f"{INCIDENTS}, {DELETED}", """
SELECT doc_id, n_chars FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM gone)
"""))
def delete_cascade(spark, sf_dir):
    gone = T.incidents(spark, sf_dir).filter("status = 'resolved' AND severity = 'low'")
    summaries = T.table(spark, sf_dir, "documents").withColumn("incident_id", F.col("doc_id").cast("string"))
    return J.cascade_on_delete(summaries, gone, "incident_id").select("doc_id", "n_chars")


# ---------------------------------------------------------------- top-k

CLUSTER_COLUMNS = ["id", "name", "severity", "log_count", "tags", "first_seen", "last_seen"]


@query("t01_top_clusters", sql(CLUSTERS, """
SELECT id, name, severity, log_count, tags, first_seen, last_seen FROM clusters ORDER BY log_count DESC, id LIMIT 10
"""))
def top_clusters(spark, sf_dir):
    return L.top_clusters(T.clusters(spark, sf_dir)).select(*CLUSTER_COLUMNS)


@query("t02_recent_incidents", sql(INCIDENTS, """
SELECT id, title, severity, status, detected_at FROM incidents ORDER BY detected_at DESC, id LIMIT 5
"""))
def recent_incidents(spark, sf_dir):
    return L.recent_incidents(T.incidents(spark, sf_dir)).select(*INCIDENT_COLUMNS)


@query("t03_first_messages", sql(CLUSTERS, "SELECT cluster_id, message, rn AS rank FROM firsts"))
def first_messages(spark, sf_dir):
    members = T.clustered(spark, sf_dir).filter("cluster_id IS NOT NULL")
    return L.first_per_group(members, "cluster_id", ["timestamp", "id"], 5).select("cluster_id", "message", "rank")


def samples_sql(rows: int, line: str) -> str:
    return f"""
SELECT cluster_id, string_agg({line}, chr(10) ORDER BY rn) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS rn
      FROM members WHERE cluster_id IS NOT NULL) WHERE rn <= {rows} GROUP BY cluster_id
"""


SAMPLE = "concat('[', strftime(timestamp, '%H:%M:%S'), '] [', level, '] ', service, ': ', message)"
ISO_SAMPLE = "concat(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), ' [', level, '] ', service, ': ', message)"


@query("t04_log_samples", sql(LABELS, samples_sql(20, SAMPLE)))
def log_samples(spark, sf_dir):
    from logharbor.operators.rootcause import log_samples as samples

    return samples(T.clustered(spark, sf_dir))


@query("t05_timeline_samples", sql(LABELS, samples_sql(50, ISO_SAMPLE)))
def timeline_samples(spark, sf_dir):
    from logharbor.operators.rootcause import log_samples as samples

    return samples(T.clustered(spark, sf_dir), 50, iso=True)


@query("t06_latest_feed", sql(FLAGS, """
SELECT id, timestamp, level, service, message, is_anomaly FROM flagged ORDER BY timestamp DESC, id DESC LIMIT 200
"""))
def latest_feed(spark, sf_dir):
    flagged = T.flag_anomalies(T.logs(spark, sf_dir), 3600)
    return L.latest_feed(flagged).select("id", "timestamp", "level", "service", "message", "is_anomaly")


# ---------------------------------------------------------------- maintenance

CHANGES = """changes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version, l_shipdate AS changed_at,
         CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'R' THEN 'investigating' END AS status,
         CASE l_linestatus WHEN 'F' THEN 'critical' END AS severity,
         CASE WHEN l_returnflag = 'N' THEN concat('part ', CAST(l_partkey AS VARCHAR)) END AS description
  FROM lineitem),
last AS (
  SELECT id, (list(status ORDER BY version DESC) FILTER (WHERE status IS NOT NULL))[1] AS status,
         (list(severity ORDER BY version DESC) FILTER (WHERE severity IS NOT NULL))[1] AS severity,
         (list(description ORDER BY version DESC) FILTER (WHERE description IS NOT NULL))[1] AS description,
         (list(changed_at ORDER BY version DESC) FILTER (WHERE status = 'resolved'))[1] AS last_resolved
  FROM changes GROUP BY id)"""


def incident_changes(spark, sf_dir) -> DataFrame:
    item = T._utc(T.table(spark, sf_dir, "lineitem"))
    return item.select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("version"),
        F.col("l_shipdate").alias("changed_at"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'R' THEN 'investigating' END AS status"),
        F.expr("CASE l_linestatus WHEN 'F' THEN 'critical' END AS severity"),
        F.expr("CASE WHEN l_returnflag = 'N' THEN concat('part ', CAST(l_partkey AS STRING)) END AS description"),
    )


@query("m01_incident_changes", sql(f"{INCIDENTS}, {CHANGES}", """
SELECT i.id, coalesce(c.status, i.status) AS status, coalesce(c.severity, i.severity) AS severity,
       coalesce(c.description, i.description) AS description,
       coalesce(c.last_resolved, i.resolved_at) AS resolved_at
FROM incidents i LEFT JOIN last c ON c.id = i.id
"""))
def changed_incidents(spark, sf_dir):
    done = M.apply_incident_changes(T.incidents(spark, sf_dir), incident_changes(spark, sf_dir))
    return done.select("id", "status", "severity", "description", "resolved_at")


@query("m02_add_members", sql(CLUSTERS, """
SELECT c.id, c.log_count + count(m.id) AS log_count, greatest(c.last_seen, max(m.timestamp)) AS last_seen
FROM clusters c LEFT JOIN (SELECT * FROM members WHERE level = 'ERROR') m ON m.cluster_id = c.id
GROUP BY c.id, c.log_count, c.last_seen
"""))
def add_members(spark, sf_dir):
    new = T.clustered(spark, sf_dir).filter("level = 'ERROR'")
    return M.add_members(T.clusters(spark, sf_dir), new).select("id", "log_count", "last_seen")


EXPIRED = f"""{LOGS},
old AS (SELECT id FROM logs WHERE timestamp < TIMESTAMP '2024-01-02')"""


@query("m03_retention_kept", sql(EXPIRED, """
SELECT CAST(vec_id AS VARCHAR) AS log_entry_id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM old)
"""))
def retention_kept(spark, sf_dir):
    cutoff = F.lit("2024-01-02").cast("timestamp")
    kept, _ = M.split_expired(T.embedding_records(spark, sf_dir), T.logs(spark, sf_dir), cutoff)
    return kept.select("log_entry_id")


@query("m03_retention_deleted", sql(EXPIRED, """
SELECT count(*) AS deleted FROM embeddings WHERE CAST(vec_id AS VARCHAR) IN (SELECT id FROM old)
"""))
def retention_deleted(spark, sf_dir):
    cutoff = F.lit("2024-01-02").cast("timestamp")
    _, gone = M.split_expired(T.embedding_records(spark, sf_dir), T.logs(spark, sf_dir), cutoff)
    return gone.agg(F.count("*").alias("deleted"))


@query("m04_replace_and_delete", sql(INCIDENTS, """
SELECT id, CASE WHEN severity = 'critical' THEN 'investigating' ELSE status END AS status, severity FROM incidents
WHERE NOT (severity = 'low' AND status = 'resolved')
"""))
def replace_and_delete(spark, sf_dir):
    table = T.incidents(spark, sf_dir).select("id", "status", "severity")
    changed = table.filter("severity = 'critical'").withColumn("status", F.lit("investigating"))
    gone = table.filter("severity = 'low' AND status = 'resolved'")
    return M.delete_rows(M.replace_rows(table, changed), gone)


@query("v11_upsert_vectors", """
WITH store AS (SELECT vec_id, embedding, 1 AS version FROM embeddings
               UNION ALL SELECT vec_id, list_transform(embedding, lambda x: (x * 2)::FLOAT), 2 FROM embeddings WHERE label < 5)
SELECT CAST(vec_id AS VARCHAR) AS id, version::BIGINT AS version, embedding[1]::DOUBLE AS first_value
FROM store QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) = 1
""")
def upsert_vectors(spark, sf_dir):
    store = T.vectors(spark, sf_dir).select("id", "label", "embedding").withColumn("version", F.lit(1))
    doubled = F.transform("embedding", lambda x: (x * 2).cast("float"))
    new = store.filter("label < 5").withColumns({"embedding": doubled, "version": F.lit(2)})
    rows = M.upsert(store, new, ["id"], "version")
    return rows.select("id", "version", F.element_at("embedding", 1).alias("first_value"))
