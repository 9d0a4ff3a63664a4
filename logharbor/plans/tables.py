"""Log, incident and alert tables derived from the given test tables.

Each has a Spark form and the same SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.clustering import cluster_logs, cluster_summary
from logharbor.operators.detection import flag_anomalies
from logharbor.operators.incidents import detect_incidents
from logharbor.operators.relations import attach_clusters
from logharbor.session import apply_settings, cut_lineage

# Line templates of the log view: number, level, service, text.
TEMPLATES = """
 (0,'ERROR','redis','cache node refused the handshake'),(1,'ERROR','redis','reply timeout while reading keys'),
 (2,'ERROR','gateway','socket closed, peer will reconnect'),(3,'CRITICAL','worker','process killed by oom guard'),
 (4,'ERROR','db','pool exhausted for tenant'),(5,'CRITICAL','db','volume reports disk full'),
 (6,'ERROR','api','handler exception on checkout'),(7,'ERROR','gateway','disconnect seen on shard'),
 (8,'INFO','api','order accepted'),(9,'INFO','db','commit done'),
 (10,'WARNING','api','slow upstream on payment'),(11,'INFO','queue','message acknowledged'),
 (12,'INFO','api','account created'),(13,'DEBUG','cache','profile warmed'),
 (14,'WARNING','worker','retry of welcome mail'),(15,'INFO','db','row inserted'),
 (16,'INFO','api','click recorded'),(17,'DEBUG','gateway','frame flushed'),
 (18,'INFO','cache','lookup hit'),(19,'WARNING','queue','queue full, shedding load'),
 (20,'INFO','api','page rendered'),(21,'DEBUG','cache','entry evicted'),
 (22,'INFO','gateway','heartbeat ok'),(23,'INFO','worker','idle tick')
"""

SPARK_TEXT = {
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "space": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "clf": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "str": "STRING",
}
DUCK_TEXT = {
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "space": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "str": "VARCHAR",
}


TEMPLATE_NUMBER = """CASE event_type WHEN 'error' THEN event_id % 8
    WHEN 'purchase' THEN 8 + event_id % 4
    WHEN 'signup' THEN 12 + event_id % 4
    WHEN 'click' THEN 16 + event_id % 4
    ELSE 20 + event_id % 4 END AS tid"""


def log_columns(text: dict[str, str]) -> list[str]:
    """Columns of the log view over events joined with their template."""
    message = f"concat(base, ' attempt ', CAST(event_id % 3 AS {text['str']}))"
    return [
        f"CAST(event_id AS {text['str']}) AS id",
        f"concat('s', CAST(user_id % 20 AS {text['str']})) AS session_id",
        "ts AS timestamp", "level", "service", f"{message} AS message", "event_id", "value", "user_id",
        f"""CASE event_id % 5
    WHEN 0 THEN concat({text['iso']}, 'Z ', level, ' ', service, ': ', {message})
    WHEN 1 THEN concat({text['space']}, ' ', level, ' ', service, ': ', {message})
    WHEN 2 THEN concat({text['clf']}, ' ', service, ' ', {message})
    WHEN 3 THEN concat('{{"ts":"', {text['iso']}, '","severity":"', lower(level), '","app":"', service,
                       '","msg":"', {message}, '","attempt":', CAST(event_id % 3 AS {text['str']}), '}}')
    ELSE concat('[', {text['iso']}, '] [', level, '] [', service, '] ', {message}) END AS raw_line""",
    ]


INCIDENTS_SQL = """
SELECT CAST(o_orderkey AS {str}) AS id,
       concat('Order incident ', CAST(o_orderkey AS {str})) AS title,
       concat('customer ', CAST(o_custkey AS {str})) AS description,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
                            WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'investigating' END AS status,
       CAST(o_custkey AS {str}) AS cluster_id,
       o_orderdate AS detected_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resolved_at
FROM {orders}
"""

ALERTS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS {str}), CAST(l_linenumber AS {str}),
                 CAST(l_partkey AS {str}), CAST(l_suppkey AS {str})) AS id,
       CAST(l_orderkey AS {str}) AS incident_id,
       CASE l_returnflag WHEN 'A' THEN 'redis_failure_threshold' WHEN 'N' THEN 'reconnect_storm'
                         ELSE 'queue_saturation' END AS alert_type,
       CASE l_returnflag WHEN 'A' THEN 'Redis Failure Threshold Exceeded'
                         WHEN 'N' THEN 'Reconnect Storm Detected'
                         ELSE 'Ingestion Queue Saturation' END AS title,
       CASE l_returnflag WHEN 'R' THEN 'medium' ELSE 'high' END AS severity,
       CASE l_linestatus WHEN 'O' THEN 'firing' ELSE 'resolved' END AS status,
       l_quantity AS actual_value, l_shipdate AS fired_at
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text, **frames)


def _utc(df: DataFrame) -> DataFrame:
    """Zone-less times of the test tables as UTC timestamps."""
    zoned = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df


def logs_of(events: DataFrame) -> DataFrame:
    """The log view of an events frame or stream; ``created_at`` is the event time."""
    lines = events.sparkSession.sql(f"SELECT * FROM VALUES {TEMPLATES} AS v(tid, level, service, base)")
    numbered = _utc(events).selectExpr("event_id", "ts", "user_id", "value", TEMPLATE_NUMBER)
    return numbered.join(lines, "tid").selectExpr(*log_columns(SPARK_TEXT), "ts AS created_at")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, INCIDENTS_SQL.replace("{str}", "STRING"), orders=_utc(table(spark, sf_dir, "orders")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, ALERTS_SQL.replace("{str}", "STRING"), lineitem=_utc(table(spark, sf_dir, "lineitem")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector store: one vector per log id, with the stable key."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logharbor.functions.text import vector_id

    v = vectors(spark, sf_dir)
    return v.select(
        F.col("id").alias("log_entry_id"), vector_id(F.col("id")).alias("chroma_id"),
        F.lit("table").alias("model_name"), F.size("embedding").alias("embedding_dimension"),
        "embedding",
    )


# ---------------------------------------------------------------- stored results

_stored: dict[tuple, DataFrame] = {}


def _store(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived tables are written once per session and folder, as stored tables are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = cut_lineage(build())
    return _stored[key]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "labels", lambda: cluster_logs(logs(spark, sf_dir)))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with cluster ids and anomaly flags per hour."""
    return flag_anomalies(attach_clusters(logs(spark, sf_dir), labels(spark, sf_dir)), 3600)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "clusters", lambda: cluster_summary(
        attach_clusters(logs(spark, sf_dir), labels(spark, sf_dir))))


def cluster_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = attach_clusters(logs(spark, sf_dir), labels(spark, sf_dir))
    return _store(spark, sf_dir, "incidents", lambda: detect_incidents(clusters(spark, sf_dir), members))


# ---------------------------------------------------------------- oracle SQL

LOGS = f"""logs AS (SELECT {", ".join(log_columns(DUCK_TEXT))}
FROM (SELECT event_id, ts, user_id, value, {TEMPLATE_NUMBER} FROM events) e
JOIN (SELECT * FROM (VALUES {TEMPLATES}) AS v(tid, level, service, base)) t ON e.tid = t.tid)"""
INCIDENTS = f"incidents AS ({INCIDENTS_SQL.replace('{str}', 'VARCHAR').replace('{orders}', 'orders')})"
ALERTS = f"alerts AS ({ALERTS_SQL.replace('{str}', 'VARCHAR').replace('{lineitem}', 'lineitem')})"
