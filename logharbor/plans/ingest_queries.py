"""Scans, sinks and line parsing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import parsing as P
from logharbor.functions import text as X
from logharbor.functions import vectors as V
from logharbor.operators.detection import alert_rules, rule_measures, threshold_alerts
from logharbor.operators.metrics import window_start
from logharbor.plans import tables as T
from logharbor.plans.registry import query
from logharbor.plans.snippets import CLUSTERS, LOGS, PARSED, hits, sql
from logharbor.session import new_folder
from logharbor.sources import readers as R
from logharbor.sources import sinks as W
from logharbor.sources.log_table import LogTable
from logharbor.streaming import jobs as J

INGEST_TIME = datetime(2024, 2, 1, tzinfo=timezone.utc)


def ingest_time():
    return F.lit(INGEST_TIME)


# ---------------------------------------------------------------- scans

@query("s01_text_scan", sql(LOGS + f""",
text AS (SELECT *, CASE WHEN raw_line[3] = '/' THEN timestamp END AS clf FROM logs),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw_line, '{K.ISO_STAMP}', ''),
                   '{K.SPACE_STAMP}', ''), '{K.CLF_STAMP}', '') AS a FROM text),
stripped AS (SELECT *, regexp_replace(a, '{K.LEVEL_WORD}', '') AS b FROM bare)
""", f"""
SELECT date_trunc('second', timestamp) AS timestamp,
       CASE WHEN clf IS NULL THEN level
            WHEN {hits('raw_line', K.LEVEL_HINTS[0][1])} THEN 'ERROR'
            WHEN {hits('raw_line', K.LEVEL_HINTS[1][1])} THEN 'WARNING'
            WHEN {hits('raw_line', K.LEVEL_HINTS[2][1])} THEN 'CRITICAL' ELSE 'INFO' END AS level,
       service,
       trim(regexp_replace(b, '^(\\s*[\\[(][A-Z]*[\\])]\\s*)+', '')) AS message, raw_line
FROM stripped
"""))
def text_scan(spark, sf_dir):
    folder = new_folder(spark, "text")
    T.logs(spark, sf_dir).select("raw_line").write.text(folder)
    rows = R.read_text_logs(spark, folder, "s", ingest_time())
    return rows.select("timestamp", "level", "service", "message", "raw_line")


@query("s02_json_scan", sql(PARSED, "SELECT timestamp, level, service, message, raw_line FROM parsed"))
def json_scan(spark, sf_dir):
    folder = new_folder(spark, "json")
    T.logs(spark, sf_dir).select("raw_line").write.text(folder)
    rows = R.read_json_logs(spark, folder, "s", ingest_time())
    return rows.select("timestamp", "level", "service", "message", "raw_line")


@query("s03_csv_scan", sql(LOGS, """
SELECT date_trunc('second', timestamp) AS timestamp, level, service, message, concat('session=', session_id) AS extra
FROM logs
"""))
def csv_scan(spark, sf_dir):
    folder = new_folder(spark, "csv")
    T.logs(spark, sf_dir).select(
        X.iso_text(F.col("timestamp")).alias("timestamp"), "level", "service", "message",
        F.col("session_id").alias("session"),
    ).write.csv(folder, header=True, escape='"')
    rows = R.read_csv_logs(spark, folder, "s", ingest_time())
    extra = F.array_join(F.transform(F.map_entries("extra_fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("timestamp", "level", "service", "message", extra.alias("extra"))


@query("s04_detect_format", "SELECT f AS written, f AS format FROM (VALUES ('csv'), ('json'), ('text')) t(f)")
def detect_format(spark, sf_dir):
    logs = T.logs(spark, sf_dir)
    root = new_folder(spark, "formats")
    stamp = X.iso_text(F.col("timestamp"))
    logs.select(F.to_json(F.struct("level", "service", "message"))).write.text(f"{root}/json")
    logs.select(X.iso_line(F.col("timestamp"), F.col("level"), F.col("service"), F.col("message"))).write.text(f"{root}/text")
    logs.select(stamp.alias("timestamp"), "level", "service", "message").write.csv(f"{root}/csv", header=True)
    found = R.detect_formats(spark, [f"{root}/json", f"{root}/text", f"{root}/csv"])
    return found.select(F.regexp_extract("file", "/(json|text|csv)/", 1).alias("written"), "format").distinct()


@query("s05_utf8_repair", "SELECT doc_id, md5(concat(text, chr(65533))) AS digest, false AS was_valid FROM documents")
def utf8_repair(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    bad = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    return docs.select("doc_id", F.md5(F.make_valid_utf8(bad)).alias("digest"), F.is_valid_utf8(bad).alias("was_valid"))


@query("s06_line_batches", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS total_lines,
       count(*) FILTER (WHERE regexp_replace(line, '\\s', '', 'g') <> '') AS processed_lines,
       count(*) FILTER (WHERE regexp_replace(line, '\\s', '', 'g') = '') AS error_lines
FROM lines GROUP BY doc_id
""")
def line_batches(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.batch_counts(lines, ["doc_id"])


@query("s07_live_source", sql(PARSED, "SELECT level, service, count(*) AS n FROM parsed GROUP BY 1, 2"))
def live_source(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    stream = J.file_stream(spark, sf_dir, events.schema, pathGlobFilter="events.parquet")
    lines = T.logs_of(stream).select("id", F.col("raw_line").alias("line"))
    rows = J.ingest_stream(lines, new_folder(spark, "live"), new_folder(spark, "live-state"), ingest_time())
    return rows.groupBy("level", "service").agg(F.count("*").alias("n"))


@query("s08_bulk_append", sql(LOGS, """
SELECT strftime(timestamp, '%Y-%m-%d') AS event_date, count(*) AS n, count(DISTINCT id) AS ids FROM logs GROUP BY 1
"""))
def bulk_append(spark, sf_dir):
    folder = new_folder(spark, "logs")
    W.append_logs(T.logs(spark, sf_dir), folder)
    back = spark.read.parquet(folder)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("s09_live_messages", sql(CLUSTERS, """
SELECT id, concat('{"type":"log_entry","payload":{"id":"', id, '","timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'),
       '","level":"', level, '","service":"', service, '","message":"', message[1:200],
       '","is_anomaly":', is_anomaly, '}}') AS value
FROM (SELECT * FROM flagged ORDER BY timestamp, id LIMIT 10)
UNION ALL
SELECT id, concat('{"type":"incident","payload":{"id":"', id, '","title":"', title, '","severity":"', severity,
       '","detected_at":"', strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%f'), '"}}') FROM cases
"""))
def live_messages(spark, sf_dir):
    return W.live_messages(T.clustered(spark, sf_dir), T.cluster_incidents(spark, sf_dir))


DAILY_ALERTS = f"""
{LOGS},
measured AS (SELECT date_trunc('day', timestamp) AS w,
                    count(*) FILTER (WHERE service LIKE '%redis%' AND level IN ('ERROR', 'CRITICAL')) AS a,
                    count(*) FILTER (WHERE regexp_matches(lower(message), 'reconnect|disconnect')) AS b FROM logs GROUP BY 1),
fired AS (
  SELECT 'redis_failure_threshold' AS alert_type, 'Redis Failure Threshold Exceeded' AS title, 'high' AS severity,
         5.0::DOUBLE AS threshold_value, a AS actual, concat('Detected ', a, ' Redis failures in current batch') AS message, w
  FROM measured WHERE a >= 5
  UNION ALL
  SELECT 'reconnect_storm', 'Reconnect Storm Detected', 'high', 10.0::DOUBLE, b, concat('Detected ', b, ' reconnect events'), w
  FROM measured WHERE b >= 10)
"""


def daily_alerts(spark, sf_dir):
    logs = T.logs(spark, sf_dir).withColumn("window_start", window_start("timestamp", 86400))
    return threshold_alerts(rule_measures(logs, ["window_start"]), alert_rules(spark), "window_start")


@query("s10_alert_messages", sql(DAILY_ALERTS, """
SELECT sha256(concat(alert_type, '#', strftime(w, '%Y-%m-%dT%H:%M:%S'))) AS id,
       concat('{"type":"alert","alert_type":"', alert_type, '","title":"', title, '","severity":"', severity,
              '","timestamp":"', strftime(w, '%Y-%m-%dT%H:%M:%S'), '"}') AS value FROM fired
"""))
def alert_messages(spark, sf_dir):
    return W.alert_messages(daily_alerts(spark, sf_dir))


@query("s11_session_audit", sql(LOGS, """
SELECT session_id AS id, 'file_upload' AS source, count(*) AS total_lines, count(*) AS processed_lines,
       0::BIGINT AS error_lines, 'completed' AS status, min(timestamp) AS started_at, max(timestamp) AS completed_at
FROM logs GROUP BY session_id
"""))
def session_audit(spark, sf_dir):
    logs = T.logs(spark, sf_dir)
    lines = logs.select("session_id", F.col("raw_line").alias("line"))
    times = logs.groupBy("session_id").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    counts = R.line_counts(lines, ["session_id"]).join(times, "session_id")
    return W.session_audit(counts, "file_upload", F.col("t0"), F.col("t1"))


@query("s12_ingestion_result", sql(CLUSTERS, """
SELECT (SELECT count(*) FROM logs) AS total_lines, (SELECT count(*) FROM logs) AS processed_lines, 0::BIGINT AS error_lines,
       (SELECT count(*) FROM cases) AS incidents_detected, (SELECT count(*) FROM clusters) AS clusters_updated
"""))
def ingestion_result(spark, sf_dir):
    lines = T.logs(spark, sf_dir).select("session_id", F.col("raw_line").alias("line"))
    return W.ingestion_result(
        R.line_counts(lines, ["session_id"]), T.cluster_incidents(spark, sf_dir), T.clusters(spark, sf_dir))


@query("s13_line_cap", sql(LOGS, """
SELECT session_id, id FROM logs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id) <= 100
"""))
def line_cap(spark, sf_dir):
    return R.cap_lines(T.logs(spark, sf_dir), "session_id", "event_id", 100).select("session_id", "id")


@query("s05_read_lines", """
SELECT md5(concat(CAST(doc_id AS VARCHAR), ' ', translate(text, concat(chr(10), chr(13)), '  '), chr(65533))) AS digest, count(*) AS lines
FROM documents GROUP BY 1
""")
def read_bad_lines(spark, sf_dir):
    """Whole texts as lines of files, each with a byte that is no UTF-8."""
    text = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.translate("text", "\n\r", "  "))
    bad = F.concat(text.cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    folder = new_folder(spark, "bad-bytes")
    T.table(spark, sf_dir, "documents").select(bad.alias("line")).write.text(folder)
    return R.read_lines(spark, folder).groupBy(F.md5("line").alias("digest")).agg(F.count("*").alias("lines"))


@query("s06_ingest_batch", sql(PARSED, """
SELECT sha256(concat_ws('#', 'batch', CAST(event_id AS VARCHAR), l.raw_line)) AS id, p.timestamp, p.level, p.service, p.message
FROM logs l JOIN parsed p USING (id) QUALIFY row_number() OVER (ORDER BY event_id) <= 10000
"""))
def ingest_batch(spark, sf_dir):
    """A line batch with the cap of the feature, 10,000 lines."""
    lines = T.logs(spark, sf_dir).select(F.col("event_id").alias("line_no"), F.col("raw_line").alias("line"))
    return R.ingest_batch(lines, "batch", ingest_time(), K.MAX_BATCH_LINES).select("id", "timestamp", "level", "service", "message")


@query("s13_file_line_cap", sql(LOGS, """
SELECT session_id, (row_number() OVER w - 1)::BIGINT AS line_no, raw_line FROM logs
WINDOW w AS (PARTITION BY session_id ORDER BY event_id) QUALIFY row_number() OVER w <= 100
"""))
def file_line_cap(spark, sf_dir):
    """A file per session, read up to 100 lines each."""
    folder = new_folder(spark, "capped")
    lines = T.logs(spark, sf_dir).repartition("session_id").sortWithinPartitions("session_id", "event_id")
    lines.select("session_id", "raw_line").write.partitionBy("session_id").text(folder)
    session = F.regexp_extract("file", "session_id=([^/]+)", 1)
    return R.read_numbered_lines(spark, folder, max_lines=100).select(session.alias("session_id"), "line_no", F.col("line").alias("raw_line"))


@query("s03_split_csv", """
SELECT doc_id, source, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS text FROM documents
""")
def split_csv(spark, sf_dir):
    """Whole texts with their quotes and line breaks as CSV, read from files that are split anywhere."""
    folder = new_folder(spark, "split-csv")
    T.table(spark, sf_dir, "documents").select("doc_id", "source", "text").write.csv(folder, header=True, escape='"', emptyValue="")
    records = R.read_csv_records(spark, folder).filter("record_no > 0")
    row = F.from_csv("record", "doc_id bigint, source string, text string", {"escape": '"', "maxCharsPerColumn": "-1"})
    return records.select(row.alias("r")).select("r.doc_id", "r.source", F.coalesce("r.text", F.lit("")).alias("text"))


def _merged(spark, sf_dir) -> LogTable:
    """The log view written in overlapping halves, one of them twice."""
    logs = T.logs(spark, sf_dir).select("id", "timestamp", "level", "service", "message", "event_id")
    table = LogTable(spark, new_folder(spark, "log-table"))
    for some in ("event_id % 3 < 2", "event_id % 3 < 2", "event_id % 3 > 0"):
        table.merge(logs.filter(some))
    return table


@query("s08_merge_rows", sql(LOGS, "SELECT id, timestamp, level, service, message FROM logs"))
def merge_rows(spark, sf_dir):
    return _merged(spark, sf_dir).read().drop("event_id")


@query("m03_expired_dates", sql(LOGS, "SELECT id, level FROM logs WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00'"))
def expired_dates(spark, sf_dir):
    table = _merged(spark, sf_dir)
    table.expire(F.lit("2024-01-15 10:00:00").cast("timestamp"))
    return table.read().select("id", "level")


@query("m04_rewritten_rows", sql(LOGS, """
SELECT id, CASE WHEN event_id % 7 = 1 THEN 'changed' ELSE message END AS message FROM logs WHERE event_id % 7 <> 0
"""))
def rewritten_rows(spark, sf_dir):
    table = _merged(spark, sf_dir)
    logs = T.logs(spark, sf_dir).select("id", "timestamp", "level", "service", "message", "event_id")
    table.delete(logs.filter("event_id % 7 = 0"))
    table.replace(logs.filter("event_id % 7 = 1").withColumn("message", F.lit("changed")))
    return table.read().select("id", "message")


# ---------------------------------------------------------------- parsing expressions

@query("p01_timestamp", sql(LOGS, "SELECT id, date_trunc('second', timestamp) AS parsed FROM logs"))
def timestamps(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", P.parse_timestamp(F.col("raw_line"), ingest_time()).alias("parsed"))


@query("p02_level", sql(PARSED, "SELECT id, level FROM parsed"))
def levels(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", P.parse_level(F.col("raw_line")).alias("level"))


@query("p03_service", sql(LOGS, "SELECT id, service FROM logs"))
def services(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", P.parse_service(F.col("raw_line")).alias("service"))


JSON_LINES = LOGS + """,
j AS (SELECT id, raw_line FROM logs WHERE raw_line[1] = '{')
"""


def json_lines(spark, sf_dir):
    logs = T.logs(spark, sf_dir).withColumn("fields", P.json_fields(F.col("raw_line")))
    return logs.filter(F.col("fields").isNotNull())


@query("p04_json_aliases", sql(JSON_LINES, """
SELECT id, raw_line->>'$.msg' AS message, raw_line->>'$.severity' AS level, raw_line->>'$.ts' AS stamp,
       raw_line->>'$.app' AS service FROM j
"""))
def json_aliases(spark, sf_dir):
    f = F.col("fields")
    return json_lines(spark, sf_dir).select(
        "id", P.first_present(f, K.JSON_MESSAGE_KEYS).alias("message"), P.first_present(f, K.JSON_LEVEL_KEYS).alias("level"),
        P.first_present(f, K.JSON_TIME_KEYS).alias("stamp"), P.first_present(f, K.JSON_SERVICE_KEYS).alias("service"))


@query("p05_json_time", sql(JSON_LINES, "SELECT id, CAST(raw_line->>'$.ts' AS TIMESTAMP) AS parsed FROM j"))
def json_time(spark, sf_dir):
    stamp = P.first_present(F.col("fields"), K.JSON_TIME_KEYS)
    return json_lines(spark, sf_dir).select("id", P.parse_json_timestamp(stamp, ingest_time()).alias("parsed"))


@query("p06_residual_fields", sql(JSON_LINES, """
SELECT id, concat('app=', raw_line->>'$.app', ',attempt=', raw_line->>'$.attempt', ',ts=', raw_line->>'$.ts') AS extra FROM j
"""))
def residual_fields(spark, sf_dir):
    rest = P.residual_fields(F.col("fields"), K.JSON_CONSUMED_KEYS)
    pairs = F.transform(F.map_entries(rest), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return json_lines(spark, sf_dir).select("id", F.array_join(F.array_sort(pairs), ",").alias("extra"))


@query("p07_clean_message", sql(PARSED, "SELECT id, message FROM parsed WHERE raw_line[1] <> '{'"))
def clean_message(spark, sf_dir):
    text = T.logs(spark, sf_dir).filter(~P.starts_object(F.col("raw_line")))
    return text.select("id", P.clean_message(F.col("raw_line")).alias("message"))


@query("p08_csv_roles", """
SELECT CAST(event_id AS VARCHAR) AS message, date_trunc('second', ts) AS timestamp, 'INFO' AS level,
       'event_type,props,user_id,value' AS extra_keys, event_type
FROM events
""")
def csv_roles(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    text = events.select(*[F.col(c).cast("string") for c in events.columns], F.col("event_id").cast("string").alias("id"))
    rows = R.parse_records(text, ingest_time())
    keys = F.array_join(F.array_sort(F.map_keys("extra_fields")), ",")
    return rows.select("message", "timestamp", "level", keys.alias("extra_keys"),
                       F.col("extra_fields")["event_type"].alias("event_type"))


@query("p09_truncate", """
SELECT doc_id, md5(substring(text, 1, 5000)) AS message, md5(substring(text, 1, 2000)) AS raw_line,
       md5(substring(text, 1, 200)) AS feed FROM documents
""")
def truncated(spark, sf_dir):
    text = F.col("text")
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(P.truncate(text, K.MESSAGE_CHARS)).alias("message"),
        F.md5(P.truncate(text, K.RAW_LINE_CHARS)).alias("raw_line"), F.md5(P.truncate(text, K.FEED_CHARS)).alias("feed"))


@query("p10_vector_id", sql(LOGS, "SELECT id, substring(sha256(id), 1, 32) AS vector_id FROM logs"))
def vector_ids(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", X.vector_id(F.col("id")).alias("vector_id"))


@query("p11_row_id", sql(LOGS, "SELECT id, sha256(concat_ws('#', session_id, CAST(event_id AS VARCHAR), raw_line)) AS row_id FROM logs"))
def row_ids(spark, sf_dir):
    lines = T.logs(spark, sf_dir).select(
        F.col("id").alias("log_id"), F.col("session_id").alias("file"), F.col("event_id").alias("line_no"),
        F.col("raw_line").alias("line"))
    return R.with_line_ids(lines).select(F.col("log_id").alias("id"), F.col("id").alias("row_id"))


@query("p12_stream_dispatch", sql(PARSED, "SELECT id, timestamp, level, service, message, raw_line, 'websocket' AS source FROM parsed"))
def stream_dispatch(spark, sf_dir):
    lines = T.logs(spark, sf_dir).select("id", F.col("raw_line").alias("line"))
    return R.parse_lines(lines, ingest_time(), source="websocket").drop("extra_fields")


@query("p13_validation", """
SELECT d.doc_id, length(text) BETWEEN 1 AND 10000 AS message_ok, lang IN ('en', 'fr') AS lang_ok,
       coalesce(n_chars / 10000.0 BETWEEN 0 AND 1, false) AS confidence_ok FROM documents d
""")
def validation(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", X.valid_message(F.col("text")).alias("message_ok"),
        X.valid_enum(F.col("lang"), ["en", "fr"]).alias("lang_ok"),
        X.valid_confidence(F.col("n_chars") / 10000.0).alias("confidence_ok"))


@query("p14_upper_level", "SELECT event_id, coalesce(upper(nullif(event_type, 'view')), 'INFO') AS level FROM events")
def upper_level(spark, sf_dir):
    given = F.nullif(F.col("event_type"), F.lit("view"))
    return T.table(spark, sf_dir, "events").select("event_id", X.upper_level(given).alias("level"))


@query("p15_embedding_text", sql(LOGS, "SELECT id, concat('[', level, '] ', service, ': ', message) AS text FROM logs"))
def embedding_text(spark, sf_dir):
    text = X.embedding_text(F.col("level"), F.col("service"), F.col("message"))
    return T.logs(spark, sf_dir).select("id", text.alias("text"))


@query("p16_sample_line", sql(LOGS, """
SELECT id, concat('[', strftime(timestamp, '%H:%M:%S'), '] [', level, '] ', service, ': ', message) AS sample,
       concat(strftime(timestamp, '%Y-%m-%dT%H:%M:%S'),
              CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END,
              ' [', level, '] ', service, ': ', message) AS iso FROM logs
"""))
def sample_line(spark, sf_dir):
    parts = [F.col(c) for c in ("timestamp", "level", "service", "message")]
    return T.logs(spark, sf_dir).select("id", X.sample_line(*parts).alias("sample"), X.iso_line(*parts).alias("iso"))


@query("p17_hour_day", sql(LOGS, "SELECT id, hour(timestamp) AS hour, dayofweek(timestamp) AS day FROM logs"))
def hour_day(spark, sf_dir):
    return T.logs(spark, sf_dir).select("id", F.hour("timestamp").alias("hour"), X.day_of_week(F.col("timestamp")).alias("day"))


@query("p18_similarity_percent", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, printf('%.0f%%', round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 9) * 100) AS similarity
FROM embeddings
""")
def similarity_percent(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    query_vector = e.filter("vec_id = 0").first()["embedding"]
    near = F.round(V.cosine(F.col("embedding"), V.as_vector(query_vector)), 9)
    return e.select("vec_id", X.similarity_percent(1 - near).alias("similarity"))
