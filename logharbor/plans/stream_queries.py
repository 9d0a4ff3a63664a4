"""Streaming jobs over the event file, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.operators.detection import alert_rules, queue_measures, threshold_alerts
from logharbor.plans import tables as T
from logharbor.plans.ingest_queries import ingest_time
from logharbor.plans.registry import query
from logharbor.plans.snippets import CLUSTERS, ERRORS, FLAGS, LOGS, PARSED, hits, sql
from logharbor.session import new_folder
from logharbor.streaming import jobs as J
from logharbor.streaming.ingest import LiveTables, run_ingest
from logharbor.sources.readers import parse_lines, read_lines
from logharbor.streaming.run_metrics import backlog, drop_replays_within, run_counted, write_with_audit


def events_stream(spark, sf_dir) -> DataFrame:
    schema = T.table(spark, sf_dir, "events").schema
    return J.file_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def logs_stream(spark, sf_dir) -> DataFrame:
    return T.logs_of(events_stream(spark, sf_dir))


def shuffled_logs_stream(spark, sf_dir, parts: int = 6) -> DataFrame:
    """The events dealt to files by a hash of their id, so that every micro-batch spans all times."""
    folder = new_folder(spark, "shuffled")
    events = T.table(spark, sf_dir, "events")
    events.repartition(parts, F.xxhash64("event_id")).write.parquet(folder)
    return T.logs_of(J.file_stream(spark, folder, events.schema, maxFilesPerTrigger=1))


# Lines of a file of a test stream; a batch of more lines comes in several files, which tasks share.
FILE_LINES = 50_000


def files_per_batch(lines: int, batches: int) -> int:
    """Files that ``lines`` dealt to ``batches`` are written to, for each batch."""
    return max(1, lines // (batches * FILE_LINES))


def folders(spark, name: str) -> tuple[str, str]:
    return new_folder(spark, name), new_folder(spark, f"{name}-state")


def drained(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    out, state = folders(stream.sparkSession, name)
    return J.latest_windows(J.write_batches(stream, out, state, "update"), keys)


def bucket(seconds: int) -> str:
    return f"time_bucket(INTERVAL {seconds} SECONDS, timestamp, TIMESTAMP '1970-01-01')"


@query("w01_ingest_stream", sql(PARSED, "SELECT id, timestamp, level, service, message, 'websocket' AS source FROM parsed"))
def ingest_stream(spark, sf_dir):
    lines = logs_stream(spark, sf_dir).select("id", F.col("raw_line").alias("line"))
    rows = J.ingest_stream(lines, *folders(spark, "ingest"), ingest_time())
    return rows.select("id", "timestamp", "level", "service", "message", "source")


_levels = ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS {x.lower()}" for x in K.LEVELS)
_rate = f"round(avg(CASE WHEN {ERRORS} THEN 1.0 ELSE 0.0 END), 4) AS error_rate"


_LEVEL_COUNTS = sql(LOGS, f"""
SELECT {bucket(300)} AS window_start, count(*) AS total, {_levels}, {_rate} FROM logs GROUP BY 1
""")


@query("w02_level_counts", _LEVEL_COUNTS)
def level_counts(spark, sf_dir):
    return drained(J.level_counts_stream(logs_stream(spark, sf_dir)), "levels", ["window_start"])


@query("w02_level_counts_shuffled", _LEVEL_COUNTS)
def level_counts_shuffled(spark, sf_dir):
    return drained(J.level_counts_stream(shuffled_logs_stream(spark, sf_dir)), "levels", ["window_start"])


@query("w02_level_counts_sliding", sql(LOGS, f"""
SELECT {bucket(60)} - s * INTERVAL 60 SECONDS AS window_start, count(*) AS total, {_levels}, {_rate}
FROM logs, range(0, 5) r(s) GROUP BY 1
"""))
def level_counts_sliding(spark, sf_dir):
    return drained(J.level_counts_stream(logs_stream(spark, sf_dir), 300, 60), "sliding", ["window_start"])


_EVENTS_PER_SECOND = sql(LOGS, f"SELECT {bucket(60)} AS window_start, count(*) / 60.0::DOUBLE AS events_per_second FROM logs GROUP BY 1")


@query("w03_events_per_second", _EVENTS_PER_SECOND)
def events_per_second(spark, sf_dir):
    return drained(J.events_per_second_stream(logs_stream(spark, sf_dir)), "eps", ["window_start"])


@query("w03_events_per_second_shuffled", _EVENTS_PER_SECOND)
def events_per_second_shuffled(spark, sf_dir):
    return drained(J.events_per_second_stream(shuffled_logs_stream(spark, sf_dir)), "eps", ["window_start"])


@query("w04_stream_anomalies", sql(FLAGS, "SELECT id, is_anomaly, anomaly_score FROM flagged"))
def stream_anomalies(spark, sf_dir):
    rows = J.flag_stream(logs_stream(spark, sf_dir), *folders(spark, "flags"), seconds=3600)
    return rows.select("id", "is_anomaly", "anomaly_score")


@query("w04_stream_anomalies_shuffled", sql(FLAGS, "SELECT id, is_anomaly, anomaly_score FROM flagged"))
def stream_anomalies_shuffled(spark, sf_dir):
    rows = J.flag_stream(shuffled_logs_stream(spark, sf_dir), *folders(spark, "flags"), seconds=3600)
    return rows.select("id", "is_anomaly", "anomaly_score")


_ALERTS = sql(LOGS, """
SELECT alert_type, w AS fired_at, actual::DOUBLE AS actual_value, 'firing' AS status FROM (
  SELECT date_trunc('day', timestamp) AS w, 'redis_failure_threshold' AS alert_type, count(*) FILTER (WHERE service = 'redis' AND level IN ('ERROR', 'CRITICAL')) AS actual, 5 AS t FROM logs GROUP BY 1
  UNION ALL SELECT date_trunc('day', timestamp), 'reconnect_storm', count(*) FILTER (WHERE regexp_matches(message, 'reconnect|disconnect')), 10 FROM logs GROUP BY 1
  UNION ALL SELECT date_trunc('day', timestamp), 'queue_saturation', max(event_id % 1500), 1000 FROM logs GROUP BY 1) WHERE actual >= t
""")


def _alerts(logs: DataFrame) -> DataFrame:
    measures = J.alert_measures_stream(logs.withColumn("depth", F.col("event_id") % 1500), 86400)
    fired = J.alert_stream(measures, alert_rules(logs.sparkSession), *folders(logs.sparkSession, "alerts"))
    return fired.select("alert_type", "fired_at", "actual_value", "status")


@query("w05_stream_alerts", _ALERTS)
def stream_alerts(spark, sf_dir):
    return _alerts(logs_stream(spark, sf_dir))


@query("w05_stream_alerts_shuffled", _ALERTS)
def stream_alerts_shuffled(spark, sf_dir):
    return _alerts(shuffled_logs_stream(spark, sf_dir))


@query("w06_drop_replays", sql(LOGS, "SELECT id, level FROM logs"))
def drop_replays(spark, sf_dir):
    """The same file read by two streams, as a source that replays everything once."""
    twice = logs_stream(spark, sf_dir).select("id", "timestamp", "level").union(
        logs_stream(spark, sf_dir).select("id", "timestamp", "level"))
    return J.write_batches(J.drop_replays(twice), *folders(spark, "replays")).select("id", "level")


@query("w06_drop_replays_shuffled", sql(LOGS, "SELECT id, level FROM logs"))
def drop_replays_shuffled(spark, sf_dir):
    """Two streams of the same rows, each in another order."""
    twice = shuffled_logs_stream(spark, sf_dir).select("id", "timestamp", "level").union(
        shuffled_logs_stream(spark, sf_dir, 5).select("id", "timestamp", "level"))
    return J.write_batches(J.drop_replays(twice), *folders(spark, "replays")).select("id", "level")


_TIMELINE = sql(LOGS, f"SELECT {bucket(30)} AS bucket, count(*) AS events, count(*) FILTER (WHERE {ERRORS}) AS errors FROM logs GROUP BY 1")


@query("w07_timeline", _TIMELINE)
def timeline(spark, sf_dir):
    return drained(J.timeline_stream(logs_stream(spark, sf_dir)), "timeline", ["bucket"])


@query("w07_timeline_shuffled", _TIMELINE)
def timeline_shuffled(spark, sf_dir):
    return drained(J.timeline_stream(shuffled_logs_stream(spark, sf_dir)), "timeline", ["bucket"])


@query("w06_expiring_replays", sql(LOGS, "SELECT id, level FROM logs"))
def expiring_replays(spark, sf_dir):
    """Every row twice, in dates order dealt to files and again in another order; only ten dates are remembered."""
    twice = shuffled_logs_stream(spark, sf_dir).select("id", "timestamp", "level").union(
        shuffled_logs_stream(spark, sf_dir, 5).select("id", "timestamp", "level"))
    kept, aside = drop_replays_within(twice, *folders(spark, "expiring"), days=10)
    return kept.unionByName(aside).select("id", "level")


@query("r09_stream_backlog", sql(LOGS, """
SELECT b.batch_id, b.total_lines, b.depth, b.depth >= 1000 AS firing FROM (
  SELECT i AS batch_id, count(*) FILTER (event_id % 4 = i) AS total_lines, count(*) FILTER (event_id % 4 > i) AS depth
  FROM logs, (SELECT unnest([0, 1, 2, 3])::BIGINT AS i) GROUP BY i) b
"""))
def stream_backlog(spark, sf_dir):
    """Lines in files of one remainder each, a remainder a batch; the depth after each batch feeds the saturation rule."""
    lines = T.logs(spark, sf_dir).select("event_id", F.col("raw_line").alias("line"))
    folder, (out, state) = new_folder(spark, "backlog"), folders(spark, "backlog-out")
    dealt = {r["part"]: r["n"] for r in lines.groupBy((F.col("event_id") % 4).alias("part")).agg(F.count("*").alias("n")).collect()}
    # every batch must have as many files: no more than the smallest one fills
    files = files_per_batch(min(dealt.get(i, 0) for i in range(4)), 1)
    for i in range(4):
        lines.filter(f"event_id % 4 = {i}").repartition(files).write.mode("append").parquet(folder)
    stream = J.file_stream(spark, folder, lines.schema, maxFilesPerTrigger=files)
    rows = new_folder(spark, "backlog-rows")

    def write(batch, batch_id):
        parse_lines(batch, ingest_time()).write.mode("overwrite").parquet(J.batch_folder(rows, batch_id))

    depths = backlog(run_counted(stream, write, out, state), sum(dealt.values()))
    fired = threshold_alerts(queue_measures(depths, ["batch_id"]).withColumn("at", F.timestamp_seconds("batch_id")), alert_rules(spark), "at", ["batch_id"])
    return depths.join(fired.select("batch_id", F.lit(True).alias("firing")), "batch_id", "left").select(
        "batch_id", "total_lines", "depth", F.coalesce("firing", F.lit(False)).alias("firing"))


@query("s11_observed_audit", sql(LOGS, """
SELECT 'run' AS id, 'file_upload' AS source, (count(*) + count(*) FILTER (event_id % 89 = 0))::BIGINT AS total_lines,
  count(*) AS processed_lines, count(*) FILTER (event_id % 89 = 0) AS error_lines, 'completed' AS status FROM logs
"""))
def observed_audit(spark, sf_dir):
    """The audit row of a file job, counted by the job itself."""
    logs = T.logs(spark, sf_dir)
    folder, out = new_folder(spark, "audited"), new_folder(spark, "audited-rows")
    logs.select("raw_line").unionByName(logs.filter("event_id % 89 = 0").select(F.lit("  ").alias("raw_line"))).write.text(folder)
    audit = write_with_audit(
        read_lines(spark, folder), lambda lines: parse_lines(lines, ingest_time()).write.parquet(out), "run", "file_upload",
        ingest_time(), ingest_time())
    return audit.drop("started_at", "completed_at")


# ---------------------------------------------------------------- the whole ingest job

# Words that make the message of some lines their own, so that texts grow with the input and many stay alone.
_OWN = ", ".join(f"' q{x}', CAST(event_id - event_id % 50 AS {{str}})" for x in "abcdefgh")
_OWN = f"CASE WHEN event_id % 25 = 0 THEN concat(' ref', {_OWN}) ELSE '' END"
_OWN_SQL = _OWN.replace("{str}", "VARCHAR")
_LIVE_LOGS = PARSED.strip().replace("logs AS (", "plain AS (", 1).replace("FROM logs)", "FROM lines)").replace(
    "parsed AS (", f"lines AS (SELECT * REPLACE (concat(message, {_OWN_SQL}) AS message, concat(raw_line, {_OWN_SQL}) AS raw_line) FROM plain),\nparsed AS (", 1)
_LIVE_LOGS += ",\nlogs AS (SELECT * FROM parsed)"
_LIVE_FLAGS, _LIVE_CLUSTERS = (x.replace(LOGS, _LIVE_LOGS) for x in (FLAGS, CLUSTERS))


class _Lost(RuntimeError):
    pass


_live: dict[tuple, LiveTables] = {}


def live_tables(spark, sf_dir) -> LiveTables:
    """The tables of one run of the job, which the queries below read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _live:
        _live[key] = drained_ingest(spark, sf_dir)
    return _live[key]


def drained_ingest(spark, sf_dir, parts: int = 5) -> LiveTables:
    """Lines in shuffled files, dealt to batches; the third batch is lost before its ledger row and replayed."""
    events = T.logs(spark, sf_dir).withColumn("line", F.expr(f"concat(raw_line, {_OWN.replace('{str}', 'STRING')})"))
    blank = events.filter("event_id % 97 = 0").select(F.concat(F.lit("blank"), "id").alias("id"), F.lit(" ").alias("line"))
    lines = events.select("id", "line").unionByName(blank)
    folder, state = folders(spark, "live-lines")
    files = files_per_batch(events.count(), parts)
    lines.repartition(parts * files, F.xxhash64("id")).write.parquet(folder)
    tables = LiveTables(spark, new_folder(spark, "live"), seconds=3600, alert_seconds=86400)
    stream = J.file_stream(spark, folder, lines.schema, maxFilesPerTrigger=files)
    write, lost = tables._write, []

    def failing(name, part, batch_id):
        if name == "ledger" and batch_id == 2 and not lost:
            lost.append(batch_id)
            raise _Lost("before the ledger row")
        return write(name, part, batch_id)

    tables._write = failing
    try:
        run_ingest(stream, tables, state, ingest_time())
    except Exception:  # noqa: BLE001 - the stream wraps the error of its batch
        if not lost:
            raise
    return run_ingest(stream, tables, state, ingest_time())


@query("w01_live_logs", sql(_LIVE_FLAGS, "SELECT id, timestamp, level, service, message, is_anomaly, anomaly_score FROM flagged"))
def live_logs(spark, sf_dir):
    return live_tables(spark, sf_dir).logs().select("id", "timestamp", "level", "service", "message", "is_anomaly", "anomaly_score")


@query("w01_live_members", sql(_LIVE_CLUSTERS, "SELECT id, cluster_id FROM members"))
def live_members(spark, sf_dir):
    return live_tables(spark, sf_dir).logs().select("id", "cluster_id")


@query("w01_live_clusters", sql(_LIVE_CLUSTERS, """
SELECT id, name, description, log_count, severity, representative_messages, tags, first_seen, last_seen FROM clusters"""))
def live_clusters(spark, sf_dir):
    return live_tables(spark, sf_dir).clusters()


@query("w01_live_incidents", sql(_LIVE_CLUSTERS, """
SELECT id, title, description, severity, status, cluster_id, log_count, detected_at, affected_services FROM cases"""))
def live_incidents(spark, sf_dir):
    return live_tables(spark, sf_dir).incidents().drop("resolved_at")


@query("w01_live_alerts", sql(_LIVE_FLAGS, f"""
SELECT alert_type, w AS fired_at, actual::DOUBLE AS actual_value, 'firing' AS status FROM (
  SELECT date_trunc('day', timestamp) AS w, 'redis_failure_threshold' AS alert_type,
    count(*) FILTER (WHERE contains(service, 'redis') AND {ERRORS}) AS actual, 5 AS t FROM logs GROUP BY 1
  UNION ALL SELECT date_trunc('day', timestamp), 'reconnect_storm', count(*) FILTER (WHERE {hits('message', K.RECONNECT_WORDS)}), 10 FROM logs GROUP BY 1)
WHERE actual >= t"""))
def live_alerts(spark, sf_dir):
    return live_tables(spark, sf_dir).alerts().select("alert_type", "fired_at", "actual_value", "status")


@query("w01_live_audit", sql(LOGS, """
SELECT 5::BIGINT AS batches, (count(*) + count(*) FILTER (event_id % 97 = 0))::BIGINT AS total_lines, count(*) AS processed_lines,
  count(*) FILTER (event_id % 97 = 0) AS error_lines FROM logs"""))
def live_audit(spark, sf_dir):
    return live_tables(spark, sf_dir).ledger().agg(
        F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("total_lines", "processed_lines", "error_lines")])
