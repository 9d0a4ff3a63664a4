"""Detection rules, metrics, table jobs and root-cause records on hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logharbor.operators import detection as D
from logharbor.operators import lookups as L
from logharbor.operators import maintenance as M
from logharbor.operators import metrics as A
from logharbor.operators import relations as J
from logharbor.operators import rootcause as R
from logharbor.operators.incidents import detect_incidents
from logharbor.sources import sinks as W

T0 = datetime(2024, 1, 1)
LOG = "id string, timestamp timestamp, level string, service string, message string"


def logs_of(spark, rows):
    """(seconds, level, service, message) rows."""
    data = [(f"l{i:03d}", T0 + timedelta(seconds=s), *rest) for i, (s, *rest) in enumerate(rows)]
    return spark.createDataFrame(data, LOG)


def test_anomaly_scores(spark):
    calm = [(i, "INFO", "api", "ok") for i in range(20)] + [(30, "ERROR", "api", "bad"), (40, "INFO", "db", "disk full now")]
    spike = [(301, "ERROR", "api", "bad"), (302, "WARNING", "api", "hm"), (303, "INFO", "api", "ok")]
    got = {r.id: (r.is_anomaly, r.anomaly_score) for r in D.flag_anomalies(logs_of(spark, calm + spike)).collect()}
    assert got["l020"] == (False, None)  # one error in 22 rows is no spike
    assert got["l021"] == (True, 0.95)
    assert [got[f"l{i:03d}"] for i in (22, 23, 24)] == [(True, 0.75), (True, 0.45), (False, None)]


def test_spike_needs_more_than_the_limit(spark):
    rows = [(i, "ERROR" if i < 3 else "INFO", "api", "x") for i in range(10)]  # exactly 0.3
    assert D.with_spikes(D.window_rates(logs_of(spark, rows))).first().is_spike is False


def test_baseline(spark):
    rates = [(0, 0.1), (1, 0.1), (2, 0.35), (3, 0.2), (10, 0.9)]
    df = spark.createDataFrame([(T0 + timedelta(minutes=5 * i), r) for i, r in rates], "window_start timestamp, error_rate double")
    got = {(r.window_start - T0).seconds // 300: r.is_spike for r in D.baseline_spikes(df, 300, 3).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 10: False}  # no window within reach of 10


def test_names(spark):
    texts = {"a": "redis timeout", "b": "shard heartbeat", "c": "unusual thing unusual", "d": "tiny", "e": "rows written", "f": "beta-zeta alphas"}
    df = spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "cluster_id string, rank int, message string")
    assert {r.cluster_id: r.name for r in D.cluster_names(df).collect()} == {
        "a": "Redis/Cache Issues", "b": "Shard Health", "c": "Unusual Events", "d": "Unknown Cluster",
        "e": "Gateway Connectivity",  # 'ws' inside a word counts
        "f": "Alphas Events",  # tie: first word in the alphabet
    }


def test_alerts(spark):
    rows = [(i, "ERROR", "redis-main", "gone") for i in range(5)] + [(i, "INFO", "gw", "Reconnect ok") for i in range(9)]
    logs = logs_of(spark, rows).withColumn("w", A.window_start("timestamp", 300))
    measures = D.rule_measures(logs, ["w"])
    fired = D.threshold_alerts(measures, D.alert_rules(spark), "w").collect()
    assert [(r.alert_type, r.message, r.threshold_value, r.actual_value, r.status) for r in fired] == [
        ("redis_failure_threshold", "Detected 5 Redis failures in current batch", 5.0, 5.0, "firing")]
    queue = spark.createDataFrame([(T0, 999), (T0, 1200)], "w timestamp, depth long")
    saturated = D.threshold_alerts(D.queue_measures(queue, ["w"]), D.alert_rules(spark), "w").first()
    assert saturated.message == "Queue size 1200 exceeds threshold 1000" and saturated.severity == "medium"


def test_windows_and_rates(spark):
    logs = logs_of(spark, [(0, "ERROR", "a", "x"), (299, "INFO", "a", "x"), (300, "INFO", "a", "x"), (600, "CRITICAL", "a", "x")])
    assert {r.level: r.n for r in A.level_counts(logs).collect()} == {"INFO": 1, "CRITICAL": 1}  # as of the newest row
    at = F.lit(T0 + timedelta(seconds=300))
    assert {r.level: r.n for r in A.level_counts(logs, 300, at).collect()} == {"ERROR": 1, "INFO": 2, "CRITICAL": 1}
    assert logs.filter("false").agg(A.error_rate().alias("r")).first().r == 0.0
    assert sum(r.n for r in A.tumbling_levels(logs, 300).collect()) == 4


def test_histogram_edges(spark):
    df = spark.createDataFrame([("embedding", 0.1), ("embedding", 0.11), ("embedding", 99.0)], "stage string, seconds double")
    got = {r.le: r.bucket_count for r in A.latency_histogram(df).collect()}
    assert got == {"0.10": 1, "0.50": 2, "1.00": 2, "2.00": 2, "5.00": 2, "10.00": 2, "+Inf": 3}


def test_running_totals(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=9 * i), i) for i in range(8)], "t timestamp, n int")
    got = [r.running_total for r in A.running_totals(df, "t", "n").orderBy("t").collect()]
    assert got == [0, 1, 3, 6, 10, 15, 21, 28]


def test_percentiles_exact_and_sketch(spark):
    df = spark.range(1, 1001).select(F.lit(T0).alias("ts"), F.col("id").cast("double").alias("ms"))
    exact = A.latency_percentiles(df, 60).first()
    assert (exact.p50_ms, round(exact.p95_ms, 2), round(exact.p99_ms, 2)) == (500.5, 950.05, 990.01)
    assert abs(A.latency_percentiles(df, 60, exact=False).first().p95_ms - 950) <= 1


def test_incidents(spark):
    logs = logs_of(spark, [(0, "ERROR", "db", "x"), (1, "ERROR", "api", "x"), (2, "ERROR", None, "y"), (3, "INFO", "q", "z")]).withColumn(
        "cluster_id", F.expr("CASE message WHEN 'x' THEN 'c1' WHEN 'y' THEN 'c2' ELSE 'c3' END"))
    clusters = spark.createDataFrame(
        [("c1", "N", "d", "high", 2, T0), ("c2", "M", "d", "critical", 1, T0), ("c3", "L", "d", "medium", 1, T0)],
        "id string, name string, description string, severity string, log_count int, first_seen timestamp")
    got = {r.cluster_id: r for r in detect_incidents(clusters, logs).collect()}
    assert got["c1"].title == "N — HIGH Incident" and got["c1"].affected_services == ["api", "db"]
    assert got["c2"].affected_services is None and "c3" not in got
    kinds = [r.value.split('"')[3] for r in W.live_messages(logs.withColumn("is_anomaly", F.lit(False)), detect_incidents(clusters, logs), 2).collect()]
    assert sorted(kinds) == ["incident", "incident", "log_entry", "log_entry"]


def test_changes(spark):
    table = spark.createDataFrame([("a", "open", "low", "x", None), ("b", "open", "low", "x", None)],
                                  "id string, status string, severity string, description string, resolved_at timestamp")
    changes = spark.createDataFrame(
        [("a", 1, T0, "resolved", None, None), ("a", 2, T0 + timedelta(1), None, "high", None), ("b", 1, T0, "resolved", None, "y")],
        "id string, version int, changed_at timestamp, status string, severity string, description string")
    got = {r.id: r for r in M.apply_incident_changes(table, changes).collect()}
    assert (got["a"].status, got["a"].severity, got["a"].resolved_at) == ("resolved", "high", T0)  # each field's last
    assert (got["b"].status, got["b"].resolved_at, got["b"].description) == ("resolved", T0, "y")


def test_rows_by_key(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int")
    assert {tuple(r) for r in M.replace_rows(t, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in M.delete_rows(t, new).collect()} == {("a", 1)}
    gone = spark.createDataFrame([("b",)], "id string")
    child = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None)], "id string, parent string")
    assert {tuple(r) for r in J.set_null_on_delete(child, gone, "parent").select("id", "parent").collect()} == {("x", "a"), ("y", None), ("z", None)}
    assert {r.id for r in J.cascade_on_delete(child, gone, "parent").collect()} == {"x", "z"}


def test_pages_and_search(spark):
    logs = logs_of(spark, [(i, "INFO", None if i % 2 else "Queue-1", f"m{i}") for i in range(6)])
    assert [r.id for r in L.page(logs, ["id"], 2, 2).collect()] == ["l002", "l003"]
    assert L.text_search(logs, "queue").count() == 3 and L.text_search(logs, "M5").count() == 1
    assert [r.id for r in L.latest_feed(logs, 2).collect()] == ["l005", "l004"]


def test_first_rows_are_limited_before_the_shuffle(spark):
    plan = L.first_per_group(logs_of(spark, [(0, "INFO", "a", "x")]), "service", ["timestamp", "id"], 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_replies(spark):
    good = '{"root_causes": [{"cause": "c"}, {"cause": "d", "confidence": 1, "category": "code"}], "ai_confidence": 0.7}'
    rows = [("a", good), ("b", f"```json\n{good}\n```"), ("c", "json is not this"), ("d", '{"root_causes": [{"confidence": 0.2}]}'),
            ("e", '{"root_causes": [{"cause": "c", "confidence": 1.2}]}'), ("f", "{}"), ("g", "[1]"), ("h", good[:-5])]
    ok, bad = R.parse_replies(spark.createDataFrame(rows, "incident_id string, reply string"))
    got = {r.incident_id: r for r in ok.collect()}
    assert set(got) == {"a", "b", "f"} and {r.incident_id for r in bad.collect()} == {"c", "d", "e", "g", "h"}
    assert [(c.cause, c.confidence, c.category) for c in got["b"].root_causes] == [("c", 0.5, None), ("d", 1.0, "code")]
    assert (got["f"].root_causes, got["f"].ai_confidence, got["f"].recommended_fixes, got["f"].ai_summary) == ([], 0.5, [], "")


def test_timelines(spark, now):
    rows = [("a", '```{"timeline": [{"timestamp": "2024-01-01T01:00:00+01:00", "event": "x"}, {"event": "y"}]}```'), ("b", "no")]
    events, bad = R.parse_timelines(spark.createDataFrame(rows, "incident_id string, reply string"), now)
    got = events.orderBy("position").collect()
    assert [(r.timestamp.isoformat()[:19], r.event) for r in got] == [("2024-01-01T00:00:00", "x"), ("2024-03-01T12:00:00", "y")]
    assert [r.incident_id for r in bad.collect()] == ["b"]


def test_context_without_store(spark):
    queries = spark.createDataFrame([("i1", "some text")], "id string, text string")
    store = spark.createDataFrame([], "id string, title string, text string")
    assert R.retrieval_context(queries, store).first().similar == "No similar past incidents found."


def test_percentiles_of_large_windows_are_selected(spark, monkeypatch):
    """Ties, negative, tiny, huge and infinite values; no window may be gathered."""
    import random

    import numpy as np

    from logharbor.operators import metrics as M

    rnd = random.Random(3)
    values = [0.0, -1.5, 1e-300, 1e300, -1e300, float("inf"), 7.0, 7.0] + [rnd.expovariate(0.01) for _ in range(600)]
    rows = [(T0 + timedelta(seconds=rnd.randrange(3 * 60)), rnd.choice(values)) for _ in range(2500)] + [(T0 + timedelta(hours=1), 4.25)]
    samples = spark.createDataFrame(rows, "ts timestamp, ms double")
    plain = {tuple(r)[0]: tuple(r)[1:] for r in M.latency_percentiles(samples, 60).collect()}
    monkeypatch.setattr(M, "GATHERED_VALUES", 0)
    monkeypatch.setattr(M, "VALUE_BINS", 4)
    got = {tuple(r)[0]: tuple(r)[1:] for r in M.latency_percentiles(samples, 60).collect()}
    assert got.keys() == plain.keys()
    for k, v in got.items():
        assert np.allclose(v, plain[k])
