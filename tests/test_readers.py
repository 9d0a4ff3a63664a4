from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharbor.sources import readers as R
from logharbor.sources import sinks as W
from logharbor.session import new_folder, shared_dir


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


TEXT = """2023-11-02 07:15:31 ERROR redis: key space is read-only
2023-11-02 07:15:44 WARNING gateway: certificate expires tomorrow

2023-11-02 07:16:02 INFO api: cart saved
"""


def test_text_file(spark, tmp_path, now):
    path = write(tmp_path / "a.log", TEXT)
    rows = R.read_text_logs(spark, path, "s1", now).orderBy("timestamp").collect()
    assert [(r.level, r.service) for r in rows] == [("ERROR", "redis"), ("WARNING", "gateway"), ("INFO", "api")]
    assert {r.session_id for r in rows} == {"s1"}
    counts = R.line_counts(R.read_lines(spark, path), ["file"]).first()
    assert (counts.total_lines, counts.processed_lines, counts.error_lines) == (4, 3, 1)
    assert R.line_counts(R.read_lines(spark, path), ["file"], json=True).first().error_lines == 0


def test_ids_are_stable_and_distinct(spark, tmp_path, now):
    path = write(tmp_path / "a.log", "same\nsame\nother\nsame\n")
    first = sorted(r.id for r in R.read_text_logs(spark, path, "s", now).collect())
    again = sorted(r.id for r in R.read_text_logs(spark, path, "s", now).collect())
    assert first == again and len(set(first)) == 4


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "COPIES_PER_TASK", 10)
    rows = spark.range(37).select(F.lit("hot").alias("line")).union(spark.createDataFrame([("cold",)], "line string"))
    out = R.number_copies(rows)
    assert sorted((r.line, r["copy"]) for r in out.collect()) == [("cold", 0)] + [("hot", i) for i in range(37)]


def test_bad_bytes(spark, tmp_path, now):
    path = write(tmp_path / "b.log", b"ERROR caf\xff here\n")
    assert R.read_text_logs(spark, path, "s", now).first().message == "caf� here"


def test_csv(spark, tmp_path, now):
    path = write(tmp_path / "c.csv", "timestamp,level,service,message,host\n"
                 '2024-01-15T12:00:00,ERROR,redis,"two\nlines, ""quoted""",h1\n'
                 "2024-01-15T12:00:01+01:00,INFO,,started,\n"
                 "2024-01-15T12:00:02,WARN,api,,h3\n"
                 "2024-01-15T12:00:03\n"
                 "bad time,,db,late,h4\n")
    rows = R.read_csv_logs(spark, path, "s", now).orderBy("message").collect()
    assert [(r.level, r.service, r.message, r.extra_fields) for r in rows] == [
        ("INFO", "db", "late", {"host": "h4"}),
        ("INFO", None, "started", None),
        ("ERROR", "redis", 'two\nlines, "quoted"', {"host": "h1"}),
    ]
    assert rows[0].timestamp.isoformat().startswith("2024-03-01T12:00:00")
    assert rows[1].timestamp.isoformat().startswith("2024-01-15T11:00:01")
    assert all(r.raw_line is None for r in rows)


def test_csv_without_level_column(spark, now):
    records = spark.createDataFrame([("f", "2024-01-01 00:00:00", "[auth] no")], "file string, date string, log_text string")
    row = R.parse_records(records, now).first()
    assert (row.level, row.service, row.message) == ("INFO", "auth", "[auth] no")


def test_roles():
    assert R.csv_roles(["Event_Time", "Sev", "App", "Body"]) == {
        "message": "Event_Time", "timestamp": "Event_Time", "level": None, "service": "App"}
    assert R.find_role(["text", "msg"], ["message", "msg", "text"]) == "msg"  # candidate order first


@pytest.mark.parametrize("content, expected", [
    ('{"sev":"warn","n":4}\n{"sev":"note","n":5}', "json"),
    ("\n\n  {\"a\": 1}\nx", "json"),
    ("{broken\n{\"a\":1}", "text"),
    ("when,grade,unit,words\n2023-06-09,low,pump,stuck", "csv"),
    ('a,b,c\n1,"x,\ny",3', "csv"),
    ("a,b,c\n1,2\n", "text"),
    ("a,b\n1,2\n", "text"),
    ("9 June, pump stuck; no commas matter here", "text"),
    (" \n", "text"),
])
def test_format_detection(spark, tmp_path, content, expected):
    path = write(tmp_path / "f.log", content)
    assert R.detect_formats(spark, path).first()["format"] == expected


def test_mixed_folder(spark, tmp_path, now):
    write(tmp_path / "a.log", TEXT)
    write(tmp_path / "b.log", '{"level":"ERROR","msg":"x"}\n12\n[1]\n\n')
    write(tmp_path / "c.log", "timestamp,level,service,message\n2023-11-02T07:20:10,ERROR,db,replica fell behind\n")
    write(tmp_path / "d.log", "time,severity,app,text,more\n2024-01-15T12:00:01,WARN,api,slow,1\n")
    rows = R.read_logs(spark, str(tmp_path), "s", now).collect()
    assert len(rows) == 3 + 3 + 1 + 1
    assert len({r.id for r in rows}) == len(rows)


def test_empty_file(spark, tmp_path, now):
    path = write(tmp_path / "e.log", "")
    assert R.read_text_logs(spark, path, "s", now).count() == 0
    assert R.detect_formats(spark, path).count() == 0  # nothing to route
    assert R.read_logs(spark, path, "s", now).count() == 0


def test_caps(spark, tmp_path):
    path = write(tmp_path / "n.log", "\n".join(f"entry no {i}" for i in range(730)))
    lines = R.read_lines(spark, path).withColumn("line_no", F.regexp_extract("line", r"\d+", 0).cast("int"))
    kept = R.cap_lines(lines, "file", "line_no", 100)
    assert kept.count() == 100 and kept.agg(F.max("line_no")).first()[0] == 99
    assert R.read_lines(spark, path, max_file_bytes=10).count() == 0


def test_line_batch(spark, now):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["ERROR a", "", '{"msg":"b"}', "c"])], "line_no int, line string")
    rows = R.ingest_batch(lines, "s9", now, limit=3).collect()
    assert sorted(r.message for r in rows) == ["a", "b"]
    assert {(r.source, r.session_id) for r in rows} == {("api", "s9")}


def test_append_twice(spark, now):
    folder = new_folder(spark, "append")
    lines = spark.createDataFrame([(1, "2024-01-01 00:00:00 ERROR a", "f")], "line_no int, line string, file string")
    rows = R.parse_lines(R.with_line_ids(lines), now)
    W.append_logs(rows, folder)
    W.append_logs(rows, folder)
    back = spark.read.parquet(folder)
    assert back.count() == 2 and back.select("id").distinct().count() == 1


def test_messages_keep_nulls(spark):
    row = spark.sql("SELECT 'i' AS id, TIMESTAMP '2024-01-01 00:00:00' AS timestamp, 'INFO' AS level, "
                    "CAST(NULL AS STRING) AS service, 'm' AS message, false AS is_anomaly")
    assert '"service":null' in W.log_messages(row).first()["value"]


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
