from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logharbor.functions import parsing as P
from logharbor.functions import text as X
from logharbor.sources.readers import parse_lines


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def test_levels(spark):
    cases = {
        "disk scan ended, 3 ERROR blocks": "ERROR",
        "[WARN] queue at 91 percent": "WARNING",
        "warning: x": "WARNING",
        "pump 4 CRITICAL pressure": "CRITICAL",
        "a fatal flaw": "CRITICAL",
        "trace of it": "DEBUG",
        "information only": "INFO",  # no whole-word level, no hint
        "peer refused the handshake": "INFO",  # 'refused' is not a hint
        "write took too long, timeout after 30s": "WARNING",
        "listening for peers": "INFO",
        "request failed after retry": "ERROR",
        "process was OOM-ed": "CRITICAL",
        "info then error": "INFO",
        "": "INFO",
    }
    assert values(spark, list(cases), P.parse_level) == list(cases.values())


def test_refused_is_opt_in(spark):
    level = lambda c: P.parse_level(c, ["refused"])
    assert values(spark, ["peer refused the handshake"], level) == ["ERROR"]


def test_timestamps(spark, now):
    cases = {
        "2024-01-15T14:32:01.123Z up": datetime(2024, 1, 15, 14, 32, 1),
        "2024-01-15T14:32:01+02:00 up": datetime(2024, 1, 15, 12, 32, 1),
        "2024-01-15 14:32:01 up": datetime(2024, 1, 15, 14, 32, 1),
        "2024-01-15 14:32:01.5-01:00 up": datetime(2024, 1, 15, 15, 32, 1),
        "10/Oct/2023:13:55:36 x": datetime(2023, 10, 10, 13, 55, 36),  # all 20 characters
        "[10/Oct/2023:13:55:36 -0700] x": datetime(2023, 10, 10, 20, 55, 36),
        "Feb 29 01:02:03 host x": datetime(2024, 2, 29, 1, 2, 3),  # year of the ingest time
        "Jan  5 01:02:03 host x": datetime(2024, 1, 5, 1, 2, 3),
        "2024-13-45T99:00:00 then 2024-01-02 03:04:05": datetime(2024, 1, 2, 3, 4, 5),
        "no timestamp here at all": None,
    }
    got = values(spark, list(cases), lambda c: P.parse_timestamp(c, now).cast("timestamp_ntz"))
    assert got == list(cases.values())


def test_services(spark):
    cases = {
        "2024-01-01 00:00:00 ERROR redis: down": "redis",
        "[2024-01-01T00:00:00] [ERROR] [auth-svc] denied": "auth-svc",
        "[ERROR] [Redis] x": "redis",
        "nothing known": None,
        "the Gateway said [api]": "gateway",
        "[123] db": "db",  # a bracket token starts with a letter
    }
    assert values(spark, list(cases), P.parse_service) == list(cases.values())


def test_messages(spark):
    cases = {
        "2024-01-01 00:00:00 ERROR Connection lost": "Connection lost",
        "[2024-01-01T00:00:00] [ERROR] [redis] gone": "[redis] gone",
        "(WARN) disk at 90%": "disk at 90%",
        "2024-01-01T00:00:00Z ERROR": "2024-01-01T00:00:00Z ERROR",
        "error after error": "after error",
    }
    assert values(spark, list(cases), P.clean_message) == list(cases.values())


def parsed(spark, lines, now, **options):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return parse_lines(rows, now, **options).orderBy("i").collect()


def test_json_line(spark, now):
    line = ('{"ts":"2024-01-15T14:00:00+01:00","severity":"warn","app":"cache","msg":"","text":"hit",'
            '"k":{"a":[1]},"n":null}')
    row = parsed(spark, [line], now)[0]
    assert (row.level, row.service, row.message) == ("WARNING", "cache", "hit")
    assert row.timestamp.isoformat().startswith("2024-01-15T13:00:00")
    # consumed keys go, aliases that were read but are not in the list stay
    assert row.extra_fields == {"ts": "2024-01-15T14:00:00+01:00", "app": "cache", "k": '{"a":[1]}', "n": None}


@pytest.mark.parametrize("line", ["12", "[1, 2]", '{"a": 1', '{"level": "ERROR"} trailing', "{'a': 1}"])
def test_bad_json_falls_back_to_text(spark, now, line):
    row = parsed(spark, [line], now)[0]
    assert row.raw_line == line
    assert row.extra_fields is None


def test_json_without_message_keeps_the_line(spark, now):
    row = parsed(spark, ['{"level":"ERROR","code":7}'], now)[0]
    assert (row.level, row.message) == ("ERROR", '{"level":"ERROR","code":7}')


def test_json_defaults(spark, now):
    row = parsed(spark, ['{"message":"redis gone","time":"whenever"}'], now)[0]
    assert (row.level, row.service) == ("INFO", "redis")
    assert row.timestamp.isoformat().startswith("2024-03-01T12:00:00")


def test_stream_lines(spark, now):
    rows = parsed(spark, ['{"message":"eviction storm","service":"cache","level":"error"}',
                          "2023-11-02T07:21:45 CRITICAL redis: fork failed", "", "   "], now, source="websocket")
    assert [(r.level, r.service, r.source) for r in rows] == [
        ("ERROR", "cache", "websocket"), ("CRITICAL", "redis", "websocket")]


def test_text_mode_ignores_json(spark, now):
    row = parsed(spark, ['{"msg":"x","severity":"error"}'], now, json=False)[0]
    assert (row.level, row.extra_fields) == ("ERROR", None)
    assert row.message.startswith('{"msg"')


def test_truncation(spark, now):
    row = parsed(spark, ["x" * 7000], now)[0]
    assert (len(row.message), len(row.raw_line)) == (5000, 2000)


def test_helpers(spark):
    assert values(spark, ["a"], X.vector_id) == ["ca978112ca1bbdcafac231b39a23dc4d"]
    assert values(spark, [None, "warn"], X.upper_level) == ["INFO", "WARN"]
    assert values(spark, ["A-b  a", "", "--"], X.tokens) == [["a", "b"], [], []]
    assert values(spark, ["low", "critical"], X.severity_rank) == [1, 4]
    assert values(spark, ["0.126"], lambda c: X.similarity_percent(c.cast("double"))) == ["87%"]
    ok = values(spark, ["x", "", None, "y" * 10_001], X.valid_message)
    assert ok == [True, False, False, False]
