from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logharbor.session import new_folder
from logharbor.sources.log_table import LogTable

LOG = "id string, timestamp timestamp, message string"
T0 = datetime(2024, 1, 1, 12)


def rows(spark, days, n=5, text="m"):
    return spark.createDataFrame([(f"{d}-{i}", T0 + timedelta(days=d), text) for d in days for i in range(n)], LOG)


def files(spark, table):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return {r.path for r in found.load(f"{table.path}/data").select("path").collect()}


@pytest.fixture
def table(spark):
    t = LogTable(spark, new_folder(spark, "table"))
    t.merge(rows(spark, [0, 1, 2]))
    return t


def test_writing_again_changes_nothing(spark, table):
    before = files(spark, table)
    table.merge(rows(spark, [0, 1, 2]))
    assert files(spark, table) == before and table.read().count() == 15
    table.merge(rows(spark, [2, 3], n=7).union(rows(spark, [3], n=7)))  # two rows of day 2 and all of day 3 are new
    assert files(spark, table) > before
    assert table.read().count() == 15 + 2 + 7 and table.read().select("id").distinct().count() == 24


def test_other_dates_keep_their_files(spark, table):
    before = files(spark, table)
    table.delete(spark.createDataFrame([("1-0",), ("none",)], "id string"))
    table.replace(rows(spark, [1], n=2, text="new").filter("id = '1-1'"))
    got = {r.id: r.message for r in table.read().collect()}
    assert len(got) == 14 and "1-0" not in got and got["1-1"] == "new" and got["0-0"] == "m"
    assert all("event_date=2024-01-02" in f for f in files(spark, table) - before)


def test_a_replaced_row_may_change_its_date(spark, table):
    table.replace(spark.createDataFrame([("0-0", T0 + timedelta(days=9), "moved")], LOG))
    got = table.read().filter("id = '0-0'").collect()
    assert [r.message for r in got] == ["moved"] and table.read().count() == 15


def test_expiry_touches_no_file(spark, table):
    before = files(spark, table)
    assert table.expire(F.lit(T0 + timedelta(days=1))) == 5
    assert table.read().count() == 10 and files(spark, table) == before
    assert table.read(0).count() == 15  # the earlier version still stands


def test_a_lost_write_shows_nothing(spark, table, monkeypatch):
    def lost(*_):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(LogTable, "_publish", lost)
    with pytest.raises(RuntimeError):
        table.merge(rows(spark, [5]))
    monkeypatch.undo()
    assert table.read().count() == 15
    table.merge(rows(spark, [6], n=3))
    assert table.read().count() == 18
    empty = LogTable(spark, new_folder(spark, "table"))
    assert empty.version() == -1
    empty.merge(rows(spark, [0]).limit(0))
    assert empty.version() == 0
    empty.merge(rows(spark, [0]))
    assert empty.read().count() == 5
