"""Sources of the registered queries are written and read by as many tasks as their size asks for."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from logharbor.plans import ingest_queries as I
from logharbor.plans import stream_queries as Q
from logharbor.session import new_folder
from logharbor.streaming import jobs as J

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def triggers(monkeypatch):
    """Small files, and the options of every stream that is opened."""
    seen, opened = [], J.file_stream
    monkeypatch.setattr(Q, "FILE_LINES", 50)
    monkeypatch.setattr(J, "file_stream", lambda *a, **options: (seen.append(options), opened(*a, **options))[1])
    return seen


def test_live_batches_come_in_several_files(spark, triggers, monkeypatch):
    sizes = []

    def run(stream, tables, state, now):
        J.run_batches(stream, lambda batch, batch_id: sizes.append((batch.select(F.input_file_name()).distinct().count(), batch.count())), state)

    monkeypatch.setattr(Q, "run_ingest", run)
    Q.drained_ingest(spark, SMALL)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    files = events.count() // (5 * 50)
    assert files > 1 and triggers == [{"maxFilesPerTrigger": files}]
    assert [n for n, _ in sizes] == [files] * 5
    assert sum(n for _, n in sizes) == events.count() + events.filter("event_id % 97 = 0").count()


def test_backlog_files_are_written_by_several_tasks(spark, triggers):
    found = sorted(tuple(r) for r in Q.stream_backlog(spark, SMALL).collect())
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    sizes = [events.filter(f"event_id % 4 = {i}").count() for i in range(4)]
    assert triggers == [{"maxFilesPerTrigger": min(sizes) // 50}] and min(sizes) // 50 > 1
    assert found == [(i, sizes[i], sum(sizes[i + 1:]), sum(sizes[i + 1:]) >= 1000) for i in range(4)]


def test_backlog_with_an_empty_batch(spark, triggers, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 4 <> 2")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = {r["batch_id"]: r["total_lines"] for r in Q.stream_backlog(spark, str(tmp_path)).collect()}
    assert found == {i: events.filter(f"event_id % 4 = {i}").count() for i in range(4)} and found[2] == 0


def test_csv_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    folders = []
    monkeypatch.setattr(I, "new_folder", lambda *a: folders.append(new_folder(*a)) or folders[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # a file a task
    try:
        rows = I.split_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(glob.glob(f"{folders[0].removeprefix('file:')}/*.csv")) >= 6
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
