"""Numbered lines and CSV records under many split sizes."""

from __future__ import annotations

import csv
import io
import random

import pytest

from logharbor.sources import blocks as B
from logharbor.sources import readers as R


@pytest.fixture
def split(spark):
    """Set the size at which files are split; Spark's own setting comes back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def to(size: int) -> None:
        spark.conf.set(names[0], f"{size}b")
        spark.conf.set(names[1], "1b")

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [40, 900, 10**6])
def test_lines_are_numbered_alike_however_files_are_split(spark, tmp_path, split, size):
    rnd = random.Random(1)
    files = {f"{k}.log": ["x" * rnd.randint(0, 60) for _ in range(rnd.randint(0, 40))] for k in range(4)}
    files["same.log"] = ["same"] * 90
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    split(size)
    read = B.read_numbered_lines(spark, str(tmp_path))
    got = {}
    for r in read.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert got == {n: dict(enumerate(x)) for n, x in files.items() if x}
    capped = B.read_numbered_lines(spark, str(tmp_path), max_lines=5).collect()
    assert len(capped) == sum(min(5, len(x)) for x in files.values()) and max(r.line_no for r in capped) == 4


def test_no_line_is_shuffled(spark, tmp_path, now):
    (tmp_path / "a.log").write_text("2024-01-15 12:01:00 ERROR redis: down\n" * 50)
    plan = R.read_text_logs(spark, str(tmp_path), "s", now)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def records(rnd, rows):
    def field():
        return rnd.choice(["", "a", "b c", 'say "hi"', "one\ntwo", "x,y", '"', "é\n\n", "p\"q\"\n,r", "long " * 9])
    return [["h1", "h2", "message"]] + [[field(), field(), f"m{i} {field()}"] for i in range(rows)]


@pytest.mark.parametrize("size", [23, 150, 10**6])
def test_records_equal_the_reader_of_one_task(spark, tmp_path, split, size):
    rnd = random.Random(size)
    for k, rows in enumerate((0, 3, 40)):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(records(rnd, rows))
        (tmp_path / f"{k}.csv").write_text(out.getvalue())
    split(size)
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    want = sorted((tuple(x or "" for x in r) for r in whole.collect()), key=repr)
    got = []
    for r in B.read_csv_records(spark, str(tmp_path)).collect():
        if r.record_no:
            got.append(tuple(next(csv.reader([r.record], strict=True))) if "\n" not in r.record else tuple(next(csv.reader(io.StringIO(r.record, newline="")))))
    assert sorted(got, key=repr) == want


def test_csv_rows_equal_under_any_split(spark, tmp_path, split, now):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records(random.Random(3), 30))
    (tmp_path / "a.csv").write_text(out.getvalue())
    seen = []
    for size in (60, 10**6):
        split(size)
        seen.append(sorted((r.id, r.message, sorted((r.extra_fields or {}).items())) for r in R.read_csv_logs(spark, str(tmp_path), "s", now).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 30
    assert len({i for i, *_ in seen[0]}) == 30


def test_stray_quotes_do_not_merge_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\na "quoted" word,b\nc,5" disk\n"open\nstill",d\n"a""\nb",e\n')
    got = sorted((r.record_no, r.record) for r in B.read_csv_records(spark, str(tmp_path)).collect())
    assert got == [(0, "h1,h2"), (1, 'a "quoted" word,b'), (2, 'c,5" disk'), (3, '"open\nstill",d'), (5, '"a""\nb",e')]


def test_caps_and_lengths_on_all_formats(spark, tmp_path, now):
    (tmp_path / "a.log").write_text("2024-01-15 12:01:00 ERROR redis: first message\nsecond\nthird\n")
    (tmp_path / "b.json").write_text('{"message": "one long message"}\n{"message": "two"}\n{"message": "three"}\n')
    (tmp_path / "c.csv").write_text("timestamp,level,message\n2024-01-01 00:00:00,INFO,a csv message\n2024-01-01 00:00:01,INFO,b\n")
    (tmp_path / "d.log").write_text("too large\n" * 100)
    rows = R.read_logs(spark, str(tmp_path), "s", now, max_file_bytes=500, max_lines=2, message_chars=5, raw_chars=6).collect()
    assert sorted(r.message for r in rows) == sorted(["redis", "secon", "one l", "two", "a csv", "b"])
    assert {len(r.raw_line) for r in rows if r.raw_line} == {6}
