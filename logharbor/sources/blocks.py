"""Numbered lines and CSV records of split files, without a shuffle of the text.

A file is read in blocks, each from its start to its end by one task.  A first pass
over the files reduces every block to a few numbers; sums over the blocks of a file
give each block what it must know of the blocks before it, and the second pass works
inside the blocks.  The text itself never leaves its task, except the pieces of
records that cross a block's edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.session import cut_lineage

#: Blocks whose numbers are broadcast; beyond that the same join shuffles.
BROADCAST_BLOCKS = 2_000_000
SPLIT_CONF = "spark.sql.files.minPartitionNum"

_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_COMPLETE = re.compile(rf"{_FIELD}(?:,{_FIELD})*\Z")
_CLOSING = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_FIELD})*\Z')


def scan_lines(spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None) -> DataFrame:
    """``line``, ``file``, ``block`` (where it starts) and ``at``, which grows by one from line to line of a block.

    Blocks must be cut alike in both passes, so their number is not left to the
    executors of the moment.
    """
    if spark.conf.get(SPLIT_CONF, None) is None:
        spark.conf.set(SPLIT_CONF, spark.sparkContext.defaultParallelism)
    df = spark.read.text(paths).withColumn("_m", F.col("_metadata"))
    if max_file_bytes is not None:
        df = df.filter(F.col("_m.file_size") <= max_file_bytes)
    return df.select(F.make_valid_utf8("value").alias("line"), F.col("_m.file_path").alias("file"),
                     F.col("_m.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _with_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    blocks = cut_lineage(blocks)
    return lines.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["file", "block"], "left")


def read_numbered_lines(
    spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None, max_lines: int | None = None
) -> DataFrame:
    """Lines with their ``file`` and their number in it from 0, however the file is split.

    ``max_lines`` keeps the first lines of every file, blank ones included.
    """
    lines = scan_lines(spark, paths, max_file_bytes)
    counted = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = _with_blocks(lines, counted.select("file", "block", "first", before.alias("before")))
    # the upper bits of ``at`` tell the task that read the block
    same = F.shiftright("at", 33) == F.shiftright("first", 33)
    number = F.when(same, F.col("before") + F.col("at") - F.col("first")).otherwise(
        F.raise_error(F.lit("files were split differently between two passes")).cast("bigint"))
    out = numbered.select("line", "file", number.alias("line_no"))
    return out if max_lines is None else out.filter(F.col("line_no") < max_lines)


# ---------------------------------------------------------------- CSV records

def _goes_on(line: str, inside: bool) -> bool:
    """Whether a record goes on after a line that starts inside quotes or at a record's start."""
    if '"' not in line:
        return inside
    return not (_CLOSING if inside else _COMPLETE).match(line)


def _blocks_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """``(changed, file, block, line, ...)`` of a task's lines; ``changed`` at the first line of a block."""
    at = None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "line", *names)), strict=True):
            yield (row[:2] != at, *row)
            at = row[:2]


_EFFECT = [("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_()), ("closes", pa.bool_())]
_PIECE = [("file", pa.string()), ("block", pa.int64()), ("opened", pa.int64()), ("record_no", pa.int64()), ("record", pa.string())]
_ROWS = 4096


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: lines, whether it ends inside quotes if it starts outside or inside them, and whether an open record ends."""
    rows: list[list] = []
    for changed, file, block, line in _blocks_of(batches):
        if changed:
            rows.append([file, block, 0, False, True, False])
        row = rows[-1]
        row[2] += 1
        row[3], row[4] = _goes_on(line, row[3]), _goes_on(line, row[4])
        row[5] = row[5] or not row[4]
    if rows:
        yield _batch(rows, _EFFECT)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of records that cross an edge with the block where their record opened."""
    out: list[tuple] = []
    held: list[str] = []
    at = None  # file, block, block of the open record's start, number of its first line here
    start, n = None, 0

    def flush():
        if held:  # open at the block's end
            out.append((at[0], at[1], at[1] if start is not None else at[2], at[3] + (start or 0), "\n".join(held)))
            held.clear()

    inside = False
    for changed, file, block, line, began, before, opened in _blocks_of(batches, "inside", "before", "opened"):
        if changed:
            flush()
            at, inside, n = (file, block, opened, before), began, 0
            start = None if inside else 0
        if not inside:
            start = n
        held.append(line)
        inside = _goes_on(line, inside)
        if not inside:
            out.append((file, block, None if start is not None else opened, before + (start or 0), "\n".join(held)))
            held.clear()
        n += 1
        if len(out) >= _ROWS:
            yield _batch(out, _PIECE)
            out.clear()
    flush()
    if out:
        yield _batch(out, _PIECE)


def read_csv_records(spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None) -> DataFrame:
    """``file``, ``record_no`` (number of its first line) and ``record``: CSV records of files that are split anywhere.

    Every block tells how it changes the state inside or outside quotes; composed in
    order of the blocks that gives the state each block starts in.  Only pieces of
    records that cross an edge are shuffled, one per block.
    """
    lines = scan_lines(spark, paths, max_file_bytes)
    effects = cut_lineage(lines.select("file", "block", "line").mapInArrow(
        _effects, "file string, block bigint, n bigint, plain boolean, quoted boolean, closes boolean"))
    order = Window.partitionBy("file").orderBy("block")
    # a block keeps the state, swaps it or sets it: the last one that sets it counts, and the swaps since
    fixed = F.when(F.col("plain") == F.col("quoted"), F.col("plain").cast("int"))
    swaps = F.col("plain") & ~F.col("quoted")
    marked = effects.withColumns({"fixed": fixed, "swapped": F.sum(swaps.cast("int")).over(order)})
    since = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swapped")), ignorenulls=True).over(order)
    state = (F.coalesce(since["fixed"], F.lit(0)) + F.col("swapped") - F.coalesce(since["swapped"], F.lit(0))) % 2 == 1
    marked = marked.withColumn("ends", state).withColumn("inside", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    opens = F.col("ends") & (~F.col("inside") | F.col("closes"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.select("file", "block", "inside", (F.sum("n").over(order) - F.col("n")).alias("before"),
                           F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before).alias("opened"))
    pieces = _with_blocks(lines.select("file", "block", "line"), blocks).select("file", "block", "line", "inside", "before", "opened").mapInArrow(
        _pieces, "file string, block bigint, opened bigint, record_no bigint, record string")
    whole = pieces.filter("opened IS NULL").select("file", "record_no", "record")
    parts = F.sort_array(F.collect_list(F.struct("block", "record")))
    crossing = pieces.filter("opened IS NOT NULL").groupBy("file", "opened").agg(
        F.min("record_no").alias("record_no"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(crossing.select("file", "record_no", "record"))
