"""Raw logs in: text lines, JSON lines, CSV files, line batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import parsing as P
from logharbor.functions import text as X
from logharbor.sources.blocks import read_csv_records, read_numbered_lines

# Stores whose files a task can open by itself to read only their start.
HEAD_STORES = ["file", "hdfs", "s3", "s3a", "gs"]

# Copies of one line that a single task numbers at most (see ``with_line_ids``).
COPIES_PER_TASK = 1_000_000

# Slices in which the lines of a file are ranked for a cap.
CAP_SLICES = 64


# ---------------------------------------------------------------- lines

def read_lines(
    spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None
) -> DataFrame:
    """Lines of text files with their file name; bad UTF-8 bytes become U+FFFD.

    ``max_file_bytes`` skips larger files; the default reads everything (S13).
    """
    df = spark.read.text(paths).withColumn("_m", F.col("_metadata"))
    if max_file_bytes is not None:
        df = df.filter(F.col("_m.file_size") <= max_file_bytes)
    return df.select(
        F.make_valid_utf8("value").alias("line"), F.col("_m.file_path").alias("file")
    )


def number_copies(rows: DataFrame) -> DataFrame:
    """Add ``copy`` = 0, 1, ... to exact copies of a row.

    Copies are counted first (map-side combined, so a line that makes up a third
    of the input is one row per task) and then spread out again.  Runs of more
    than ``COPIES_PER_TASK`` copies are cut and redistributed before that.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    few = counted.filter(F.col("_n") <= COPIES_PER_TASK).withColumn("_first", F.lit(0).cast("long"))
    many = (
        counted.filter(F.col("_n") > COPIES_PER_TASK)
        .withColumn("_first", F.explode(F.expr(f"sequence(0L, _n - 1, {COPIES_PER_TASK}L)")))
        .repartition(*columns, "_first")
    )
    last = F.least(F.col("_first") + COPIES_PER_TASK, F.col("_n")) - 1
    spread = few.unionByName(many).withColumn("copy", F.explode(F.sequence("_first", last)))
    return spread.select(*columns, "copy")


def with_line_ids(lines: DataFrame) -> DataFrame:
    """Add ``id`` to lines; the same input always gives the same ids.

    With a ``line_no`` column (stream offset, table key) no shuffle is needed.
    Plain files have no line number that is independent of how they are split,
    so equal lines of a file are told apart by their copy number.
    """
    if "line_no" in lines.columns:
        return lines.withColumn("id", X.row_id(F.col("file"), F.col("line_no"), F.col("line")))
    numbered = number_copies(lines.select("file", "line"))
    return numbered.withColumn("id", X.row_id(F.col("file"), F.col("copy"), F.col("line"))).drop("copy")


def cap_lines(lines: DataFrame, per: str, order: str, limit: int = K.MAX_FILE_LINES) -> DataFrame:
    """First ``limit`` lines per file or batch (S13, off unless called).

    Lines are ranked within slices of a file first, so that a huge file is sorted by
    many tasks and its last rank sees at most ``limit`` rows of each slice.
    """
    sliced = Window.partitionBy(per, "_slice").orderBy(order)
    ranked = lines.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(CAP_SLICES)))
    ranked = ranked.withColumn("_rn", F.row_number().over(sliced)).filter(F.col("_rn") <= limit).drop("_slice")
    w = Window.partitionBy(per).orderBy(order)
    return ranked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


# ---------------------------------------------------------------- line parsing

def parse_lines(
    lines: DataFrame, ingest_time: Column, source: str = "file_upload", json: bool = True,
    message_chars: int = K.MESSAGE_CHARS, raw_chars: int = K.RAW_LINE_CHARS,
) -> DataFrame:
    """Normalise a ``line`` column to log rows; blank lines are dropped.

    With ``json`` a line that is one JSON object is read as such and everything
    else by the text rule, row by row, so a bad line never fails its file.
    Columns other than ``line`` pass through.  Works on streams.  Messages and raw
    lines are cut at ``message_chars`` and ``raw_chars`` (P9).

    Each stage picks the text a rule reads and the next applies the rule once, so
    that the generated code stays small enough to compile.
    """
    keep = [c for c in lines.columns if c not in ("line", "source")]
    line, fields = F.col("line"), F.col("fields")
    df = lines.filter(line.rlike(r"\S")).withColumn("line", P.strip(line))
    if json:
        df = df.withColumn("fields", F.when(P.starts_object(line), P.json_fields(line)))
        raw_level = F.coalesce(P.first_present(fields, K.JSON_LEVEL_KEYS), F.lit("INFO"))
        is_json = fields.isNotNull()
        df = df.withColumns({
            "json_message": F.when(
                is_json, F.coalesce(P.first_present(fields, K.JSON_MESSAGE_KEYS), line)),
            "json_time": P.first_present(fields, K.JSON_TIME_KEYS),
            "json_service": P.first_present(fields, K.JSON_SERVICE_KEYS),
            "level_text": F.when(is_json, raw_level).otherwise(line),
            "extra_fields": P.residual_fields(fields, K.JSON_CONSUMED_KEYS),
        })
        df = df.withColumns({
            "time_text": F.when(is_json, F.col("json_time")).otherwise(line),
            "body": F.coalesce("json_message", "line"),
        })
        iso = P.iso_timestamp(F.col("json_time"))
        service, message = F.col("json_service"), F.col("json_message")
    else:
        nothing = F.lit(None).cast("string")
        df = df.withColumns({
            "level_text": line, "time_text": line, "body": line,
            "extra_fields": F.lit(None).cast("map<string,string>"),
        })
        iso, service, message = F.lit(None).cast("timestamp"), nothing, nothing
    stripped = F.col("stripped")
    df = df.withColumn("rest", P.strip_first_stamp(F.col("body")))
    return df.withColumn("stripped", P.strip_other_stamps_and_level(F.col("rest"))).select(
        *keep,
        F.coalesce(iso, P.parse_timestamp(F.col("time_text"), ingest_time), ingest_time).alias("timestamp"),
        P.parse_level(F.col("level_text")).alias("level"),
        F.coalesce(service, P.service_in(stripped)).alias("service"),
        P.truncate(F.coalesce(message, P.clean_stripped(stripped, line)), message_chars).alias("message"),
        "extra_fields",
        F.lit(source).alias("source"),
        P.truncate(line, raw_chars).alias("raw_line"),
    )


def line_counts(lines: DataFrame, per: list[str], json: bool = False) -> DataFrame:
    """Total, processed and error lines; a blank line is an error in text mode only."""
    blank = ~F.col("line").rlike(r"\S")
    errors = F.lit(0).cast("long") if json else F.count_if(blank)
    return lines.groupBy(*per).agg(
        F.count("*").alias("total_lines"),
        F.count_if(~blank).alias("processed_lines"),
        errors.alias("error_lines"),
    )


def batch_counts(lines: DataFrame, per: list[str]) -> DataFrame:
    """Line-batch totals: errors are the lines that gave no row."""
    blank = ~F.col("line").rlike(r"\S")
    return lines.groupBy(*per).agg(
        F.count("*").alias("total_lines"),
        F.count_if(~blank).alias("processed_lines"),
        F.count_if(blank).alias("error_lines"),
    )


def read_text_logs(
    spark: SparkSession, paths: str | list[str], session_id: str, ingest_time: Column,
    json: bool = False, max_file_bytes: int | None = None, max_lines: int | None = None,
    message_chars: int = K.MESSAGE_CHARS, raw_chars: int = K.RAW_LINE_CHARS,
) -> DataFrame:
    """Text files (or JSON-lines files) to log rows, optionally capped.

    Ids come from line numbers, which are the same however the files are split, and
    no line is shuffled for them.
    """
    lines = with_line_ids(read_numbered_lines(spark, paths, max_file_bytes, max_lines))
    rows = parse_lines(lines, ingest_time, json=json, message_chars=message_chars, raw_chars=raw_chars)
    return rows.withColumn("session_id", F.lit(session_id))


def read_json_logs(
    spark: SparkSession, paths: str | list[str], session_id: str, ingest_time: Column, **limits
) -> DataFrame:
    """JSON-lines files; a line that is no object falls back to the text rule."""
    return read_text_logs(spark, paths, session_id, ingest_time, json=True, **limits)


# ---------------------------------------------------------------- CSV

def find_role(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate, then first header, that contains it."""
    for candidate in candidates:
        for name in columns:
            if candidate in name.lower():
                return name
    return None


def csv_roles(columns: list[str]) -> dict[str, str | None]:
    return {
        "message": find_role(columns, K.CSV_MESSAGE_HEADERS),
        "timestamp": find_role(columns, K.CSV_TIME_HEADERS),
        "level": find_role(columns, K.CSV_LEVEL_HEADERS),
        "service": find_role(columns, K.CSV_SERVICE_HEADERS),
    }


def parse_records(
    records: DataFrame, ingest_time: Column, source: str = "file_upload", message_chars: int = K.MESSAGE_CHARS
) -> DataFrame:
    """Rows of named string columns to log rows; empty messages are skipped.

    A missing level becomes INFO instead of failing the file.  Without an ``id``
    column the id hashes the file, the record and its copy number.
    """
    if "id" not in records.columns:
        records = number_copies(records)
        names = [c for c in records.columns if c not in ("file", "copy")]
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
        records = records.withColumn("id", X.row_id(F.col("file"), F.col("copy"), row)).drop("copy")
    columns = [c for c in records.columns if c not in ("file", "id")]
    role = csv_roles(columns)

    def of(name: str) -> Column | None:
        return F.col(f"`{role[name]}`") if role[name] else None

    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    message = of("message") if role["message"] else whole
    stamp = of("timestamp") if role["timestamp"] else F.lit("")
    level = F.coalesce(of("level"), F.lit("INFO")) if role["level"] else F.lit("INFO")
    service = P.blank_to_null(of("service")) if role["service"] else P.parse_service(message)
    rest = [c for c in columns if c not in role.values()]
    extra = F.lit(None).cast("map<string,string>")
    if rest:
        pairs = F.map_from_arrays(
            F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`") for c in rest])
        )
        kept = F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))
        extra = F.when(F.size(kept) > 0, kept)
    return records.filter(F.coalesce(message != "", F.lit(False))).select(
        "id",
        F.coalesce(P.parse_timestamp(stamp, ingest_time), ingest_time).alias("timestamp"),
        P.parse_level(level).alias("level"),
        service.alias("service"),
        P.truncate(message, message_chars).alias("message"),
        extra.alias("extra_fields"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("raw_line"),
    )


def read_csv_logs(
    spark: SparkSession, paths: str | list[str], session_id: str, ingest_time: Column,
    max_file_bytes: int | None = None, message_chars: int = K.MESSAGE_CHARS,
) -> DataFrame:
    """CSV files that share a header (S3); quoted line breaks may stand anywhere, and files are split (see ``blocks``)."""
    columns = spark.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False).columns
    records = read_csv_records(spark, paths, max_file_bytes).filter((F.col("record_no") > 0) & (F.col("record") != ""))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"})
    rows = records.select(
        "file", X.row_id(F.col("file"), F.col("record_no"), F.col("record")).alias("id"), parsed.alias("_r"))
    if {"file", "id"} & set(columns):  # the file's own columns of these names are told apart
        named = [F.col("_r")[c].alias(f"{c}_" if c in ("file", "id") else c) for c in columns]
    else:
        named = [F.col("_r")[c].alias(c) for c in columns]
    return parse_records(rows.select("file", "id", *named), ingest_time, message_chars=message_chars).withColumn(
        "session_id", F.lit(session_id))


# ---------------------------------------------------------------- format detection

def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First bytes of each listed file, read in the task through the file's own store."""
    from pyarrow import fs

    size = K.FORMAT_SAMPLE_CHARS * 4  # a character takes at most four bytes
    for pdf in batches:
        heads = []
        for path in pdf["file"]:
            uri = path.replace("s3a://", "s3://")
            if uri.startswith("file:/") and not uri.startswith("file:///"):
                uri = "file://" + uri[len("file:"):]
            store, key = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(key) as f:
                heads.append(f.read(size).decode("utf-8", errors="replace"))
        yield pd.DataFrame({"file": pdf["file"], "head": heads})


def detect_head(head: Column) -> Column:
    """'json', 'csv' or 'text' from the first 2048 characters of a file."""
    sample = P.strip(F.substring(head, 1, K.FORMAT_SAMPLE_CHARS))
    lines = F.split(sample, r"\r\n|\r|\n")
    objects = F.filter(
        F.transform(F.slice(lines, 1, 5), lambda x: F.trim(x)), lambda x: x.startswith("{")
    )
    first = F.try_element_at(objects, F.lit(1))
    # quoted fields may hide commas and line breaks
    plain = F.split(F.regexp_replace(sample, r'"(?:[^"]|"")*"', "q"), r"\r\n|\r|\n")
    top, second = F.try_element_at(plain, F.lit(1)), F.try_element_at(plain, F.lit(2))
    commas = F.length(F.element_at(lines, 1)) - F.length(F.replace(F.element_at(lines, 1), F.lit(",")))
    is_csv = (commas >= 2) & (second != "") & (F.size(F.split(top, ",")) == F.size(F.split(second, ",")))
    return (
        F.when(first.isNotNull() & F.try_parse_json(first).isNotNull(), "json")
        .when(F.coalesce(is_csv, F.lit(False)), "csv")
        .otherwise("text")
    )


def detect_formats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: its format.

    The listing prunes file contents, and tasks read only the head of each file,
    so the cost follows the number of files and not their size.
    """
    listed = spark.read.format("binaryFile").load(paths)
    odd = listed.select(F.regexp_extract("path", r"^(\w+):", 1).alias("s")).filter(~F.col("s").isin(HEAD_STORES))
    if odd.isEmpty():
        heads = listed.select(F.col("path").alias("file")).mapInPandas(_read_heads, "file string, head string")
    else:  # a store only Spark can open: its files are read whole
        start = F.substring("content", 1, K.FORMAT_SAMPLE_CHARS * 4).cast("string")
        heads = listed.select(F.col("path").alias("file"), F.make_valid_utf8(start).alias("head"))
    header = F.element_at(F.split("head", r"\r\n|\r|\n"), 1)
    return heads.select("file", detect_head(F.col("head")).alias("format"), header.alias("header"))


def read_logs(
    spark: SparkSession, paths: str | list[str], session_id: str, ingest_time: Column,
    max_file_bytes: int | None = None, max_lines: int | None = None,
    message_chars: int = K.MESSAGE_CHARS, raw_chars: int = K.RAW_LINE_CHARS,
) -> DataFrame:
    """Route every file to its reader by detected format and union the rows.

    The limits (S13) are off but for the lengths: larger files are skipped, text and
    JSON files are read up to ``max_lines``, messages and raw lines are cut.

    Text and JSON files are one scan, whose lines are told apart one by one.
    Only file names reach the driver, as they do for any file scan.  CSV files
    are read per header so that roles resolve file by file.
    """
    found = detect_formats(spark, paths).collect()
    by_format: dict[str, list[str]] = {}
    same: dict[str, list[str]] = {}
    for row in found:
        by_format.setdefault(row["format"], []).append(row["file"])
        if row["format"] == "csv":
            same.setdefault(row["header"], []).append(row["file"])
    parts = []
    lines = by_format.get("text", []) + by_format.get("json", [])
    if lines or not found:  # empty files are not listed; they have no rows
        parts.append(read_json_logs(
            spark, lines or paths, session_id, ingest_time, max_file_bytes=max_file_bytes, max_lines=max_lines,
            message_chars=message_chars, raw_chars=raw_chars))
    parts += [read_csv_logs(spark, files, session_id, ingest_time, max_file_bytes, message_chars) for files in same.values()]
    columns = ["id", "session_id", "timestamp", "level", "source", "service", "message",
               "raw_line", "extra_fields"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def ingest_batch(
    lines: DataFrame, session_id: str, ingest_time: Column, limit: int | None = None
) -> DataFrame:
    """Rows of one line batch (columns ``line_no``, ``line``), optionally capped."""
    if limit is not None:
        lines = lines.orderBy("line_no").limit(limit)
    lines = with_line_ids(lines.withColumn("file", F.lit(session_id)))
    rows = parse_lines(lines, ingest_time, source="api")
    return rows.drop("file", "line_no").withColumn("session_id", F.lit(session_id))
