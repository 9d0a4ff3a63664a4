"""Counters of a run without a second pass, backlog of a stream, replays within a horizon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from logharbor.session import cut_lineage
from logharbor.sources.sinks import session_audit
from logharbor.streaming.jobs import batch_folder, run_batches

_COUNTS = "total_lines bigint, processed_lines bigint, error_lines bigint"


def observed_lines(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """Lines that count themselves while a job reads them: total, processed and blank."""
    seen = Observation()
    blank = ~F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))
    return lines.observe(seen, F.count(F.lit(1)).alias("total_lines"), F.count_if(~blank).alias("processed_lines"),
                         F.count_if(blank).alias("error_lines")), seen


def write_with_audit(
    lines: DataFrame, write: Callable[[DataFrame], None], session_id: str, source: str, started_at: Column, completed_at: Column
) -> DataFrame:
    """Run a job over the lines and return its audit row; the lines are read once.

    ``write`` gets the lines and must read all of them in one action.
    """
    spark = lines.sparkSession
    counted, seen = observed_lines(lines)
    write(counted)
    found = seen.get
    row = (session_id, *(found.get(c, 0) for c in ("total_lines", "processed_lines", "error_lines")))
    return session_audit(spark.createDataFrame([row], f"session_id string, {_COUNTS}"), source, started_at, completed_at)


def run_counted(lines: DataFrame, write: Callable[[DataFrame, int], None], out: str, checkpoint: str) -> DataFrame:
    """Drain a stream of lines and return what every batch read, counted by its own writes.

    ``write`` gets the batch's lines and number and reads them in one action.
    """
    spark = lines.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        counted, seen = observed_lines(batch)
        write(counted, batch_id)
        found = seen.get
        row = tuple(found.get(c, 0) for c in ("total_lines", "processed_lines", "error_lines"))
        spark.createDataFrame([row], _COUNTS).coalesce(1).write.mode("overwrite").parquet(batch_folder(out, batch_id))

    run_batches(lines, step, checkpoint)
    return spark.read.schema(f"{_COUNTS}, batch_id bigint").parquet(out)


def backlog(progress: DataFrame, waiting: int) -> DataFrame:
    """Lines still waiting after every batch, of ``waiting`` at the start; one row per batch.

    The ``depth`` column feeds ``queue_measures``.
    """
    read = F.sum("total_lines").over(Window.orderBy("batch_id"))
    return progress.select("batch_id", "total_lines", (F.lit(waiting) - read).alias("depth"))


def drop_replays_within(rows: DataFrame, out: str, checkpoint: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a stream once per id, and rows that came too late to tell.

    A batch looks its ids up among the rows of the last ``days`` dates before the
    newest one of earlier batches; these dates are all the state there is, and they
    are the folders of the kept rows themselves.  Older rows are set aside, not lost:
    the second table has those whose id was never kept.  A replayed row has the time
    of the first one.
    """
    spark = rows.sparkSession
    kept, late, newest = f"{out}/kept", f"{out}/late", f"{out}/newest"
    names, plain = rows.columns, rows.schema
    dated_schema = StructType([*plain.fields, StructField("batch_id", LongType()), StructField("event_date", DateType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.dropDuplicates(["id"]).withColumn("event_date", F.to_date("timestamp")).persist()
        try:
            horizon = None
            if batch_id:
                before = spark.read.schema("event_date date, batch_id bigint").parquet(newest).filter(F.col("batch_id") < batch_id)
                horizon = before.agg(F.date_sub(F.max("event_date"), days)).first()[0]
            old = F.lit(False) if horizon is None else F.coalesce(F.col("event_date") < F.lit(horizon), F.lit(True))
            dated.filter(old).select(*names).write.mode("overwrite").parquet(batch_folder(late, batch_id))
            fresh = dated.filter(~old)
            if horizon is not None:
                known = spark.read.schema(dated_schema).parquet(kept)
                known = known.filter((F.col("batch_id") < batch_id) & (F.col("event_date") >= F.lit(horizon)))
                fresh = fresh.join(known.select("event_date", "id"), ["event_date", "id"], "left_anti")
            fresh.write.mode("overwrite").partitionBy("event_date").parquet(batch_folder(kept, batch_id))
            dated.agg(F.max("event_date").alias("event_date")).coalesce(1).write.mode("overwrite").parquet(batch_folder(newest, batch_id))
        finally:
            dated.unpersist()

    run_batches(rows, write, checkpoint)
    once = spark.read.schema(dated_schema).parquet(kept).select(*names)
    aside = spark.read.schema(plain).parquet(late).select(*names).dropDuplicates(["id"])
    return once, cut_lineage(aside.join(once.select("id"), "id", "left_anti"))
