"""A table of log rows by date that can be written again without harm.

Rows lie in ``data/version=<n>/event_date=<date>``, and a manifest per version lists
which of these folders make up the table.  A write puts its files under a new version
and then its manifest, one file, so readers see all of it or nothing, and a write that
is lost leaves files that no manifest names.  New rows add folders; changed and deleted
rows rewrite the folders of their dates; expired dates only leave the manifest.
Folders that are not touched keep their files.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.session import cut_lineage

_PARTS = "event_date date, version bigint"


class LogTable:
    """Log rows with an ``id`` and a ``timestamp``, each id once per date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int:
        """The last version, -1 before the first write."""
        if not self._exists("manifest"):
            return -1
        found = self.spark.read.schema(f"{_PARTS}, written bigint").parquet(f"{self.path}/manifest")
        last = found.agg(F.max("written")).first()[0]
        return -1 if last is None else last

    def parts(self, version: int | None = None) -> DataFrame:
        """Folders of a version, by default the last: ``event_date``, ``version``."""
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], _PARTS)
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/manifest/written={version}").filter("version IS NOT NULL")

    def _rows(self, parts: DataFrame) -> DataFrame:
        # both columns are folders: only those that the join names are read
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data").join(parts, ["version", "event_date"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last; a table without rows knows only their id and time."""
        parts = self.parts(version)
        if parts.isEmpty():
            return self.spark.createDataFrame([], "id string, timestamp timestamp")
        return self._rows(parts).drop("version", "event_date")

    def _publish(self, parts: DataFrame, version: int) -> None:
        # a row without a folder marks a version that may hold none
        mark = self.spark.range(1).select(F.lit(None).cast("date").alias("event_date"), F.lit(None).cast("bigint").alias("version"))
        parts.select("event_date", "version").distinct().unionByName(mark).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/written={version}")

    def _write(self, rows: DataFrame, version: int) -> DataFrame:
        """Write dated rows as a version; returns its folders."""
        folder = f"{self.path}/data/version={version}"
        # gathers small dates into few files, splits a hot date over several tasks
        rows.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(folder)
        if not self.spark.read.schema(rows.schema).parquet(folder).limit(1).count():
            return self.spark.createDataFrame([], _PARTS)
        return self.spark.read.schema(rows.schema).parquet(folder).select("event_date").distinct().withColumn("version", F.lit(version))

    @staticmethod
    def _dated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_date", F.coalesce(F.to_date("timestamp"), F.lit("1970-01-01").cast("date")))

    def merge(self, rows: DataFrame) -> None:
        """Add the rows whose id the table does not have yet; of rows with one id one is kept.

        Ids are looked up in the dates of the new rows only, as a row of one id keeps its time.
        """
        last = self.version()
        parts = self.parts(last)
        fresh = self._dated(rows).dropDuplicates(["event_date", "id"])
        if not parts.isEmpty():
            fresh = cut_lineage(fresh)
            dates = fresh.select("event_date").distinct()
            known = self._rows(parts.join(dates, "event_date", "left_semi")).select("event_date", "id")
            fresh = fresh.join(known, ["event_date", "id"], "left_anti")
        self._publish(parts.unionByName(self._write(fresh, last + 1)), last + 1)

    def _rewrite(self, touched: DataFrame, change) -> None:
        """Rewrite the folders of the touched dates, each date as one folder."""
        last = self.version()
        parts = cut_lineage(self.parts(last))
        if parts.isEmpty():
            raise ValueError("the table has no rows")
        mine = self._rows(parts.join(touched, "event_date", "left_semi")).drop("version")
        written = self._write(change(mine), last + 1)
        self._publish(parts.join(touched, "event_date", "left_anti").unionByName(written), last + 1)

    def _dates_of(self, ids: DataFrame) -> DataFrame:
        return cut_lineage(self._rows(self.parts()).select("event_date", "id").join(ids, "id", "left_semi").select("event_date").distinct())

    def delete(self, ids: DataFrame) -> None:
        """Delete rows by ``id`` (M4)."""
        ids = ids.select("id").distinct()
        self._rewrite(self._dates_of(ids), lambda mine: mine.join(ids, "id", "left_anti"))

    def replace(self, rows: DataFrame) -> None:
        """Put rows in place of those with their ids, and add the others; dates may change (M4)."""
        rows = cut_lineage(self._dated(rows))
        ids = rows.select("id").distinct()
        touched = cut_lineage(self._dates_of(ids).unionByName(rows.select("event_date")).distinct())
        self._rewrite(touched, lambda mine: mine.join(ids, "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def expire(self, cutoff: Column) -> int:
        """Drop all dates before the day of ``cutoff`` (M3): only the manifest changes. Returns the rows dropped."""
        last = self.version()
        parts = cut_lineage(self.parts(last))
        old = F.col("event_date") < F.to_date(cutoff)
        dropped = self._rows(parts.filter(old)).count()
        self._publish(parts.filter(~old), last + 1)
        return dropped
