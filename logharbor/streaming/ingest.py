"""Live ingest as one job: logs, flags, clusters, incidents, alerts and audit rows.

Every micro-batch writes its part of each table to a folder of its own, and last
of all its row of the ledger.  A part is visible once the ledger has its batch, so
a batch that fails half-way shows nothing, and its replay overwrites what it left.
What a batch writes depends on it and on the visible batches before it; tables are
read as the sum of their parts:

* ``logs``: parsed rows with the flags known when they came;
* ``counts``, ``measures``: rows, errors and rule values per window;
* ``texts``: per distinct text its rows, times, message rank and first rows, from
  which cluster records are merged without reading logs;
* ``sets``: new token sets, the representatives that later texts are compared with;
* ``roots``: component of each new token set, and of those whose component changed;
* ``alerts``, ``incidents``: what the windows and clusters touched by the batch
  amount to so far;
* ``ledger``: one audit row per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.operators import token_similarity as S
from logharbor.operators.clustering import cluster_records
from logharbor.operators.components import connected_components
from logharbor.operators.detection import (
    alert_rules,
    flag_anomalies,
    message_rank,
    rule_measures,
    threshold_alerts,
    window_rates,
)
from logharbor.operators.incidents import detect_incidents
from logharbor.operators.lookups import first_per_group
from logharbor.operators.maintenance import latest_by_key
from logharbor.operators.metrics import window_start
from logharbor.session import cut_lineage
from logharbor.sources.readers import parse_lines
from logharbor.streaming.jobs import batch_folder, run_batches

FIRST_MESSAGES = 5

_SCHEMAS = {
    "counts": "window_start timestamp, total bigint, errors bigint",
    "measures": "window_start timestamp, alert_type string, actual bigint",
    "texts": "`set` string, text string, service string, message string, rank int, weight bigint, low string, "
             "first_seen timestamp, last_seen timestamp, head array<struct<timestamp: timestamp, id: string>>",
    "order": "token string, df bigint",
    "sets": "id string, toks array<string>, n int, bits array<bigint>",
    "roots": "`set` string, root string",
    "ledger": "total_lines bigint, processed_lines bigint, error_lines bigint, clusters_updated bigint, incidents_detected bigint, "
              "status string",
}


class LiveTables:
    """Tables of an ingest job below one folder."""

    def __init__(
        self, spark: SparkSession, out: str, seconds: int = K.ANOMALY_WINDOW_SECONDS,
        alert_seconds: int = K.ANOMALY_WINDOW_SECONDS, threshold: tuple[int, int] = K.SIMILARITY,
    ):
        self.spark, self.out = spark, out.rstrip("/")
        self.seconds, self.alert_seconds, self.threshold = seconds, alert_seconds, threshold

    # ------------------------------------------------------------ parts

    def _folder(self, name: str, batch_id: int) -> str:
        return batch_folder(f"{self.out}/{name}", batch_id)

    def _write(self, name: str, part: DataFrame, batch_id: int) -> DataFrame:
        folder = self._folder(name, batch_id)
        part.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(part.schema).parquet(folder)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ledger(self) -> DataFrame:
        """One row per visible batch."""
        schema = _SCHEMAS["ledger"] + ", batch_id bigint"
        if not self._exists("ledger"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/ledger")

    def read(self, name: str, batch_id: int | None = None) -> DataFrame:
        """The visible parts of a table, with that of the running batch if it is named.

        Batches come one after the other, so all up to the last one of the ledger are
        visible; a literal bound keeps what a lost batch left from being read.
        """
        schema = _SCHEMAS.get(name)
        last = self.ledger().agg(F.max("batch_id")).first()[0] if batch_id is None else batch_id
        if schema is not None and not self._exists(name):
            return self.spark.createDataFrame([], schema + ", batch_id bigint")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema + ", batch_id bigint")
        return reader.parquet(f"{self.out}/{name}").filter(F.col("batch_id") <= F.lit(-1 if last is None else last))

    # ------------------------------------------------------------ results

    def rates(self, batch_id: int | None = None) -> DataFrame:
        summed = self.read("counts", batch_id).groupBy("window_start").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
        return summed.withColumn("error_rate", F.col("errors") / F.col("total"))

    def roots(self, batch_id: int | None = None) -> DataFrame:
        """The component of every token set."""
        return latest_by_key(self.read("roots", batch_id), ["set"], "batch_id").drop("batch_id")

    def logs(self) -> DataFrame:
        """Rows of all batches with the flags that the counts of all batches give, and their cluster, null for noise."""
        rows = flag_anomalies(self.read("logs"), self.seconds, cut_lineage(self.rates()))
        return rows.join(self.labels().select("set", "cluster_id"), "set", "left").drop("set", "batch_id")

    def _grouped(self, batch_id: int | None, touched: DataFrame | None = None) -> DataFrame:
        """Texts with their ``root``, of all components or of those touched."""
        texts = self.read("texts", batch_id).drop("batch_id").join(self.roots(batch_id), "set")
        return texts if touched is None else texts.join(touched, "root", "left_semi")

    def _named(self, texts: DataFrame) -> DataFrame:
        """Texts of components of enough rows with the ``cluster_id``, the smallest row id."""
        heavy = texts.groupBy("root").agg(F.sum("weight").alias("size"), F.min("low").alias("cluster_id"))
        return texts.join(heavy.filter(F.col("size") >= K.MIN_SAMPLES).select("root", "cluster_id"), "root")

    def labels(self) -> DataFrame:
        return self._named(self._grouped(None)).select("set", "cluster_id").distinct()

    def clusters(self, batch_id: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Cluster records merged from the texts' partial results."""
        texts = cut_lineage(self._named(self._grouped(batch_id, touched)))
        services = F.collect_set(F.when(F.col("service") != "", F.col("service")))
        totals = texts.groupBy("cluster_id").agg(
            F.sum("weight").alias("log_count"), F.max("rank").alias("rank"), F.sort_array(services).alias("tags"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        heads = texts.select("cluster_id", "message", F.inline("head"))
        first = first_per_group(heads, "cluster_id", ["timestamp", "id"], FIRST_MESSAGES)
        return cluster_records(totals, first)

    def incidents(self, batch_id: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Open incidents of the severe clusters."""
        return self._cases(cut_lineage(self.clusters(batch_id, touched)))

    def _cases(self, records: DataFrame) -> DataFrame:
        return detect_incidents(records, records.select(F.col("id").alias("cluster_id"), F.explode("tags").alias("service")))

    def alerts(self) -> DataFrame:
        """The last state of the alert of every rule and window."""
        return latest_by_key(self.read("alerts"), ["id"], "batch_id").drop("batch_id")

    # ------------------------------------------------------------ one batch

    def write_batch(self, lines: DataFrame, batch_id: int, ingest_time: Column, source: str = "websocket") -> None:
        """All steps of one micro-batch; a batch that the ledger has is left alone.

        ``lines`` has a ``line`` and an ``id`` (or ``file`` and ``line_no`` for one).
        """
        if not self.ledger().filter(F.col("batch_id") == batch_id).isEmpty():
            return
        if "id" not in lines.columns:
            lines = lines.withColumn("id", X.row_id(F.col("file"), F.col("line_no"), F.col("line"))).drop("file", "line_no")
        lines = lines.persist()
        try:
            parsed = parse_lines(lines, ingest_time, source=source)
            text = X.embedding_text(F.col("level"), F.col("service"), F.col("message"))
            key = F.sha2(F.array_join(F.sort_array(X.tokens(text)), " "), 256)
            parsed = self._write("parsed", parsed.withColumn("set", key), batch_id)
            self._flag(parsed, batch_id)
            self._alert(parsed, batch_id)
            touched = self._cluster(parsed, batch_id)
            records = cut_lineage(self.clusters(batch_id, touched))
            incidents = self._write("incidents", self._cases(records), batch_id)
            blank = ~F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))
            audit = lines.agg(F.count("*").alias("total_lines"), F.count_if(~blank).alias("processed_lines"), F.count_if(blank).alias("error_lines"))
            total, processed, errors = audit.first()
            row = (total, processed, errors, records.count(), incidents.count(), "completed")
            self._write("ledger", self.spark.createDataFrame([row], _SCHEMAS["ledger"]).coalesce(1), batch_id)
        finally:
            lines.unpersist()

    def _flag(self, parsed: DataFrame, batch_id: int) -> None:
        self._write("counts", window_rates(parsed, self.seconds).select("window_start", "total", "errors"), batch_id)
        self._write("logs", flag_anomalies(parsed, self.seconds, self.rates(batch_id)), batch_id)

    def _alert(self, parsed: DataFrame, batch_id: int) -> None:
        """Rule values of the batch's windows, and the alerts of these windows so far."""
        windowed = parsed.withColumn("window_start", window_start("timestamp", self.alert_seconds))
        mine = self._write("measures", rule_measures(windowed, ["window_start"]), batch_id)
        touched = mine.select("window_start").distinct()
        so_far = self.read("measures", batch_id).join(touched, "window_start", "left_semi")
        so_far = so_far.groupBy("window_start", "alert_type").agg(F.sum("actual").alias("actual"))
        self._write("alerts", threshold_alerts(so_far, alert_rules(self.spark), "window_start"), batch_id)

    def _cluster(self, parsed: DataFrame, batch_id: int) -> DataFrame:
        """Join the batch's texts to the known components; returns the roots it touched."""
        text = X.embedding_text(F.col("level"), F.col("service"), F.col("message"))
        first = F.expr(f"slice(array_sort(collect_list(struct(timestamp, id))), 1, {FIRST_MESSAGES})")
        keys = ["set", "text", "service", "message"]
        rows = parsed.withColumn("text", text)
        head = first_per_group(rows.select("text", "set", "service", "message", "timestamp", "id"), "text", ["timestamp", "id"], FIRST_MESSAGES)
        totals = rows.groupBy(*keys).agg(F.count("*").alias("weight"), F.min("id").alias("low"), F.min("timestamp").alias("first_seen"),
                                         F.max("timestamp").alias("last_seen"))
        heads = head.groupBy("text").agg(first.alias("head"))
        texts = totals.join(heads, "text").withColumn("rank", message_rank(F.col("message")))
        texts = self._write("texts", texts.select("set", "text", "service", "message", "rank", "weight", "low", "first_seen", "last_seen", "head"), batch_id)

        known = self.read("sets", batch_id - 1).drop("batch_id")
        new = texts.groupBy(F.col("set").alias("id")).agg(F.min("text").alias("text")).join(known.select("id"), "id", "left_anti")
        new = cut_lineage(new)
        if new.isEmpty():  # nothing unknown: no component changes
            return self._touched(texts, batch_id)
        order = self.read("order", batch_id - 1).drop("batch_id")
        if order.isEmpty():  # the first texts fix the order of tokens; any order gives the same links
            order = self._write("order", S.frequent_tokens(new), batch_id)
        new = self._write("sets", S.rank_tokens(new, order), batch_id)
        links = self._links(new, known)
        before = cut_lineage(self.roots(batch_id - 1))
        named = before.select(F.col("set").alias("node"), "root")
        for side in ("u", "v"):
            links = links.join(named, F.col(side) == F.col("node"), "left").withColumn(side, F.coalesce("root", side)).drop("node", "root")
        moved = cut_lineage(connected_components(links)).withColumnRenamed("root", "to")
        fresh = new.select(F.col("id").alias("set")).join(moved, F.col("set") == F.col("id"), "left").select("set", F.coalesce("to", "set").alias("root"))
        changed = before.join(moved, (F.col("root") == F.col("id")) & (F.col("root") != F.col("to"))).select("set", F.col("to").alias("root"))
        self._write("roots", fresh.unionByName(changed), batch_id)
        return self._touched(texts, batch_id)

    def _touched(self, texts: DataFrame, batch_id: int) -> DataFrame:
        return cut_lineage(self.roots(batch_id).join(texts.select("set").distinct(), "set", "left_semi").select("root").distinct())

    def _links(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """Links that connect the new token sets with each other and with known ones.

        Only known sets that share a prefix token with a new one can be similar to it.
        """
        tokens = S.prefix_rows(new, self.threshold).select("token").distinct()
        near = S.prefix_rows(known, self.threshold).join(tokens, "token", "left_semi").select("id").distinct()
        both = cut_lineage(new.unionByName(known.join(near, "id", "left_semi")))
        return S.similarity_links(both, self.threshold)


def run_ingest(lines: DataFrame, tables: LiveTables, checkpoint: str, ingest_time: Column | None = None) -> LiveTables:
    """Drain a stream of lines into the tables."""
    now = F.current_timestamp() if ingest_time is None else ingest_time
    run_batches(lines, lambda batch, batch_id: tables.write_batch(batch, batch_id, now), checkpoint)
    return tables
