"""Counts, rates, histograms and dashboard metrics.

Every "last N seconds" operator takes ``as_of``; the default is the newest
timestamp of the table, so results are reproducible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.session import cut_lineage


def is_error() -> Column:
    return F.col("level").isin(K.ERROR_LEVELS)


def newest(logs: DataFrame, ts: str = "timestamp") -> Column:
    """The newest timestamp as a scalar subquery (one aggregate, no join)."""
    return logs.agg(F.max(ts)).scalar()


def last_seconds(
    logs: DataFrame, seconds: int, as_of: Column | None = None, ts: str = "timestamp"
) -> DataFrame:
    end = newest(logs, ts) if as_of is None else as_of
    return logs.filter(F.col(ts) >= end - F.expr(f"INTERVAL {seconds} SECONDS"))


def level_counts(
    logs: DataFrame, seconds: int = K.ANOMALY_WINDOW_SECONDS, as_of: Column | None = None
) -> DataFrame:
    """Count by level in the last seconds (A1)."""
    return last_seconds(logs, seconds, as_of).groupBy("level").agg(F.count("*").alias("n"))


def events_per_second(logs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows of the last minute over 60 (A2)."""
    rate = F.count("*") / F.lit(float(K.RATE_WINDOW_SECONDS))
    return last_seconds(logs, K.RATE_WINDOW_SECONDS, as_of).agg(rate.alias("events_per_second"))


def error_rate() -> Column:
    """(ERROR + CRITICAL) / total, 0 when there are no rows (A3)."""
    return F.round(F.coalesce(F.avg(F.when(is_error(), 1.0).otherwise(0.0)), F.lit(0.0)), 4)


def window_start(ts: str, seconds: int) -> Column:
    """Start of the row's tumbling window.

    Plain arithmetic: ``window()`` would add a not-null filter, which Spark pushes
    down and which then parses every raw line a second time.
    """
    at = F.unix_seconds(F.col(ts))
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds)))


def tumbling_levels(logs: DataFrame, seconds: int) -> DataFrame:
    """A1 for every tumbling window."""
    return logs.groupBy(window_start("timestamp", seconds).alias("window_start"), "level").agg(
        F.count("*").alias("n")
    )


def error_heatmap(
    logs: DataFrame, days: int = K.HEATMAP_DAYS, as_of: Column | None = None
) -> DataFrame:
    """Errors per hour of day and day of week over the last days (A4)."""
    recent = last_seconds(logs, days * 86400, as_of).filter(is_error())
    return recent.groupBy(
        F.hour("timestamp").cast("long").alias("hour"),
        X.day_of_week(F.col("timestamp")).cast("long").alias("day"),
    ).agg(F.count("*").alias("count"))


def incidents_by_status(incidents: DataFrame) -> DataFrame:
    """Incidents per status (A5)."""
    return incidents.groupBy("status").agg(F.count("*").alias("n"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Total and firing alerts."""
    return alerts.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "firing").alias("firing_count")
    )


def incident_counts(incidents: DataFrame) -> DataFrame:
    """Total, open and critical incidents (A10)."""
    return incidents.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
    )


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side, without a cross join.

    Columns are disjoint, so the maximum over the stacked rows is the only value.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, one row each."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_snapshot(
    logs: DataFrame, incidents: DataFrame, clusters: DataFrame, alerts: DataFrame,
    queue_size: DataFrame, as_of: Column | None = None,
) -> DataFrame:
    """The dashboard's one-row snapshot.

    ``queue_size`` is a one-row frame.  The log table is aggregated in one pass;
    processing latency is measured by the caller and reported as 0 here.
    """
    end = newest(logs) if as_of is None else as_of
    age = lambda s: F.col("timestamp") >= end - F.expr(f"INTERVAL {s} SECONDS")
    recent = age(K.ANOMALY_WINDOW_SECONDS)
    rate = F.count_if(recent & is_error()) / F.greatest(F.count_if(recent), F.lit(1))
    from_logs = logs.agg(
        F.max("timestamp").alias("timestamp"),
        F.round(F.count_if(age(K.RATE_WINDOW_SECONDS)) / F.lit(60.0), 2).alias("events_per_second"),
        F.count("*").alias("total_log_count"),
        F.round(rate, 4).alias("error_rate"),
        F.count_if("is_anomaly").alias("anomaly_count"),
    )
    from_incidents = incident_counts(incidents).toDF(
        "incident_count", "open_incident_count", "critical_incident_count"
    )
    from_clusters = clusters.agg(F.count("*").alias("cluster_count"))
    from_alerts = alerts.agg(
        F.count_if(F.col("status") == "firing").alias("firing_alert_count")
    )
    row = stack_rows([from_logs, from_incidents, from_clusters, from_alerts, queue_size])
    return row.withColumn("processing_latency_ms", F.lit(0.0))


def counter_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals by label columns."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def last_queue_depth(depths: DataFrame) -> DataFrame:
    """Newest depth per queue (A12); ties go to the larger depth."""
    last = F.max(F.struct("ts", "depth"))["depth"]
    return depths.groupBy("queue").agg(last.alias("depth"))


def latency_histogram(samples: DataFrame, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Cumulative histogram of ``seconds`` per ``stage``.

    One pass counts all edges as columns; only the few result rows are exploded.
    """
    edges = K.LATENCY_EDGES if edges is None else edges
    bounds = sorted({float(e) for es in edges.values() for e in es})
    total = F.count("seconds")
    counted = samples.groupBy("stage").agg(
        F.array(*[F.count_if(F.col("seconds") <= e) for e in bounds]).alias("counts"),
        total.alias("n"),
        F.sum("seconds").alias("sum"),
    )
    per_stage = F.create_map(*[
        x for stage, es in edges.items()
        for x in (F.lit(stage), F.array(*[F.lit(float(e)) for e in es]))
    ])
    own = F.try_element_at(per_stage, F.col("stage"))
    bound_of = F.array(*[F.lit(b) for b in bounds])
    finite = F.transform(own, lambda e: F.struct(
        F.format_string("%.2f", e).alias("le"),
        F.element_at(F.col("counts"), F.array_position(bound_of, e).cast("int")).alias("bucket_count"),
    ))
    infinite = F.array(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("bucket_count")))
    return counted.select(
        "stage", F.explode(F.concat(finite, infinite)).alias("b"), "sum", F.col("n").alias("count")
    ).select("stage", "b.le", "b.bucket_count", "sum", "count")


def events_timeline(
    logs: DataFrame, seconds: int = K.TIMELINE_BUCKET_SECONDS, buckets: int | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Events and errors per tumbling bucket; optionally only the last buckets."""
    if buckets is not None:
        logs = last_seconds(logs, seconds * buckets, as_of)
    return logs.groupBy(window_start("timestamp", seconds).alias("bucket")).agg(
        F.count("*").alias("events"), F.count_if(is_error()).alias("errors")
    )


# Distinct values of a window that one task may gather, and bins into which larger ranges of values are counted.
GATHERED_VALUES, VALUE_BINS = 1_000_000, 1024


def latency_percentiles(samples: DataFrame, seconds: int, exact: bool = True) -> DataFrame:
    """p50/p95/p99 of ``ms`` per window.

    Exact: equal values are counted first.  A window of at most ``GATHERED_VALUES``
    distinct values is settled by one task; in larger ones the ranks are found by
    ``select_ranks``, so that no task ever holds a window's values.  With
    ``exact=False`` a sketch of fixed size answers in one pass.
    """
    start = window_start("ts", seconds).alias("window_start")
    ranks = (0.5, 0.95, 0.99)
    columns = ("p50_ms", "p95_ms", "p99_ms")
    if not exact:
        out = samples.groupBy(start).agg(F.percentile_approx("ms", F.array(*map(F.lit, ranks)), 10000).alias("p"))
        return out.select("window_start", *[F.col("p")[i].alias(n) for i, n in enumerate(columns)])
    samples = samples.filter(F.col("ms").isNotNull())
    counted = cut_lineage(samples.groupBy(start, F.col("ms").cast("double").alias("ms")).agg(F.count("*").alias("n")))
    sizes = counted.groupBy("window_start").agg(F.count("*").alias("_values"))
    large = cut_lineage(sizes.filter(F.col("_values") > GATHERED_VALUES).select("window_start"))
    any_large = not large.isEmpty()
    small = counted.join(large, "window_start", "left_anti") if any_large else counted
    gathered = small.groupBy("window_start").agg(F.percentile("ms", F.array(*map(F.lit, ranks)), F.col("n")).alias("p"))
    out = gathered.select("window_start", *[F.col("p")[i].alias(n) for i, n in enumerate(columns)])
    if not any_large:
        return out
    found = percentiles_by_selection(counted.join(large, "window_start", "left_semi"), ranks)
    one = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in zip(ranks, columns, strict=True)]
    return out.unionByName(found.groupBy("window_start").agg(*one))


def percentiles_by_selection(counted: DataFrame, ranks: tuple[float, ...]) -> DataFrame:
    """``window_start``, ``p``, ``value``: interpolated percentiles of counted values ``ms``, ``n``."""
    totals = counted.groupBy("window_start").agg(F.sum("n").alias("total"))
    wanted = totals.select("window_start", "total", F.explode(F.array(*map(F.lit, ranks))).alias("p"))
    place = F.col("p") * (F.col("total") - 1)
    wanted = wanted.select("window_start", "p", place.alias("place"), F.explode(F.array_distinct(
        F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    found = select_ranks(counted, wanted.select("window_start", "rank").distinct())
    share = F.when(F.col("rank") == F.floor("place"), 1 - (F.col("place") - F.col("rank"))).otherwise(F.col("place") - F.floor("place"))
    return wanted.join(found, ["window_start", "rank"]).groupBy("window_start", "p").agg(F.sum(share * F.col("ms")).alias("value"))


def select_ranks(counted: DataFrame, wanted: DataFrame, bins: int = VALUE_BINS) -> DataFrame:
    """``window_start``, ``rank``, ``ms``: the value of each wanted rank, counted from 0.

    The range that holds a rank is cut into ``bins``, whose rows are counted with
    their least and greatest value; the bin that holds the rank is the next range,
    until it is a single value.  A window sends at most ``bins`` rows per task.
    """
    edges = counted.groupBy("window_start").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    open_ = cut_lineage(wanted.join(edges, "window_start").withColumn("below", F.lit(0).cast("long")))
    done = None
    while True:
        settled = open_.filter("low = high").select("window_start", "rank", F.col("low").alias("ms"))
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.filter("low < high")
        if open_.isEmpty():
            return done
        ranges = open_.select("window_start", "low", "high", "below").distinct()
        # rounding keeps the order of values; the least and greatest are in different bins, so every range shrinks
        half = (F.col("ms") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inner = F.greatest(F.least(F.coalesce(F.floor(F.nanvl(half, F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1)), F.lit(0))
        at = F.when(F.col("ms") == F.col("low"), 0).when(F.col("ms") == F.col("high"), bins - 1).otherwise(inner)
        inside = counted.join(ranges, "window_start").filter("ms >= low AND ms <= high")
        cut = inside.groupBy("window_start", "low", "high", "below", at.alias("bin")).agg(
            F.sum("n").alias("rows"), F.min("ms").alias("least"), F.max("ms").alias("most"))
        order = Window.partitionBy("window_start", "low", "high").orderBy("bin")  # at most ``bins`` rows
        cut = cut.withColumn("before", F.col("below") + F.sum("rows").over(order) - F.col("rows"))
        cut = cut.drop("below")
        open_ = cut_lineage(
            open_.select("window_start", "rank", "low", "high").join(cut, ["window_start", "low", "high"])
            .filter("rank >= before AND rank < before + rows")
            .select("window_start", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("before").alias("below")))


def latency_sketches(samples: DataFrame, seconds: int) -> DataFrame:
    """A mergeable sketch of ``ms`` per window, from which longer windows are rolled up."""
    return samples.groupBy(window_start("ts", seconds).alias("window_start")).agg(
        F.kll_sketch_agg_double(F.col("ms").cast("double")).alias("sketch"), F.count("ms").alias("n"))


def rolled_up_percentiles(sketches: DataFrame, seconds: int) -> DataFrame:
    """Approximate p50/p95/p99 of longer windows, from sketches and not from samples."""
    merged = sketches.groupBy(window_start("window_start", seconds).alias("window_start")).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select("window_start", "n", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(c) for p, c in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))])


def running_totals(batches: DataFrame, order: str, value: str) -> DataFrame:
    """Running total of a per-batch counter.

    A prefix sum in two levels: within each day in parallel, plus the total of all
    earlier days.  The only unpartitioned step sees one row per calendar day.
    """
    dated = batches.withColumn("_day", F.to_date(order))
    days = dated.groupBy("_day").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_day", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dated.join(carried, "_day")
    total = F.sum(value).over(inside) + F.col("_carry")
    return joined.withColumn("running_total", total).drop("_day", "_carry")


def feed_stats(logs: DataFrame) -> DataFrame:
    """Entries, errors and anomalies of a feed."""
    return logs.agg(
        F.count("*").alias("entries"),
        F.count_if(is_error()).alias("errors"),
        F.count_if("is_anomaly").alias("anomalies"),
    )
