"""Severity, names, anomaly flags and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.functions.parsing import any_of, contains_any
from logharbor.operators.lookups import first_per_group, join_ranked
from logharbor.operators.metrics import is_error, window_start
from logharbor.session import cut_lineage


# ---------------------------------------------------------------- severity and names

def message_rank(message: Column) -> Column:
    """Severity rank 1..4 of one message by keyword; low when nothing hits.

    The rank of a cluster is the maximum over its messages, so it combines
    map-side and no message list is ever concatenated.  Keywords are substrings.
    """
    rank = F.lit(1)
    for name, words in reversed(K.SEVERITY_WORDS):
        level = K.SEVERITIES.index(name) + 1
        rank = F.when(contains_any(message, words), F.lit(level)).otherwise(rank)
    return rank


def rule_name(joined: Column) -> Column:
    """Name of the first keyword rule that hits, else null (R2)."""
    name = F.lit(None).cast("string")
    for title, words in reversed(K.CLUSTER_NAMES):
        name = F.when(contains_any(joined, words), F.lit(title)).otherwise(name)
    return name


def cluster_names(first_messages: DataFrame, group: str = "cluster_id") -> DataFrame:
    """Name per group from its ranked first messages.

    Without a rule hit the most frequent word of more than four letters names the
    group; ties go to the first word in the alphabet.
    """
    text = join_ranked(first_messages, group, "message", " ")
    text = text.withColumn("message", F.lower("message"))
    words = (
        text.select(group, F.explode(F.split("message", r"\s+")).alias("word"))
        .filter(F.length("word") > 4)
        .groupBy(group, "word").agg(F.count("*").alias("n"))
    )
    best = words.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), "word"))["word"].alias("word"))
    fallback = F.concat(F.initcap("word"), F.lit(" Events"))
    return text.join(best, group, "left").select(
        group,
        F.coalesce(rule_name(F.col("message")), fallback, F.lit(K.UNNAMED_CLUSTER)).alias("name"),
    )


# ---------------------------------------------------------------- spikes and anomalies

def window_rates(logs: DataFrame, seconds: int = K.ANOMALY_WINDOW_SECONDS) -> DataFrame:
    """Total, errors and error rate per tumbling window."""
    return logs.groupBy(window_start("timestamp", seconds).alias("window_start")).agg(
        F.count("*").alias("total"), F.count_if(is_error()).alias("errors")
    ).withColumn("error_rate", F.col("errors") / F.col("total"))


def with_spikes(rates: DataFrame, above: float = K.SPIKE_RATE) -> DataFrame:
    """Window is a spike when its error rate exceeds the limit."""
    return rates.withColumn("is_spike", F.col("error_rate") > above)


def anomaly_score(message: Column, level: Column, is_spike: Column) -> Column:
    """Score of one row; 0 when no rule hits."""
    spike = F.coalesce(is_spike, F.lit(False))
    return (
        F.when(contains_any(message, K.CRITICAL_PHRASES), F.lit(K.PHRASE_SCORE))
        .when(level.isin(K.ERROR_LEVELS) & spike, F.lit(K.ERROR_SPIKE_SCORE))
        .when((level == "WARNING") & spike, F.lit(K.WARNING_SPIKE_SCORE))
        .otherwise(F.lit(0.0))
    )


def flag_anomalies(
    logs: DataFrame, seconds: int = K.ANOMALY_WINDOW_SECONDS, rates: DataFrame | None = None
) -> DataFrame:
    """Logs with ``is_anomaly`` and ``anomaly_score``.

    The rates are written first: one row per window, whose size is then known, so
    the planner broadcasts them while they are small and the logs are not shuffled.
    Larger rates mean a sort-merge join whose hot window AQE splits.
    """
    rates = cut_lineage(window_rates(logs, seconds)) if rates is None else rates
    # a key that cannot be null keeps Spark from pushing a null check of the parsed
    # time below the parser, which would parse each line twice
    key = F.coalesce("window_start", F.timestamp_seconds(F.lit(0)))
    spikes = with_spikes(rates).select(key.alias("_w"), "is_spike")
    scored = (
        logs.drop("is_anomaly", "anomaly_score")
        .withColumn("_w", window_start("timestamp", seconds))
        .join(spikes, "_w", "left")
        .withColumn("_s", anomaly_score(F.col("message"), F.col("level"), F.col("is_spike")))
    )
    flagged = F.col("_s") > K.FLAG_ABOVE
    return scored.withColumns({
        "is_anomaly": flagged, "anomaly_score": F.when(flagged, F.col("_s")),
    }).drop("_w", "_s", "is_spike")


def anomaly_counts(logs: DataFrame, seconds: int = K.ANOMALY_WINDOW_SECONDS) -> DataFrame:
    """Rows and anomalies per window and level in one pass over the logs.

    A score depends only on the level, a phrase hit and the window, so rows are
    counted by these first; window rates come from the few counted rows.
    """
    phrase = contains_any(F.col("message"), K.CRITICAL_PHRASES)
    counted = logs.groupBy(
        window_start("timestamp", seconds).alias("window_start"), "level", phrase.alias("phrase")
    ).agg(F.count("*").alias("n"))
    window = Window.partitionBy("window_start")  # at most two rows per level
    errors = F.sum(F.when(is_error(), F.col("n")).otherwise(0)).over(window)
    spiking = counted.withColumn("is_spike", errors / F.sum("n").over(window) > K.SPIKE_RATE)
    spike_level = F.col("level").isin(*K.ERROR_LEVELS, "WARNING")
    flagged = F.col("phrase") | (F.col("is_spike") & spike_level)
    return spiking.groupBy("window_start", "level").agg(
        F.sum("n").alias("n"), F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("anomalies")
    )


def baseline_spikes(
    rates: DataFrame, seconds: int, back: int, factor: float = K.SPIKE_FACTOR
) -> DataFrame:
    """Windows whose rate exceeds ``factor`` times the mean of the ``back`` slots before.

    Each window adds its rate to the ``back`` slots after it, so the baseline is
    one combined aggregation instead of a global sort in one task.
    """
    shifts = [
        F.col("window_start") + F.expr(f"INTERVAL {seconds * i} SECONDS") for i in range(1, back + 1)
    ]
    baseline = (
        rates.select(F.explode(F.array(*shifts)).alias("window_start"), F.col("error_rate").alias("_r"))
        .groupBy("window_start").agg(F.avg("_r").alias("baseline"))
    )
    return rates.join(baseline, "window_start", "left").withColumn(
        "is_spike", F.coalesce(F.col("error_rate") > factor * F.col("baseline"), F.lit(False))
    )


def isolated(logs: DataFrame, clustered: DataFrame) -> DataFrame:
    """Logs that belong to no cluster."""
    return logs.join(clustered.select("id"), "id", "left_anti")


# ---------------------------------------------------------------- alerts

def redis_failures() -> Column:
    """Error rows of a service with ``redis`` in its name."""
    return F.count_if(F.lower("service").contains("redis") & is_error())


def reconnects() -> Column:
    """Messages about reconnects or disconnects."""
    return F.count_if(F.lower("message").rlike(any_of(K.RECONNECT_WORDS)))


def rule_measures(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Value of each log-based rule per batch or window, one row per rule."""
    counted = logs.groupBy(*keys).agg(redis_failures().alias("a"), reconnects().alias("b"))
    names = [K.ALERT_RULES[0][0], K.ALERT_RULES[1][0]]
    return counted.select(
        *keys, F.expr(f"stack(2, '{names[0]}', a, '{names[1]}', b) AS (alert_type, actual)")
    )


def queue_measures(depths: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest backlog per window for the saturation rule."""
    peak = depths.groupBy(*keys).agg(F.max("depth").alias("actual"))
    return peak.withColumn("alert_type", F.lit(K.ALERT_RULES[2][0])).select(*keys, "alert_type", "actual")


def alert_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as an inline table; callers may pass their own."""
    rows = ", ".join(
        f"('{kind}', '{title}', '{severity}', {limit}L, '{message}')"
        for kind, title, severity, limit, message in K.ALERT_RULES
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS r(alert_type, title, severity, threshold, template)"
    )


def threshold_alerts(
    measures: DataFrame, rules: DataFrame, fired_at: str, keep: list[str] | None = None
) -> DataFrame:
    """One firing alert per measure that reaches its rule's threshold.

    ``measures`` has alert_type, actual and the ``fired_at`` column; ``keep`` names
    further key columns, which also enter the alert's id.
    """
    keep = keep or []
    hits = measures.join(rules, "alert_type").filter(F.col("actual") >= F.col("threshold"))
    message = F.replace("template", F.lit("{actual}"), F.col("actual").cast("string"))
    message = F.replace(message, F.lit("{threshold}"), F.col("threshold").cast("string"))
    return hits.select(
        X.row_id(F.col("alert_type"), X.iso_text(F.col(fired_at)), *[F.col(c) for c in keep]).alias("id"),
        F.lit(None).cast("string").alias("incident_id"),
        "alert_type", "title", message.alias("message"), "severity",
        F.lit("firing").alias("status"),
        F.col("threshold").cast("double").alias("threshold_value"),
        F.col("actual").cast("double").alias("actual_value"),
        F.col(fired_at).alias("fired_at"),
        *keep,
    )
