"""Alerts (B15-B17). Declared by the source without code; rules are ours.

Threshold rules are a small table ``(rule_id, subject_type, metric, op,
threshold, severity)`` (bounded by the number of configured rules, broadcast).
Metrics arrive wide, one row per subject, and are melted with ``unpivot`` so
one equi-join on (subject_type, metric) evaluates every rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import money_sum
from fleetlens.plans.joins import join_dimension

# Comparison operators understood by the rules.
OPS = (">=", ">", "<=", "<", "==")


def melt_metrics(df: DataFrame, subject_type: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """Wide metrics -> (subject_type, subject_key, metric, value)."""
    cast = df.select(F.col(key).cast("string").alias("subject_key"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot("subject_key", list(metrics), "metric", "value").withColumn("subject_type", F.lit(subject_type))


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (subject, rule) whose metric satisfies the rule; ``>=``
    fires at equality (T10). NULL metrics never fire."""
    j = join_dimension(metrics, rules, ["subject_type", "metric"], "inner")
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    fires = (
        F.when(op == ">=", v >= t)
        .when(op == ">", v > t)
        .when(op == "<=", v <= t)
        .when(op == "<", v < t)
        .when(op == "==", v == t)
        .otherwise(F.lit(False))
    )
    return j.where(F.coalesce(fires, F.lit(False))).select(
        "rule_id", "severity", "subject_type", "subject_key", "metric", "value", "threshold", "op"
    )


def daily_job_cost(costed: DataFrame) -> DataFrame:
    """Cost per (job, UTC day of start); runs without a start are skipped."""
    return (
        costed.where(F.col("start_time").isNotNull())
        .groupBy("job_id", F.to_date(F.timestamp_millis("start_time")).alias("day"))
        .agg(money_sum("estimated_cost").alias("cost"))
    )


def cost_anomalies(daily: DataFrame, trailing: int = 7, k: float = 2.0, min_history: int = 3) -> DataFrame:
    """A (job, day) whose cost is at least ``k`` sample stddevs away from
    the mean of the job's ``trailing`` previous active days (>= ``min_history``
    of them). The window runs over the job-day grain table."""
    w = Window.partitionBy("job_id").orderBy("day").rowsBetween(-trailing, -1)
    s = daily.select(
        "job_id", "day", "cost",
        F.avg("cost").over(w).alias("baseline"),
        F.stddev_samp("cost").over(w).alias("baseline_stddev"),
        F.count("cost").over(w).alias("history"),
    )
    dev = F.abs(F.col("cost") - F.col("baseline"))
    return s.where(
        (F.col("history") >= min_history) & (F.col("baseline_stddev") > 0) & (dev >= F.lit(float(k)) * F.col("baseline_stddev"))
    ).withColumn("z", dev / F.col("baseline_stddev"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Number of alerts per severity."""
    return alerts.groupBy("severity").agg(F.count("*").alias("alert_count"))
