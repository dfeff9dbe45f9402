"""Rule-based cost insights (N1-N6) over the ranked summaries.

Each rule reads the top-N of one ranking (a bounded TakeOrdered), renders
its message with JVM string functions, and the rules are concatenated with
explicit ordinal columns (group, rank, sub) so the output order is defined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import money_text, percent_text
from fleetlens.operators.costing import CostConfig
from fleetlens.operators.summaries import rank_jobs, rank_named

# Insight kinds and subject types.
KIND_EXPENSIVE_JOB = "expensive_job"
KIND_DOMINANT_SHARE = "dominant_cost_share"
KIND_EXPENSIVE_PIPELINE = "expensive_pipeline"
KIND_EXPENSIVE_TABLE = "expensive_table"
SUBJECT_TYPES = ("job", "pipeline", "table")


# The message of each kind of insight.
MESSAGES = {
    KIND_EXPENSIVE_JOB: "Job '{name}' accounts for {share} of total cost with {total} {currency}.",
    KIND_DOMINANT_SHARE: "Job '{name}' exceeds the configured cost share threshold at {share} of total spend.",
    KIND_EXPENSIVE_PIPELINE: "Pipeline '{name}' accounts for {share} of total cost with {total} {currency}.",
    KIND_EXPENSIVE_TABLE: "Table '{name}' costs {total} {currency} per day to maintain in this window.",
}


def _message(kind: str, **values: Column) -> Column:
    """The kind's message with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[kind])
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]).alias("message")


def _with_rank(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` with their 0-based rank; the window runs
    over at most ``n`` rows (after the TakeOrdered limit)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)


def job_insights(job_summaries: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """N1 + N2: one expensive_job row per top job, followed by a
    dominant_cost_share row when its share is >= the threshold."""
    top = _with_rank(job_summaries, rank_jobs(job_summaries), cfg.top_n_insights)
    name, share, total, cur = F.col("job_name"), F.col("cost_share"), F.col("total_cost"), F.col("currency")
    expensive = F.struct(
        F.lit(KIND_EXPENSIVE_JOB).alias("kind"),
        _message(KIND_EXPENSIVE_JOB, name=name, share=percent_text(share), total=money_text(total), currency=cur),
        total.alias("metric_value"),
        F.lit(0).alias("sub"),
    )
    dominant = F.struct(
        F.lit(KIND_DOMINANT_SHARE).alias("kind"),
        _message(KIND_DOMINANT_SHARE, name=name, share=percent_text(share)),
        share.alias("metric_value"),
        F.lit(1).alias("sub"),
    )
    rows = F.when(share >= F.lit(float(cfg.expensive_job_share_threshold)), F.array(expensive, dominant)).otherwise(
        F.array(expensive)
    )
    return top.select(
        F.lit(0).alias("_group"),
        "_rank",
        F.lit("job").alias("subject_type"),
        F.col("job_id").cast("string").alias("subject_key"),
        cur.alias("currency"),
        F.inline(rows),
    )


def pipeline_insights(pipeline_summaries: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """expensive_pipeline for each of the top pipelines."""
    top = _with_rank(pipeline_summaries, rank_named(), cfg.top_n_insights)
    return top.select(
        F.lit(1).alias("_group"),
        "_rank",
        F.lit("pipeline").alias("subject_type"),
        F.col("key").alias("subject_key"),
        F.col("currency"),
        F.lit(KIND_EXPENSIVE_PIPELINE).alias("kind"),
        _message(
            KIND_EXPENSIVE_PIPELINE,
            name=F.col("label"), share=percent_text("cost_share"), total=money_text("total_cost"), currency=F.col("currency"),
        ),
        F.col("total_cost").alias("metric_value"),
        F.lit(0).alias("sub"),
    )


def table_insights(table_summaries: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """expensive_table (cost per day) for each of the top tables."""
    top = _with_rank(table_summaries, rank_named(), cfg.top_n_dataset_insights)
    return top.select(
        F.lit(2).alias("_group"),
        "_rank",
        F.lit("table").alias("subject_type"),
        F.col("key").alias("subject_key"),
        F.col("currency"),
        F.lit(KIND_EXPENSIVE_TABLE).alias("kind"),
        _message(KIND_EXPENSIVE_TABLE, name=F.col("label"), total=money_text("cost_per_day"), currency=F.col("currency")),
        F.col("cost_per_day").alias("metric_value"),
        F.lit(0).alias("sub"),
    )


def all_insights(
    job_summaries: DataFrame,
    pipeline_summaries: DataFrame,
    table_summaries: DataFrame,
    total: Column,
    cfg: CostConfig = CostConfig(),
) -> DataFrame:
    """Jobs (N1/N2 interleaved), then pipelines, then tables; nothing at
    all when the total cost is not positive. ``total`` is a scalar column
    (e.g. a scalar subquery). Adds ``position`` (0-based output order)."""
    parts = (
        job_insights(job_summaries, cfg)
        .unionByName(pipeline_insights(pipeline_summaries, cfg))
        .unionByName(table_insights(table_summaries, cfg))
        .where(total > F.lit(0.0))
    )
    # At most 2*top_n + 2*top_n rows reach this window.
    pos = F.row_number().over(Window.orderBy("_group", "_rank", "sub")) - 1
    return parts.select(
        "kind", "subject_type", "subject_key", "message", "metric_value", "currency", pos.alias("position")
    )


def filter_insights(insights: DataFrame, subject_type: str) -> DataFrame:
    """Insights of one subject type."""
    if subject_type not in SUBJECT_TYPES:
        raise ValueError(f"subject_type must be one of {SUBJECT_TYPES}")
    return insights.where(F.col("subject_type") == subject_type)
