"""Aggregations and rankings over costed runs.

Every summary aggregates first (partial, map-side: a hot job or key is
pre-reduced per task before the shuffle) and derives its grand total and
report currency from that same aggregate through a scalar subquery, so the
costed runs are scanned once and no run-grain data goes through a single
partition or a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import from_units, money_sum, money_units, py_round, utc_day
from fleetlens.operators.attribution import explode_costs
from fleetlens.operators.costing import CostConfig
from fleetlens.plans.joins import join_dimension
from fleetlens.session import shared_folder

_LONG_MAX = 9_223_372_036_854_775_807


def load_key(start: Column | str = "start_time") -> Column:
    """Long ordering key: greater = earlier in load order (start desc, NULL starts last)."""
    start = F.col(start) if isinstance(start, str) else start
    return F.coalesce(start, F.lit(-_LONG_MAX - 1))


def _first_run() -> Column:
    """Orders runs by load; the report currency is that of the greatest, ties by
    currency text. The currency is a grouping key of the first aggregation (its
    buffers then are fixed-width and hash-aggregated), resolved by ``_regroup``."""
    return F.max(load_key()).alias("first_order")


def _regroup(agg: DataFrame, keys: list[str], last: str) -> DataFrame:
    """One row per key from an aggregate that is also grouped by currency."""
    return agg.groupBy(*keys).agg(
        F.sum("cost_units").alias("cost_units"),
        F.sum("run_count").alias("run_count"),
        F.max(last).alias(last),
        F.max(F.struct("first_order", "currency")).alias("first"),
    ).withColumn("total_cost", from_units("cost_units"))


def materialize(agg: DataFrame) -> DataFrame:
    """Write a key-grain aggregate as Parquet into a new folder under the
    shared checkpoint directory (``spark.checkpoint.dir``) and read it back; the
    folder is deleted when the application ends.

    The grand total and the shares are then both read from the written
    aggregate: the costed runs are scanned once, and a lost executor re-reads
    the small files instead of recomputing the costing. (A scalar subquery
    over the unwritten aggregate is planned separately by AQE and re-runs the
    whole scan; ``checkpoint(eager=True)`` without a cache computes the plan
    twice, once for its count and once for the write.)"""
    spark = agg.sparkSession
    path = shared_folder(spark, "agg")
    agg.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def _totals(agg: DataFrame, default_currency: str) -> Column:
    """Scalar subquery over a (materialised) aggregate: struct(total, currency)."""
    return agg.agg(
        F.struct(
            F.coalesce(from_units(F.sum("cost_units")), F.lit(0.0)).alias("total"),
            F.coalesce(F.max(F.struct("first_order", "currency"))["currency"], F.lit(default_currency)).alias("currency"),
        ).alias("t")
    ).scalar()


def grand_total(costed: DataFrame) -> Column:
    """Total cost of the costed runs as a scalar (from a materialised per-job
    aggregate, so it costs one small read)."""
    return materialize(job_aggregate(costed)).agg(F.coalesce(from_units(F.sum("cost_units")), F.lit(0.0))).scalar()


def _share(total: Column, grand: Column) -> Column:
    return F.when(grand != 0, total / grand).otherwise(F.lit(0.0))


# ------------------------------------------------------------------- by job


def job_aggregate(costed: DataFrame) -> DataFrame:
    """G3 accumulate: per job and currency total, count, last start, first run."""
    return costed.groupBy("job_id", "currency").agg(
        F.sum(money_units("estimated_cost")).alias("cost_units"),
        F.count("*").alias("run_count"),
        F.max("start_time").alias("last_run_time"),
        _first_run(),
    )


def job_summaries(costed: DataFrame, jobs: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """G3 + C12: job_id, job_name, currency, total_cost, cost_share, run_count,
    avg_cost_per_run, last_run_time (raw doubles). Names are joined after the
    aggregation, at job grain."""
    return job_summaries_from(materialize(job_aggregate(costed)), jobs, cfg)


def job_summaries_from(agg: DataFrame, jobs: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """G3 from a materialised per-job aggregate (``job_aggregate`` shape)."""
    t = _totals(agg, cfg.currency)
    agg = _regroup(agg, ["job_id"], "last_run_time")
    names = jobs.select("job_id", F.col("name").alias("_name"))
    named = join_dimension(agg, names, "job_id", "left", max_broadcast_rows=cfg.max_broadcast_rows)
    return named.select(
        "job_id",
        F.coalesce(F.col("_name"), F.concat(F.lit("job-"), F.col("job_id").cast("string"))).alias("job_name"),
        t["currency"].alias("currency"),
        "total_cost",
        _share(F.col("total_cost"), t["total"]).alias("cost_share"),
        "run_count",
        (F.col("total_cost") / F.col("run_count")).alias("avg_cost_per_run"),
        "last_run_time",
    )


def rank_jobs(summaries: DataFrame) -> list[Column]:
    """K2 order: total desc, ties by latest run then job id (deterministic)."""
    return [F.desc("total_cost"), F.desc_nulls_last("last_run_time"), F.asc("job_id")]


def present_jobs(summaries: DataFrame) -> DataFrame:
    """Output edge rounding of the job payload (2 dp money, 4 dp share)."""
    return summaries.select(
        "job_id",
        "job_name",
        py_round("total_cost", 2).alias("total_cost"),
        py_round("cost_share", 4).alias("cost_share"),
        "run_count",
        py_round("avg_cost_per_run", 2).alias("avg_cost_per_run"),
        "last_run_time",
    )


def top_jobs(summaries: DataFrame, n: int = 10) -> DataFrame:
    """K2/K6: the ``n`` most expensive jobs (a top-k report)."""
    return present_jobs(summaries.orderBy(*rank_jobs(summaries)).limit(n))


# ------------------------------------------------------- by pipeline / table


def named_aggregate(costed: DataFrame, keys_col: str) -> DataFrame:
    """G4/G5 accumulate over exploded keys; the NULL key holds untagged runs."""
    return explode_costs(costed, keys_col, keep_untagged=True).groupBy("key", "currency").agg(
        F.sum(money_units("share")).alias("cost_units"),
        F.count("*").alias("run_count"),
        F.max("start_time").alias("last_seen_time"),
        _first_run(),
    )


def named_summaries(
    costed: DataFrame, keys_col: str, window_days: int | None, cfg: CostConfig = CostConfig()
) -> DataFrame:
    """G4 (pipeline_keys) / G5 (table_keys): key, label, currency, total_cost,
    cost_share (vs. the grand total of all costed runs), run_count,
    avg_cost_per_run, cost_per_day, attribution_count, last_seen_time."""
    return named_summaries_from(materialize(named_aggregate(costed, keys_col)), window_days, cfg)


def named_summaries_from(agg: DataFrame, window_days: int | None, cfg: CostConfig = CostConfig()) -> DataFrame:
    """G4/G5 from a materialised key aggregate (``named_aggregate`` shape,
    including the NULL key of untagged runs)."""
    t = _totals(agg, cfg.currency)
    agg = _regroup(agg, ["key"], "last_seen_time")
    days = float(max(1, window_days or 1))
    return agg.where(F.col("key").isNotNull()).select(
        "key",
        F.col("key").alias("label"),
        t["currency"].alias("currency"),
        "total_cost",
        _share(F.col("total_cost"), t["total"]).alias("cost_share"),
        "run_count",
        (F.col("total_cost") / F.col("run_count")).alias("avg_cost_per_run"),
        (F.col("total_cost") / F.lit(days)).alias("cost_per_day"),
        F.col("run_count").alias("attribution_count"),
        "last_seen_time",
    )


def rank_named() -> list[Column]:
    """K3 order: total desc, ties by last seen then key."""
    return [F.desc("total_cost"), F.desc_nulls_last("last_seen_time"), F.asc("key")]


def present_named(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "key",
        "label",
        py_round("total_cost", 2).alias("total_cost"),
        py_round("cost_share", 4).alias("cost_share"),
        "run_count",
        py_round("avg_cost_per_run", 2).alias("avg_cost_per_run"),
        py_round("cost_per_day", 2).alias("cost_per_day"),
        "attribution_count",
        "last_seen_time",
    )


def top_named(summaries: DataFrame, n: int = 8) -> DataFrame:
    """K3/K6: the ``n`` most expensive pipelines or tables."""
    return present_named(summaries.orderBy(*rank_named()).limit(n))


# -------------------------------------------------- fused (one pass, all three)

DIM_JOB, DIM_PIPELINE, DIM_TABLE = "job", "pipeline", "table"


def fused_aggregate(costed: DataFrame) -> DataFrame:
    """G3 + G4 + G5 accumulated in one pass over the costed runs.

    Each run becomes one ``job`` row, one ``pipeline`` row per pipeline key
    and one ``table`` row per table key (a run without keys gives one row
    with a NULL key and its full cost, so each dimension also carries the
    grand total). The rows come from one ``posexplode`` of a flat key array
    (slot 0 = the job, then pipeline keys, then table keys) and plain column
    expressions, so the per-row work stays in generated code. One partial
    (map-side) hash aggregation on (dim, job_id, key) then replaces three
    scans. Split the result with :func:`fused_part`."""
    n_p, n_t = F.size("pipeline_keys"), F.size("table_keys")
    none = F.array(F.lit(None).cast("string"))
    slots = F.concat(
        none,
        F.when(n_p > 0, F.col("pipeline_keys")).otherwise(none),
        F.when(n_t > 0, F.col("table_keys")).otherwise(none),
    )
    exploded = costed.select(
        "job_id", "start_time", "currency", "estimated_cost",
        F.greatest(n_p, F.lit(1)).alias("_np"), F.greatest(n_t, F.lit(1)).alias("_nt"),
        F.posexplode(slots).alias("_pos", "key"),
    )
    pos, cost = F.col("_pos"), F.col("estimated_cost")
    in_pipeline = pos <= F.col("_np")
    rows = exploded.select(
        F.when(pos == 0, F.lit(DIM_JOB)).when(in_pipeline, F.lit(DIM_PIPELINE)).otherwise(F.lit(DIM_TABLE)).alias("dim"),
        F.when(pos == 0, F.col("job_id")).alias("job_id"),
        "key",
        F.when(pos == 0, cost).when(in_pipeline, cost / F.col("_np")).otherwise(cost / F.col("_nt")).alias("share"),
        "start_time",
        "currency",
    )
    return rows.groupBy("dim", "job_id", "key", "currency").agg(
        F.sum(money_units("share")).alias("cost_units"),
        F.count("*").alias("run_count"),
        F.max("start_time").alias("last_time"),
        _first_run(),
    )


def fused_part(fused: DataFrame, dim: str) -> DataFrame:
    """One dimension of :func:`fused_aggregate`, in the shape of
    ``job_aggregate`` (dim 'job') or ``named_aggregate`` (others)."""
    part = fused.where(F.col("dim") == dim)
    common = ["cost_units", "run_count", "currency", "first_order"]
    if dim == DIM_JOB:
        return part.select("job_id", F.col("last_time").alias("last_run_time"), *common)
    return part.select("key", F.col("last_time").alias("last_seen_time"), *common)


# ------------------------------------------------------------ report level


def total_cost(costed: DataFrame, cfg: CostConfig = CostConfig()) -> DataFrame:
    """G1 + G2: one row (currency, total_cost, run_count); zero state when empty."""
    return costed.agg(
        F.coalesce(F.max(F.struct(load_key().alias("o"), "currency"))["currency"], F.lit(cfg.currency)).alias("currency"),
        F.coalesce(money_sum("estimated_cost"), F.lit(0.0)).alias("total_cost"),
        F.count("*").alias("run_count"),
        F.count_distinct("currency").alias("currency_count"),
    )


def cost_over_time(costed: DataFrame) -> DataFrame:
    """Per UTC day of start (NULL starts skipped): date, total_cost (2 dp), run_count."""
    return (
        costed.where(F.col("start_time").isNotNull())
        .groupBy(utc_day("start_time").alias("date"))
        .agg(money_sum("estimated_cost").alias("total_cost"), F.count("*").alias("run_count"))
        .select("date", py_round("total_cost", 2).alias("total_cost"), "run_count")
        .orderBy("date")
    )


def summary_kpis(
    costed: DataFrame,
    jobs: DataFrame,
    window_days: int,
    cfg: CostConfig = CostConfig(),
    last_sync_at: str | None = None,
    fused: DataFrame | None = None,
) -> DataFrame:
    """One row of headline numbers (zero state when nothing is costed).
    All of it comes from one materialised fused aggregate (one pass)."""
    fused = fused if fused is not None else materialize(fused_aggregate(costed))
    fused = _regroup(fused, ["dim", "job_id", "key"], "last_time")
    dim, key = F.col("dim"), F.col("key")
    is_job = dim == DIM_JOB

    def rank_key(label_tie: Column) -> Column:
        # min of (total desc, last seen desc with NULL last, label/id asc) == first in K2/K3 order
        last = F.when(F.col("last_time").isNull(), F.lit(_LONG_MAX)).otherwise(-F.col("last_time"))
        return F.struct(-F.col("total_cost"), last, label_tie)

    def top_key(d: str) -> Column:
        return F.min_by(key, F.when((dim == d) & key.isNotNull(), rank_key(key)))

    # one aggregate over the small fused table gives every headline number
    head = fused.agg(
        F.coalesce(from_units(F.sum(F.when(is_job, F.col("cost_units")))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(is_job, F.col("run_count"))), F.lit(0)).alias("run_count"),
        F.count_if(is_job).alias("job_count"),
        F.count_if((dim == DIM_PIPELINE) & key.isNotNull()).alias("pipeline_count"),
        F.count_if((dim == DIM_TABLE) & key.isNotNull()).alias("table_count"),
        F.coalesce(
            F.max(F.when(is_job, F.col("first")))["currency"],
            F.lit(cfg.currency),
        ).alias("currency"),
        F.min_by(F.col("job_id"), F.when(is_job, rank_key(F.col("job_id")))).alias("top_job_id"),
        top_key(DIM_PIPELINE).alias("most_expensive_pipeline"),
        top_key(DIM_TABLE).alias("most_expensive_table"),
    )
    names = jobs.select(F.col("job_id").alias("top_job_id"), F.col("name").alias("_name"))
    head = join_dimension(head, names, "top_job_id", "left", max_broadcast_rows=cfg.max_broadcast_rows)
    return head.select(
        F.lit(int(window_days)).alias("window_days"),
        "currency",
        py_round("total", 2).alias("total_cost"),
        "run_count",
        "job_count",
        "pipeline_count",
        "table_count",
        F.when(F.col("run_count") > 0, py_round(F.col("total") / F.col("run_count"), 2))
        .otherwise(F.lit(0.0))
        .alias("avg_cost_per_run"),
        F.when(
            F.col("top_job_id").isNotNull(),
            F.coalesce(F.col("_name"), F.concat(F.lit("job-"), F.col("top_job_id").cast("string"))),
        ).alias("most_expensive_job"),
        "most_expensive_pipeline",
        "most_expensive_table",
        F.lit(last_sync_at).cast("string").alias("last_sync_at"),
    )


def coverage(diagnosed: DataFrame, rates: DataFrame) -> DataFrame:
    """Loaded runs in the window (incl. job-less and start-less), costed,
    uncosted, and the sorted priced node types. One pass over the diagnosed runs."""
    priced = rates.agg(F.array_join(F.sort_array(F.collect_set("node_type_id")), ",")).scalar()
    return diagnosed.agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("reason").isNull()).alias("costed_runs"),
    ).select(
        "total_runs",
        "costed_runs",
        F.greatest(F.col("total_runs") - F.col("costed_runs"), F.lit(0)).alias("uncosted_runs"),
        priced.alias("priced_node_types"),
    )


def top_runs(costed: DataFrame, n: int = 20) -> DataFrame:
    """K1: most expensive runs, cost desc, ties by run id."""
    return costed.orderBy(F.desc("estimated_cost"), F.asc("run_id")).limit(n).select(
        "run_id", "job_id", "currency", "estimated_cost", "duration_ms", "billable_nodes", "hourly_rate", "source"
    )


def recent_runs(costed: DataFrame, jobs: DataFrame, n: int = 20) -> DataFrame:
    """K4: latest costed runs (start desc with missing starts as 0, ties by cost
    desc then run id), with job name. ``costed`` must carry ``run_page_url``.
    The limit runs first (TakeOrdered), the name join is on ``n`` rows."""
    if n < 0:
        raise ValueError("limit must be >= 0")
    top = costed.orderBy(
        F.desc(F.coalesce(F.col("start_time"), F.lit(0))), F.desc("estimated_cost"), F.asc("run_id")
    ).limit(n)
    names = jobs.select("job_id", F.col("name").alias("_name"))
    # names are broadcast when the job table is within the checked bound
    return join_dimension(top, names, "job_id", "left").select(
        "run_id",
        "job_id",
        F.coalesce(F.col("_name"), F.concat(F.lit("job-"), F.col("job_id").cast("string"))).alias("job_name"),
        py_round("estimated_cost", 2).alias("estimated_cost"),
        "duration_ms",
        "start_time",
        "run_page_url",
        "currency",
        "source",
    )


def cost_by_window_presets(costed: DataFrame, as_of_ms: int, presets: Sequence[int] = (7, 14, 30, 90)) -> DataFrame:
    """K7: total cost and runs for several windows in one pass (conditional sums).

    ``costed`` must already be limited to the largest window."""
    aggs = []
    for d in presets:
        inside = F.col("start_time").isNull() | (F.col("start_time") >= F.lit(int(as_of_ms) - int(d) * 86_400_000))
        aggs += [
            F.coalesce(money_sum(F.when(inside, F.col("estimated_cost"))), F.lit(0.0)).alias(f"c{d}"),
            F.count_if(inside).alias(f"n{d}"),
        ]
    wide = costed.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(int(d)).alias("window_days"), py_round(f"c{d}", 2).alias("total_cost"), F.col(f"n{d}").alias("run_count"))
            for d in presets
        ]
    )
    return wide.select(F.inline(rows))


def bar_scale(df: DataFrame, value_col: str, floor_pct: float) -> Column:
    """bar width in percent of the largest value, at least ``floor_pct``:
    ``max(floor, value / max(max_value, 1) * 100)``. ``df`` should be a small,
    materialised result (the max is a scalar subquery over it)."""
    top = df.agg(F.greatest(F.coalesce(F.max(value_col), F.lit(1.0)), F.lit(1.0))).scalar()
    return F.greatest(F.lit(float(floor_pct)), F.col(value_col) / top * F.lit(100.0))


def cost_over_time_bars(costed: DataFrame, floor_pct: float = 8.0) -> DataFrame:
    """G6 + F4: the daily series with its bar widths (floor 8% as displayed)."""
    series = materialize(cost_over_time(costed))
    return series.select("date", "total_cost", "run_count", bar_scale(series, "total_cost", floor_pct).alias("bar_pct"))


def top_jobs_bars(summaries: DataFrame, n: int = 8, floor_pct: float = 10.0) -> DataFrame:
    """K6 + F4: the ``n`` most expensive jobs with bar widths relative to the
    most expensive one (floor 10%)."""
    shown = present_jobs(summaries)
    top = shown.orderBy(F.desc("total_cost"), F.desc_nulls_last("last_run_time"), F.asc("job_id")).limit(n)
    return top.select("job_id", "job_name", "total_cost", bar_scale(shown, "total_cost", floor_pct).alias("bar_pct"))
