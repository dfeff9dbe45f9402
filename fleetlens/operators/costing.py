"""Run costing (C1-C13): resolve each run's cluster shape, price it, cost it.

Plan shape (the runs table is the only large input):

    runs --where(window, duration>0, job_id not null)--> narrow projection
         --left join clusters (broadcast after a bounded size check)
         --left join job dimension (broadcast if bounded, else salted shuffle)
         --inner join rates on worker type, inner join rates on driver type
           (node-type grain, broadcast)

Everything after the scan is narrow, so with broadcast dimensions the whole
costing is one whole-stage-codegen pipeline with no shuffle. Job cluster
resolution (C5) and job tag extraction run once per job, not per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import (
    MS_PER_HOUR,
    PIPELINE_TAG_KEYS,
    TABLE_TAG_KEYS,
    blank_to_null,
    merge_tag_values,
    tag_values,
    utc_day,
    workers_from,
)
from fleetlens.operators.dedupe import latest_by_key
from fleetlens.plans.joins import DEFAULT_BROADCAST_ROWS, DEFAULT_SALT_BUCKETS, has_unique_key, join_dimension

# Labels of where a run's cluster shape came from.
SOURCE_RUN_SPEC = "run.cluster_spec"
SOURCE_CLUSTER_LOOKUP = "cluster_lookup"
SOURCE_JOB_CLUSTERS = "job.job_clusters"
SOURCE_UNRESOLVED = "unresolved"

# Reasons a loaded run has no cost, in the order they are checked.
REASON_NO_DURATION = "no_billable_duration"
REASON_UNRESOLVED = "unresolved_cluster"
REASON_NO_NODE_TYPE = "no_node_type"
REASON_UNPRICED_WORKER = "unpriced_worker"
REASON_UNPRICED_DRIVER = "unpriced_driver"
REASON_NO_JOB = "no_job"


@dataclass(frozen=True)
class CostConfig:
    """Knobs of the cost model (defaults are the source's)."""

    currency: str = "USD"
    include_driver: bool = True
    autoscale_strategy: str = "average"
    expensive_job_share_threshold: float = 0.35
    top_n_insights: int = 3
    top_n_dataset_insights: int = 3
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    salt_buckets: int = DEFAULT_SALT_BUCKETS
    #: Column that orders repeated clusters, jobs and rates (the last one counts).
    #: Without such a column, rows count in the order they are stored.
    dimension_order: str = "ordinal"


# --------------------------------------------------------------------- filters


def runs_in_window(runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    """Drop a run only when it has a start before the window; NULL starts stay.

    On a snapshot partitioned by UTC ``start_date`` the implied day predicate
    is added as well, so the scan prunes whole partitions (the NULL-start
    partition is kept); the exact predicate then filters rows."""
    if window_start_ms is None:
        return runs
    w = F.lit(int(window_start_ms))
    if "start_date" in runs.columns:
        runs = runs.where(F.col("start_date").isNull() | (F.col("start_date") >= utc_day(w)))
    return runs.where(F.col("start_time").isNull() | (F.col("start_time") >= w))


def billable_runs(runs: DataFrame) -> DataFrame:
    """Runs with a positive duration (NULL, 0 and negative are not billable)."""
    return runs.where(F.col("duration_ms") > 0)


def window_start(as_of_ms: int, window_days: int) -> int:
    """start of a ``window_days`` window ending at ``as_of_ms``."""
    if window_days < 1:
        raise ValueError("window_days must be >= 1")
    return int(as_of_ms) - int(window_days) * 86_400_000


# ------------------------------------------------------------------ dimensions


def last_of_each(dim: DataFrame, key: str, cfg: CostConfig) -> DataFrame:
    """The last row per key, so that a repeated key does not repeat the runs
    joined to it. Keys proven unique (a remembered check) need no aggregation."""
    if has_unique_key(dim, key):
        return dim
    if cfg.dimension_order in dim.columns:
        return latest_by_key(dim, [key], [cfg.dimension_order])
    stored = dim.withColumn("_stored", F.monotonically_increasing_id())
    return latest_by_key(stored, [key], ["_stored"]).drop("_stored")


# Pricing fields of a spec, resolved one scalar column at a time (no struct is
# built per run): (name, field accessor on a spec struct).
_SPEC_FIELDS = (
    ("node", lambda s: s["node_type_id"]),
    ("driver", lambda s: s["driver_node_type_id"]),
    ("workers", lambda s: s["num_workers"].cast("int")),
    ("as_min", lambda s: s["autoscale"]["min_workers"]),
    ("as_max", lambda s: s["autoscale"]["max_workers"]),
)


def _spec_cols(spec: Column, prefix: str) -> list[Column]:
    return [get(spec).alias(f"{prefix}_{name}") for name, get in _SPEC_FIELDS]


def cluster_dimension(clusters: DataFrame) -> DataFrame:
    """C4 lookup side: cluster_id -> flattened pricing spec, ``cl_found`` = true."""
    spec = F.struct(F.col("node_type_id"), F.col("driver_node_type_id"), F.col("num_workers"), F.col("autoscale"))
    return clusters.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != "")).select(
        F.col("cluster_id"), *_spec_cols(spec, "cl"), F.lit(True).alias("cl_found")
    )


def _refs_sql(tasks: str) -> str:
    return f"array_distinct(filter(transform(`{tasks}`, t -> t.cluster_ref), r -> r IS NOT NULL))"


def _ref_sql(tasks: str) -> str:
    refs = _refs_sql(tasks)
    return f"CASE WHEN size({refs}) = 1 THEN element_at({refs}, 1) END"


def job_cluster_ref(tasks: str = "tasks") -> Column:
    """C5 step 1: the single distinct non-null task cluster reference, else NULL
    (no tasks or only NULL references -> NULL)."""
    return F.expr(_ref_sql(tasks))


def job_cluster_spec(tasks: str = "tasks", job_clusters: str = "job_clusters") -> Column:
    """Pricing spec of the first job cluster whose key is the job's single
    task reference (NULL when there is none). One SQL expression, evaluated
    once per job."""
    m = f"try_element_at(filter(`{job_clusters}`, c -> c.job_cluster_key = {_ref_sql(tasks)}), 1).new_cluster"
    return F.expr(
        f"CASE WHEN {m} IS NOT NULL THEN named_struct('node_type_id', {m}.node_type_id, "
        f"'driver_node_type_id', {m}.driver_node_type_id, 'num_workers', CAST({m}.num_workers AS INT), "
        f"'autoscale', {m}.autoscale) END"
    )


def job_dimension(jobs: DataFrame, with_keys: bool = True) -> DataFrame:
    """Per job, computed once: resolved job-cluster spec (flattened, with
    ``js_present``) and the job's tag keys."""
    cols = [F.col("job_id"), job_cluster_spec().alias("job_spec")]
    if with_keys:
        cols += [
            tag_values("tags", PIPELINE_TAG_KEYS).alias("job_pipeline_keys"),
            tag_values("tags", TABLE_TAG_KEYS).alias("job_table_keys"),
        ]
    dim = jobs.select(*cols)
    spec = F.col("job_spec")
    keys = ["job_pipeline_keys", "job_table_keys"] if with_keys else []
    return dim.select("job_id", *_spec_cols(spec, "js"), spec.isNotNull().alias("js_present"), *keys)


def job_cluster_resolution(jobs: DataFrame) -> DataFrame:
    """C5 as a table: job_id, the single cluster reference, resolved node type and workers."""
    spec = job_cluster_spec()
    return jobs.select(
        "job_id",
        job_cluster_ref().alias("cluster_ref"),
        spec["node_type_id"].alias("node_type_id"),
        spec["num_workers"].alias("num_workers"),
        spec.isNotNull().alias("resolved"),
    )


def _rates_for(rates: DataFrame, key: str, prefix: str) -> DataFrame:
    return rates.select(
        F.col("node_type_id").alias(key),
        F.col("total_rate_per_hour").alias(f"{prefix}_rate"),
        F.col("currency").alias(f"{prefix}_currency"),
    )


# --------------------------------------------------------------------- costing


def _narrow_runs(runs: DataFrame, with_keys: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    cols = [*[F.col(c) for c in carry],
        F.col("run_id"),
        F.col("job_id"),
        F.col("start_time"),
        F.col("duration_ms"),
        *_spec_cols(F.col("cluster_spec"), "rs"),
        F.col("cluster_spec").isNotNull().alias("rs_present"),
        blank_to_null(F.col("cluster_instance.cluster_id")).alias("cluster_id"),
    ]
    if with_keys:
        cols += [
            tag_values("tags", PIPELINE_TAG_KEYS).alias("run_pipeline_keys"),
            tag_values("tags", TABLE_TAG_KEYS).alias("run_table_keys"),
        ]
    return runs.select(*cols)


def _resolve(narrow: DataFrame, jobs: DataFrame, clusters: DataFrame, cfg: CostConfig, with_keys: bool) -> DataFrame:
    """Attach the lookup and job specs and pick one by presence."""
    joined = join_dimension(
        narrow, cluster_dimension(last_of_each(clusters, "cluster_id", cfg)), "cluster_id", "left", max_broadcast_rows=cfg.max_broadcast_rows,
        salt_by="run_id", salt_buckets=cfg.salt_buckets,
    )
    joined = join_dimension(
        joined, job_dimension(last_of_each(jobs, "job_id", cfg), with_keys), "job_id", "left",
        max_broadcast_rows=cfg.max_broadcast_rows, salt_by="run_id", salt_buckets=cfg.salt_buckets,
    )
    has_run, has_lookup, has_job = F.col("rs_present"), F.col("cl_found").isNotNull(), F.coalesce(F.col("js_present"), F.lit(False))

    def pick(name: str) -> Column:
        # presence decides, not content: a run spec without node type does not fall through
        return F.when(has_run, F.col(f"rs_{name}")).when(has_lookup, F.col(f"cl_{name}")).otherwise(F.col(f"js_{name}"))

    source = (
        F.when(has_run, F.lit(SOURCE_RUN_SPEC))
        .when(has_lookup, F.lit(SOURCE_CLUSTER_LOOKUP))
        .when(has_job, F.lit(SOURCE_JOB_CLUSTERS))
        .otherwise(F.lit(SOURCE_UNRESOLVED))
    )
    node = blank_to_null(pick("node"))
    keys = (
        [
            merge_tag_values("run_pipeline_keys", "job_pipeline_keys").alias("pipeline_keys"),
            merge_tag_values("run_table_keys", "job_table_keys").alias("table_keys"),
        ]
        if with_keys
        else []
    )
    # one projection (each DataFrame step re-analyses the whole plan on the driver)
    return joined.select(
        "*",
        source.alias("source"),
        node.alias("node_type_id"),
        F.coalesce(blank_to_null(pick("driver")), node).alias("driver_node_type_id"),
        workers_from(pick("workers"), pick("as_min"), pick("as_max"), cfg.autoscale_strategy).alias("workers"),
        *keys,
    )


def cost_runs(
    runs: DataFrame,
    jobs: DataFrame,
    clusters: DataFrame,
    rates: DataFrame,
    cfg: CostConfig = CostConfig(),
    *,
    window_start_ms: int | None = None,
    with_keys: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per costed run.

    Columns: run_id, job_id, start_time, duration_ms, currency, estimated_cost,
    billable_nodes, hourly_rate, source, node_type_id, driver_node_type_id,
    workers[, pipeline_keys, table_keys]
    plus any ``carry`` columns of the run. Runs without a job id are dropped
    here (C11), before any join.
    """
    rates = last_of_each(rates, "node_type_id", cfg)
    base = billable_runs(runs_in_window(runs, window_start_ms)).where(F.col("job_id").isNotNull())
    resolved = _resolve(_narrow_runs(base, with_keys, tuple(carry)), jobs, clusters, cfg, with_keys)
    priced = join_dimension(
        resolved.where(F.col("node_type_id").isNotNull()), _rates_for(rates, "node_type_id", "w"), "node_type_id",
        "inner", max_broadcast_rows=cfg.max_broadcast_rows,
    )
    hourly = F.col("w_rate") * F.col("workers")
    nodes = F.col("workers")
    if cfg.include_driver:
        priced = join_dimension(
            priced, _rates_for(rates, "driver_node_type_id", "d"), "driver_node_type_id", "inner",
            max_broadcast_rows=cfg.max_broadcast_rows,
        )
        hourly = hourly + F.col("d_rate")
        nodes = nodes + F.lit(1.0)
    cols = [
        "run_id",
        "job_id",
        "start_time",
        "duration_ms",
        F.col("w_currency").alias("currency"),
        (hourly * (F.col("duration_ms") / F.lit(MS_PER_HOUR))).alias("estimated_cost"),
        nodes.alias("billable_nodes"),
        hourly.alias("hourly_rate"),
        "source",
        "node_type_id",
        "driver_node_type_id",
        "workers",
    ]
    if with_keys:
        cols += ["pipeline_keys", "table_keys"]
    return priced.select(*cols, *carry)


def diagnose_runs(
    runs: DataFrame,
    jobs: DataFrame,
    clusters: DataFrame,
    rates: DataFrame,
    cfg: CostConfig = CostConfig(),
    *,
    window_start_ms: int | None = None,
) -> DataFrame:
    """Every loaded run with ``reason`` = why it has no cost (NULL if costed).

    Same resolution as :func:`cost_runs` but with outer joins so that no run
    is lost; the reason is the first failing check in costing order.
    """
    rates = last_of_each(rates, "node_type_id", cfg)
    loaded = runs_in_window(runs, window_start_ms)
    resolved = _resolve(_narrow_runs(loaded, False), jobs, clusters, cfg, False)
    priced = join_dimension(
        resolved, _rates_for(rates, "node_type_id", "w"), "node_type_id", "left", max_broadcast_rows=cfg.max_broadcast_rows
    )
    priced = join_dimension(
        priced, _rates_for(rates, "driver_node_type_id", "d"), "driver_node_type_id", "left",
        max_broadcast_rows=cfg.max_broadcast_rows,
    )
    reason = (
        F.when(F.col("duration_ms").isNull() | (F.col("duration_ms") <= 0), F.lit(REASON_NO_DURATION))
        .when(F.col("source") == SOURCE_UNRESOLVED, F.lit(REASON_UNRESOLVED))
        .when(F.col("node_type_id").isNull(), F.lit(REASON_NO_NODE_TYPE))
        .when(F.col("w_rate").isNull(), F.lit(REASON_UNPRICED_WORKER))
        .when(F.lit(cfg.include_driver) & F.col("d_rate").isNull(), F.lit(REASON_UNPRICED_DRIVER))
        .when(F.col("job_id").isNull(), F.lit(REASON_NO_JOB))
    )
    return priced.select("run_id", "job_id", "start_time", "duration_ms", "source", "node_type_id", reason.alias("reason"))


def uncosted_by_reason(diagnosed: DataFrame) -> DataFrame:
    """C13 summary: number of uncosted runs per reason."""
    return (
        diagnosed.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("run_count"))
    )
