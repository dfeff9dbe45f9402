"""Typed schemas of the domain tables (jobs, runs, clusters, pricing).

Times are epoch milliseconds (LongType) as in the source API; every other
field keeps the nesting of the landed records so that nested-column pruning
reaches the Parquet scan. Fields are declared nullable so that derived
columns can be cast to these types; required-ness (ids) is enforced by the
ingest jobs, which quarantine rows without an id.
"""

from __future__ import annotations

from pyspark.sql import types as T

AUTOSCALE = T.StructType(
    [
        T.StructField("min_workers", T.IntegerType()),
        T.StructField("max_workers", T.IntegerType()),
    ]
)

CLUSTER_SPEC = T.StructType(
    [
        T.StructField("spark_version", T.StringType()),
        T.StructField("node_type_id", T.StringType()),
        T.StructField("driver_node_type_id", T.StringType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("autoscale", AUTOSCALE),
        T.StructField("autotermination_minutes", T.IntegerType()),
    ]
)

TAGS = T.MapType(T.StringType(), T.StringType())

SCHEDULE = T.StructType(
    [
        T.StructField("quartz_cron_expression", T.StringType()),
        T.StructField("timezone_id", T.StringType()),
        T.StructField("pause_status", T.StringType()),
    ]
)

JOB_TASK = T.StructType(
    [
        T.StructField("task_key", T.StringType()),
        T.StructField("notebook_path", T.StringType()),
        T.StructField("cluster_ref", T.StringType()),
    ]
)

JOB_CLUSTER = T.StructType(
    [
        T.StructField("job_cluster_key", T.StringType()),
        T.StructField("new_cluster", CLUSTER_SPEC),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("creator_user_name", T.StringType()),
        T.StructField("created_time", T.LongType()),
        T.StructField("tags", TAGS),
        T.StructField("schedule", SCHEDULE),
        T.StructField("max_concurrent_runs", T.IntegerType()),
        T.StructField("tasks", T.ArrayType(JOB_TASK)),
        T.StructField("job_clusters", T.ArrayType(JOB_CLUSTER)),
    ]
)

RUN_STATE = T.StructType(
    [
        T.StructField("life_cycle_state", T.StringType()),
        T.StructField("result_state", T.StringType()),
        T.StructField("state_message", T.StringType()),
    ]
)

CLUSTER_INSTANCE = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("spark_context_id", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("creator_user_name", T.StringType()),
        T.StructField("run_page_url", T.StringType()),
        T.StructField("trigger", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("state", RUN_STATE),
        T.StructField("cluster_instance", CLUSTER_INSTANCE),
        T.StructField("cluster_spec", CLUSTER_SPEC),
        T.StructField("tags", TAGS),
    ]
)

CLUSTERS = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("spark_version", T.StringType()),
        T.StructField("node_type_id", T.StringType()),
        T.StructField("driver_node_type_id", T.StringType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("autoscale", AUTOSCALE),
        T.StructField("autotermination_minutes", T.IntegerType()),
    ]
)

PRICING_RATES = T.StructType(
    [
        T.StructField("node_type_id", T.StringType()),
        T.StructField("dbu_rate_per_hour", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("infrastructure_rate_per_hour", T.DoubleType()),
    ]
)

PRICING_CONFIG = T.StructType(
    [
        T.StructField("node_type_id", T.StringType()),
        T.StructField("dbus_per_hour", T.DoubleType()),
        T.StructField("plan", T.StringType()),
    ]
)

RUN_COSTS = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("estimated_cost", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("billable_nodes", T.DoubleType()),
        T.StructField("hourly_rate", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

INSIGHTS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("subject_type", T.StringType()),
        T.StructField("subject_key", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("currency", T.StringType()),
    ]
)
