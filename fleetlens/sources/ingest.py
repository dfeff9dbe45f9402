"""Ingest (I1-I12): landed raw JSON records -> typed jobs / runs / clusters.

Each ``normalise_*`` is a table job over a DataFrame with one JSON document
per row (column ``value``; ``spark.read.text`` of landed files, or a stream).
Parsing uses ``from_json`` with every scalar read as STRING and converted with
``try_cast`` (``from_json`` into BIGINT turns the JSON string "3" into NULL,
whereas the source accepts it). Wrong-shaped sub-objects become NULL, as in
the source. Rows whose id does not parse go to a quarantine DataFrame instead
of failing the whole load. ``keep`` names columns of the raw rows to carry along
(the landing order of an incremental sync).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions import blank_to_null

# Raw shapes: every scalar as STRING, objects as structs.
_RAW_AUTOSCALE = "struct<min_workers: string, max_workers: string>"
_RAW_SPEC_FIELDS = (
    "spark_version: string, node_type_id: string, driver_node_type_id: string, num_workers: string, "
    f"autoscale: {_RAW_AUTOSCALE}, autotermination_minutes: string"
)
_RAW_SPEC = f"struct<{_RAW_SPEC_FIELDS}>"
_RAW_TAGS = "map<string, string>"

RAW_JOB = (
    "job_id string, creator_user_name string, created_time string, "
    "settings struct<name: string, tags: map<string,string>, "
    "schedule struct<quartz_cron_expression: string, timezone_id: string, pause_status: string>, "
    "max_concurrent_runs string, "
    "tasks array<struct<task_key: string, job_cluster_key: string, existing_cluster_id: string, "
    "notebook_task: struct<notebook_path: string>>>, "
    f"job_clusters array<struct<job_cluster_key: string, new_cluster: {_RAW_SPEC}>>>"
)
RAW_RUN = (
    "run_id string, job_id string, run_name string, creator_user_name string, run_page_url string, trigger string, "
    "start_time string, end_time string, run_duration string, execution_duration string, "
    "state struct<life_cycle_state: string, result_state: string, state_message: string>, "
    "cluster_instance struct<cluster_id: string, spark_context_id: string>, "
    f"cluster_spec struct<{_RAW_SPEC_FIELDS}, new_cluster: {_RAW_SPEC}>, "
    f"tags {_RAW_TAGS}"
)
RAW_CLUSTER = f"cluster_id string, cluster_name string, {_RAW_SPEC_FIELDS.replace(': ', ' ')}"

# Life-cycle states of a completed run.
COMPLETED_STATES = ("TERMINATED", "SKIPPED", "INTERNAL_ERROR")


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def autoscale(raw: Column) -> Column:
    """Autoscale only when both bounds parse."""
    lo, hi = _int(raw["min_workers"]), _int(raw["max_workers"])
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("min_workers"), hi.alias("max_workers")))


def cluster_spec(raw: Column) -> Column:
    """Typed spec; a non-object is NULL, ``{}`` is a struct of NULLs."""
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw["spark_version"].alias("spark_version"),
            raw["node_type_id"].alias("node_type_id"),
            raw["driver_node_type_id"].alias("driver_node_type_id"),
            _int(raw["num_workers"]).alias("num_workers"),
            autoscale(raw["autoscale"]).alias("autoscale"),
            _int(raw["autotermination_minutes"]).alias("autotermination_minutes"),
        ),
    )


def tag_map(raw: Column) -> Column:
    """NULL unless a non-empty object (values kept as text; NULL values dropped)."""
    clean = F.map_filter(raw, lambda k, v: v.isNotNull())
    return F.when(F.size(clean) > 0, clean)


def _parse_once(raw: DataFrame, value_col: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw text, the columns to ``keep`` and the parsed record's fields, each document parsed
    exactly once: the generator keeps Catalyst from inlining ``from_json``
    into every later filter and projection. A document that does not parse
    gives a row of NULLs (so it reaches the quarantine)."""
    return raw.select(F.col(value_col).alias("_raw"), *keep, F.inline(F.array(F.from_json(F.col(value_col), schema))))


def normalise_jobs(raw: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed jobs, quarantined raw rows without a parsable job_id)."""
    parsed = _parse_once(raw, value_col, RAW_JOB, keep)
    job_id = _long(F.col("job_id"))
    st = F.col("settings")
    tasks = F.transform(
        st["tasks"],
        lambda t: F.struct(
            F.coalesce(blank_to_null(t["task_key"]), F.lit("unknown")).alias("task_key"),
            t["notebook_task"]["notebook_path"].alias("notebook_path"),
            F.coalesce(blank_to_null(t["job_cluster_key"]), t["existing_cluster_id"]).alias("cluster_ref"),
        ),
    )
    # A task that is not an object parses to NULL: it becomes task 'unknown'.
    tasks = F.transform(
        tasks,
        lambda t: F.coalesce(
            t, F.struct(F.lit("unknown").alias("task_key"), F.lit(None).cast("string").alias("notebook_path"),
                        F.lit(None).cast("string").alias("cluster_ref"))
        ),
    )
    job_clusters = F.filter(
        F.transform(
            st["job_clusters"],
            lambda c: F.struct(c["job_cluster_key"].alias("job_cluster_key"), cluster_spec(c["new_cluster"]).alias("new_cluster")),
        ),
        lambda c: c["job_cluster_key"].isNotNull() & c["new_cluster"].isNotNull(),
    )
    typed = parsed.where(job_id.isNotNull()).select(
        job_id.alias("job_id"),
        F.coalesce(blank_to_null(st["name"]), F.col("job_id")).alias("name"),
        F.col("creator_user_name").alias("creator_user_name"),
        _long(F.col("created_time")).alias("created_time"),
        tag_map(st["tags"]).alias("tags"),
        st["schedule"].alias("schedule"),
        _int(st["max_concurrent_runs"]).alias("max_concurrent_runs"),
        tasks.cast(S.JOBS["tasks"].dataType).alias("tasks"),
        job_clusters.cast(S.JOBS["job_clusters"].dataType).alias("job_clusters"),
        *keep,
    )
    quarantine = parsed.where(job_id.isNull()).select(F.col("_raw").alias(value_col))
    return typed, quarantine


def run_duration(run_duration: Column, execution_duration: Column, start: Column, end: Column) -> Column:
    """I4: run duration (0 counts as missing), else execution duration, else end - start (>= 0)."""
    d = F.coalesce(F.nullif(run_duration, F.lit(0)), execution_duration)
    from_times = F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0).cast("bigint"), end - start))
    return F.coalesce(d, from_times)


def normalise_runs(raw: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed runs, quarantined raw rows without a parsable run_id)."""
    parsed = _parse_once(raw, value_col, RAW_RUN, keep)
    run_id = _long(F.col("run_id"))
    start, end = _long(F.col("start_time")), _long(F.col("end_time"))
    spec = F.col("cluster_spec")
    unwrapped = F.when(spec["new_cluster"].isNotNull(), spec["new_cluster"]).otherwise(spec.dropFields("new_cluster"))
    typed = parsed.where(run_id.isNotNull()).select(
        run_id.alias("run_id"),
        _long(F.col("job_id")).alias("job_id"),
        F.col("run_name").alias("run_name"),
        F.col("creator_user_name").alias("creator_user_name"),
        F.col("run_page_url").alias("run_page_url"),
        F.col("trigger").alias("trigger"),
        start.alias("start_time"),
        end.alias("end_time"),
        run_duration(_long(F.col("run_duration")), _long(F.col("execution_duration")), start, end).alias("duration_ms"),
        F.col("state").alias("state"),
        F.col("cluster_instance").alias("cluster_instance"),
        F.when(spec.isNotNull(), cluster_spec(unwrapped)).cast(S.CLUSTER_SPEC).alias("cluster_spec"),
        tag_map(F.col("tags")).alias("tags"),
        *keep,
    )
    quarantine = parsed.where(run_id.isNull()).select(F.col("_raw").alias(value_col))
    return typed, quarantine


def normalise_clusters(raw: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed clusters, quarantined rows without a cluster_id)."""
    parsed = _parse_once(raw, value_col, RAW_CLUSTER, keep)
    cid = F.col("cluster_id")
    typed = parsed.where(cid.isNotNull()).select(
        cid.alias("cluster_id"),
        F.col("cluster_name").alias("cluster_name"),
        F.col("spark_version").alias("spark_version"),
        F.col("node_type_id").alias("node_type_id"),
        F.col("driver_node_type_id").alias("driver_node_type_id"),
        _int(F.col("num_workers")).alias("num_workers"),
        autoscale(F.col("autoscale")).alias("autoscale"),
        _int(F.col("autotermination_minutes")).alias("autotermination_minutes"),
        *keep,
    )
    quarantine = parsed.where(cid.isNull()).select(F.col("_raw").alias(value_col))
    return typed, quarantine


def completed_runs(runs: DataFrame, limit: int | None = None, states: tuple[str, ...] = COMPLETED_STATES) -> DataFrame:
    """Completed runs, newest first; ``limit`` keeps the newest ``limit``
    (the source pulls 250 by default; here no limit unless asked)."""
    done = runs.where(F.col("state.life_cycle_state").isin(*states))
    if limit is None:
        return done
    if limit < 0:
        raise ValueError("limit must be >= 0")
    return done.orderBy(F.desc_nulls_last("start_time"), F.desc("run_id")).limit(limit)


def distinct_cluster_ids(runs: DataFrame) -> DataFrame:
    """Distinct non-empty cluster instance ids used by runs."""
    cid = F.col("cluster_instance.cluster_id")
    return runs.select(cid.alias("cluster_id")).where(cid.isNotNull() & (cid != "")).distinct()


def referenced_clusters(clusters: DataFrame, runs: DataFrame) -> DataFrame:
    """Only the clusters some run refers to (left semi join)."""
    return clusters.join(distinct_cluster_ids(runs), "cluster_id", "left_semi")


def distinct_node_types(clusters: DataFrame) -> DataFrame:
    """Driver UNION worker node types, trimmed, blanks dropped, distinct."""
    drivers = clusters.select(F.trim(F.col("driver_node_type_id")).alias("node_type"))
    workers = clusters.select(F.trim(F.col("node_type_id")).alias("node_type"))
    both = drivers.union(workers)
    return both.where(F.col("node_type").isNotNull() & (F.col("node_type") != "")).distinct()
