"""Registered queries: one per operator key, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables of ``sf_dir`` in full and derives the
workspace from them (``sources.fixtures``); nothing runs on made-up input.
The analysis clock is the latest event time; the window is 30 days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import TABLE_TAG_KEYS, money_sum, py_round, tag_values
from fleetlens.operators import costing, insights, pricing, summaries
from fleetlens.operators.attribution import explode_costs
from fleetlens.operators.costing import CostConfig
from fleetlens.plans.dashboard import Dashboard
from fleetlens.session import app_id
from fleetlens.sources.fixtures import Workspace, load_workspace

WINDOW_DAYS = 30
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _ws(spark: SparkSession, sf_dir: str) -> Workspace:
    return load_workspace(spark, sf_dir)


# Costed-run *plans* (lazy DataFrames, no data) shared by the queries of one
# session: building the plan costs ~1 s of driver-side analysis, computing it
# happens again on every action. Materialised aggregates are never shared.
_COSTED_PLANS: dict[tuple, DataFrame] = {}
_DIAGNOSED_PLANS: dict[tuple, DataFrame] = {}


def _dash(spark: SparkSession, sf_dir: str, cfg: CostConfig = CostConfig(), window_days: int = WINDOW_DAYS) -> Dashboard:
    ws = _ws(spark, sf_dir)
    d = Dashboard.from_config(ws.runs, ws.jobs, ws.clusters, ws.pricing_config, ws.as_of_ms, window_days=window_days, cfg=cfg)
    key = (app_id(spark), sf_dir, cfg, window_days)
    if key not in _COSTED_PLANS:
        _COSTED_PLANS[key] = d.costed
        _DIAGNOSED_PLANS[key] = d.diagnosed()
    d._costed = _COSTED_PLANS[key]
    d._diagnosed = _DIAGNOSED_PLANS[key]
    return d


def _r4(c):
    return py_round(c, 4)


def _run_cost_cols(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "job_id", "currency", _r4("estimated_cost").alias("estimated_cost"), "duration_ms",
        "billable_nodes", _r4("hourly_rate").alias("hourly_rate"), "source",
    )


# ---------------------------------------------------------------- C: costing


@query("run_costs")
def q_run_costs(spark, sf_dir):
    """C10 (flagship fact): every costed run in the window."""
    return _run_cost_cols(_dash(spark, sf_dir).costed)


@query("run_costs_no_driver")
def q_run_costs_no_driver(spark, sf_dir):
    """C9 off: the driver node is neither priced nor required."""
    return _run_cost_cols(_dash(spark, sf_dir, CostConfig(include_driver=False)).costed)


def _worker_counts(spark, sf_dir, strategy):
    d = _dash(spark, sf_dir, CostConfig(autoscale_strategy=strategy))
    return d.costed.select("run_id", "billable_nodes", _r4("estimated_cost").alias("estimated_cost"))


@query("worker_count_avg")
def q_worker_avg(spark, sf_dir):
    """C7, autoscale midpoint."""
    return _worker_counts(spark, sf_dir, "average")


@query("worker_count_min")
def q_worker_min(spark, sf_dir):
    """C7, autoscale lower bound."""
    return _worker_counts(spark, sf_dir, "min")


@query("worker_count_max")
def q_worker_max(spark, sf_dir):
    """C7, autoscale upper bound."""
    return _worker_counts(spark, sf_dir, "max")


@query("cost_by_source")
def q_cost_by_source(spark, sf_dir):
    """Costed runs and cost per spec source."""
    return (
        _dash(spark, sf_dir)
        .costed.groupBy("source")
        .agg(F.count("*").alias("run_count"), py_round(money_sum("estimated_cost"), 2).alias("total_cost"))
    )


@query("runs_in_window")
def q_runs_in_window(spark, sf_dir):
    """C1 with a 7-day window: loaded runs (NULL starts kept)."""
    ws = _ws(spark, sf_dir)
    w = costing.window_start(ws.as_of_ms, 7)
    return costing.runs_in_window(ws.runs, w).select("run_id", "job_id", "start_time")


@query("billable_runs")
def q_billable_runs(spark, sf_dir):
    """Runs with a positive duration."""
    return costing.billable_runs(_ws(spark, sf_dir).runs).select("run_id", "duration_ms")


@query("cluster_lookup_join")
def q_cluster_lookup(spark, sf_dir):
    """C4: all runs left-joined to the clusters (not found: no id, or unknown)."""
    ws = _ws(spark, sf_dir)
    runs = ws.runs.select("run_id", F.nullif(F.col("cluster_instance.cluster_id"), F.lit("")).alias("cluster_id"))
    dim = costing.cluster_dimension(ws.clusters)
    from fleetlens.plans.joins import join_dimension

    j = join_dimension(runs, dim, "cluster_id", "left", salt_by="run_id")
    return j.select(
        "run_id", "cluster_id", F.col("cl_node").alias("node_type_id"),
        F.col("cl_found").isNotNull().alias("found"),
    )


@query("job_cluster_resolution")
def q_job_cluster_resolution(spark, sf_dir):
    """Per job, the single task cluster reference and its job-cluster spec."""
    return costing.job_cluster_resolution(_ws(spark, sf_dir).jobs)


@query("run_job_join")
def q_run_job_join(spark, sf_dir):
    """C6 + C12: every run with its job label (missing job -> 'job-<id>')."""
    ws = _ws(spark, sf_dir)
    from fleetlens.plans.joins import join_dimension

    j = join_dimension(
        ws.runs.select("run_id", "job_id"), ws.jobs.select("job_id", F.col("name").alias("_name")), "job_id", "left",
        salt_by="run_id",
    )
    return j.select(
        "run_id",
        "job_id",
        F.when(F.col("job_id").isNotNull(), F.coalesce(F.col("_name"), F.concat(F.lit("job-"), F.col("job_id").cast("string")))).alias(
            "job_name"
        ),
        F.col("_name").isNotNull().alias("job_found"),
    )


@query("uncosted_runs_by_reason")
def q_uncosted(spark, sf_dir):
    """Uncosted loaded runs per first failing check."""
    return costing.uncosted_by_reason(_dash(spark, sf_dir).diagnosed())


# ----------------------------------------------------------- A: attribution


@query("tag_values_split")
def q_tag_values_split(spark, sf_dir):
    """A1+A2: each job's table tag values, split and stripped (one row per value)."""
    jobs = _ws(spark, sf_dir).jobs
    return jobs.select("job_id", F.posexplode(tag_values("tags", TABLE_TAG_KEYS)).alias("pos", "value")).select(
        "job_id", F.col("pos").cast("long").alias("pos"), "value"
    )


@query("run_table_keys")
def q_run_table_keys(spark, sf_dir):
    """A3: per costed run, distinct table keys of run then job tags (count + joined text)."""
    c = _dash(spark, sf_dir).costed
    return c.select(
        "run_id",
        F.size("table_keys").cast("long").alias("key_count"),
        F.array_join(F.array_sort("table_keys"), "|").alias("keys"),
        F.size("pipeline_keys").cast("long").alias("pipeline_key_count"),
    )


@query("cost_attribution_exploded")
def q_attr_exploded(spark, sf_dir):
    """A4: equal split of each costed run's cost over its table keys."""
    c = _dash(spark, sf_dir).costed
    return explode_costs(c, "table_keys").select("run_id", "key", _r4("share").alias("share"))


# ------------------------------------------------------------ G/K summaries


@query("total_cost")
def q_total_cost(spark, sf_dir):
    """G1+G2: report total, currency and costed run count."""
    t = summaries.total_cost(_dash(spark, sf_dir).costed)
    return t.select("currency", py_round("total_cost", 2).alias("total_cost"), "run_count")


@query("cost_by_job")
def q_cost_by_job(spark, sf_dir):
    """Every job with costed runs."""
    return summaries.present_jobs(_dash(spark, sf_dir).job_summaries())


@query("top_jobs")
def q_top_jobs(spark, sf_dir):
    """K2: ten most expensive jobs."""
    return _dash(spark, sf_dir).top_jobs(10)


@query("cost_by_pipeline")
def q_cost_by_pipeline(spark, sf_dir):
    """Every pipeline key."""
    return summaries.present_named(_dash(spark, sf_dir).pipeline_summaries())


@query("cost_by_table")
def q_cost_by_table(spark, sf_dir):
    """Every table key."""
    return summaries.present_named(_dash(spark, sf_dir).table_summaries())


@query("top_pipelines")
def q_top_pipelines(spark, sf_dir):
    """K3: three most expensive pipelines."""
    return _dash(spark, sf_dir).top_pipelines(3)


@query("top_tables")
def q_top_tables(spark, sf_dir):
    """K3: eight most expensive tables."""
    return _dash(spark, sf_dir).top_tables(8)


@query("cost_over_time")
def q_cost_over_time(spark, sf_dir):
    """Daily cost series (UTC days)."""
    return _dash(spark, sf_dir).cost_over_time()


@query("summary_kpis")
def q_summary(spark, sf_dir):
    """Headline numbers."""
    return _dash(spark, sf_dir).summary()


@query("coverage")
def q_coverage(spark, sf_dir):
    """Loaded vs costed runs and priced node types."""
    return _dash(spark, sf_dir).coverage()


@query("top_runs_by_cost")
def q_top_runs(spark, sf_dir):
    """K1: twenty most expensive runs."""
    return _run_cost_cols(summaries.top_runs(_dash(spark, sf_dir).costed, 20))


@query("recent_runs")
def q_recent_runs(spark, sf_dir):
    """K4: twenty latest costed runs with job names."""
    return _dash(spark, sf_dir).recent_runs(20)


@query("cost_by_window_presets")
def q_window_presets(spark, sf_dir):
    """K7: 7/14/30/90-day totals in one pass."""
    d = _dash(spark, sf_dir, window_days=90)
    return summaries.cost_by_window_presets(d.costed, d.as_of_ms)


# -------------------------------------------------------------- N insights


def _insight_cols(df: DataFrame) -> DataFrame:
    return df.select(
        "kind", "subject_type", "subject_key", "message", _r4("metric_value").alias("metric_value"), "currency",
        F.col("position").cast("long").alias("position"),
    )


@query("insights")
def q_insights(spark, sf_dir):
    """All insights in order."""
    return _insight_cols(_dash(spark, sf_dir).insights())


@query("insights_jobs")
def q_insights_jobs(spark, sf_dir):
    """expensive_job insights."""
    return _insight_cols(_dash(spark, sf_dir).insights()).where(F.col("kind") == insights.KIND_EXPENSIVE_JOB)


@query("insights_dominant_share")
def q_insights_dominant(spark, sf_dir):
    """N2 with a 1% threshold (the default 35% never fires on this data)."""
    d = _dash(spark, sf_dir, CostConfig(expensive_job_share_threshold=0.01))
    return _insight_cols(d.insights()).where(F.col("kind") == insights.KIND_DOMINANT_SHARE)


@query("insights_pipelines")
def q_insights_pipelines(spark, sf_dir):
    """N3 (+N6 filter by subject type)."""
    return insights.filter_insights(_insight_cols(_dash(spark, sf_dir).insights()), "pipeline")


@query("insights_tables")
def q_insights_tables(spark, sf_dir):
    """N4 (+N6 filter by subject type)."""
    return insights.filter_insights(_insight_cols(_dash(spark, sf_dir).insights()), "table")


# -------------------------------------------------------------- P pricing


@query("pricing_rates")
def q_pricing_rates(spark, sf_dir):
    """Effective jobs rates of priced node types."""
    return pricing.effective_rates(_ws(spark, sf_dir).pricing_config).select(
        "node_type_id", _r4("dbu_rate_per_hour").alias("dbu_rate_per_hour"), "currency",
        "infrastructure_rate_per_hour", _r4("total_rate_per_hour").alias("total_rate_per_hour"),
    )


@query("pricing_reference_rates")
def q_reference_rates(spark, sf_dir):
    """Jobs and all-purpose rates per config entry (4 dp)."""
    return pricing.reference_rates(_ws(spark, sf_dir).pricing_config)


@query("pricing_config_view")
def q_config_view(spark, sf_dir):
    """Discovered node types (sorted discovery order) then configured-only types."""
    ws = _ws(spark, sf_dir)
    from fleetlens.sources import ingest
    from pyspark.sql import Window

    disc = ingest.distinct_node_types(ws.clusters).select(
        F.col("node_type").alias("node_type_id"),
        (F.row_number().over(Window.orderBy("node_type")) - 1).alias("ordinal"),
    )
    v = pricing.config_view(disc, ws.pricing_config)
    return v.select(
        "node_type_id", "dbus_per_hour", "plan", "jobs_rate_per_hour", "all_purpose_rate_per_hour", "discovered",
        F.col("position").cast("long").alias("position"),
    )


def _raw_config_entries(spark, sf_dir) -> DataFrame:
    """Raw entries as a user would post them: padded ids, mixed-case plans,
    later duplicates for region-0 nations, blank ids, an unknown plan."""
    from fleetlens.sources.fixtures import table

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nk = F.col("n_nationkey")
    dbus = F.when(nk % 10 == 9, F.lit(0.0)).otherwise(F.lit(0.5) + F.lit(0.5) * F.col("n_regionkey"))
    plan = F.when(nk % 8 == 7, F.lit("gold")).when(nk % 2 == 0, F.lit("premium")).otherwise(F.lit("enterprise"))
    first = nation.select(
        F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("node_type_id"),
        dbus.alias("dbus_per_hour"),
        F.when(nk % 3 == 0, F.concat(F.upper(plan), F.lit(" "))).otherwise(plan).alias("plan"),
        (nk * 2).cast("long").alias("ordinal"),
    )
    later = nation.where(F.col("n_regionkey") == 0).select(
        F.col("n_name").alias("node_type_id"), (dbus * F.lit(2.0)).alias("dbus_per_hour"), F.lit("Premium").alias("plan"),
        (nk * 2 + 1).cast("long").alias("ordinal"),
    )
    blank = region.select(
        F.lit(" ").alias("node_type_id"), F.lit(1.0).alias("dbus_per_hour"), F.lit("premium").alias("plan"),
        (F.col("r_regionkey") + 1000).cast("long").alias("ordinal"),
    )
    return first.unionByName(later).unionByName(blank)


@query("pricing_config_normalised")
def q_config_normalised(spark, sf_dir):
    """Trimmed, lower-cased, deduplicated (last wins) entries with violations."""
    return pricing.normalise_config(_raw_config_entries(spark, sf_dir))


@query("pricing_config_counts")
def q_config_counts(spark, sf_dir):
    """Discovered node types and configured (dbus > 0) entries."""
    ws = _ws(spark, sf_dir)
    from fleetlens.sources import ingest

    return pricing.config_counts(ingest.distinct_node_types(ws.clusters), ws.pricing_config)


@query("dimension_dedupe")
def q_dimension_dedupe(spark, sf_dir):
    """Two cluster batches, the later batch wins per cluster id."""
    from fleetlens.operators.dedupe import latest_by_key
    from fleetlens.sources.fixtures import table

    sup = table(spark, sf_dir, "supplier")
    b0 = _ws(spark, sf_dir).clusters.select("cluster_id", "num_workers", F.lit(0).alias("batch"))
    b1 = sup.where(F.col("s_acctbal") > 5000).select(
        F.col("s_name").alias("cluster_id"), ((F.col("s_suppkey") % 8) + 1).cast("int").alias("num_workers"), F.lit(1).alias("batch")
    )
    return latest_by_key(b0.unionByName(b1), ["cluster_id"], ["batch"])


# ------------------------------------------------------------ I: ingest


@query("normalise_runs")
def q_normalise_runs(spark, sf_dir):
    """Raw run JSON -> typed runs (flattened for comparison)."""
    from fleetlens.sources import ingest
    from fleetlens.sources.fixtures import raw_runs_json, table

    typed, _ = ingest.normalise_runs(raw_runs_json(table(spark, sf_dir, "events")))
    return typed.select(
        "run_id", "job_id", "start_time", "end_time", "duration_ms",
        F.col("state.life_cycle_state").alias("life_cycle_state"),
        F.col("state.result_state").alias("result_state"),
        F.col("cluster_instance.cluster_id").alias("cluster_id"),
        F.col("cluster_spec").isNotNull().alias("has_spec"),
        F.col("cluster_spec.node_type_id").alias("spec_node_type"),
        F.col("cluster_spec.num_workers").alias("spec_workers"),
        F.element_at("tags", F.lit("Tables")).alias("tables_tag"),
    )


@query("normalise_jobs")
def q_normalise_jobs(spark, sf_dir):
    """Raw job JSON -> typed jobs (flattened for comparison)."""
    from fleetlens.sources import ingest
    from fleetlens.sources.fixtures import raw_jobs_json, table

    typed, _ = ingest.normalise_jobs(raw_jobs_json(table(spark, sf_dir, "customer")))
    refs = F.array_sort(F.array_distinct(F.filter(F.transform("tasks", lambda t: t["cluster_ref"]), lambda r: r.isNotNull())))
    return typed.select(
        "job_id", "name", "creator_user_name",
        F.col("schedule.pause_status").alias("pause_status"),
        F.size("tasks").cast("long").alias("task_count"),
        F.size(F.filter("tasks", lambda t: t["task_key"] == "unknown")).cast("long").alias("unknown_tasks"),
        F.array_join(refs, "|").alias("cluster_refs"),
        F.size("job_clusters").cast("long").alias("job_cluster_count"),
        F.col("job_clusters")[0]["new_cluster"]["node_type_id"].alias("jc_node_type"),
        F.col("job_clusters")[0]["new_cluster"]["num_workers"].alias("jc_workers"),
        F.element_at("tags", F.lit("pipeline")).alias("pipeline_tag"),
    )


@query("normalise_clusters")
def q_normalise_clusters(spark, sf_dir):
    """Raw cluster JSON -> typed clusters."""
    from fleetlens.sources import ingest
    from fleetlens.sources.fixtures import raw_clusters_json, table

    typed, _ = ingest.normalise_clusters(raw_clusters_json(table(spark, sf_dir, "supplier")))
    return typed.select(
        "cluster_id", "node_type_id", "driver_node_type_id", "num_workers",
        F.col("autoscale.min_workers").alias("as_min"), F.col("autoscale.max_workers").alias("as_max"),
    )


@query("completed_runs_limit")
def q_completed_runs(spark, sf_dir):
    """The 250 newest completed runs (the source's default pull size)."""
    from fleetlens.sources import ingest

    return ingest.completed_runs(_ws(spark, sf_dir).runs, 250).select("run_id", "start_time")


@query("distinct_cluster_ids")
def q_distinct_cluster_ids(spark, sf_dir):
    """Cluster ids referenced by runs."""
    from fleetlens.sources import ingest

    return ingest.distinct_cluster_ids(_ws(spark, sf_dir).runs).orderBy("cluster_id")


@query("referenced_clusters_semi")
def q_referenced_clusters(spark, sf_dir):
    """Clusters some run refers to."""
    from fleetlens.sources import ingest

    ws = _ws(spark, sf_dir)
    return ingest.referenced_clusters(ws.clusters, ws.runs).select("cluster_id", "node_type_id")


@query("distinct_node_types")
def q_distinct_node_types(spark, sf_dir):
    """Driver and worker node types in use."""
    from fleetlens.sources import ingest

    return ingest.distinct_node_types(_ws(spark, sf_dir).clusters).orderBy("node_type")


# ---------------------------------------------------------- S: snapshots


@query("upsert_latest_by_key")
def q_upsert_latest(spark, sf_dir):
    """Latest row per (l_orderkey, l_linenumber) of lineitem."""
    from fleetlens.operators.dedupe import latest_by_key
    from fleetlens.sources.fixtures import table

    li = table(spark, sf_dir, "lineitem")
    return latest_by_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"])


@query("load_jobs_ordered")
def q_load_jobs(spark, sf_dir):
    """Jobs by name."""
    from fleetlens.sources import snapshot

    return snapshot.load_jobs(_ws(spark, sf_dir).jobs).select("job_id", "name")


@query("load_runs_window")
def q_load_runs_window(spark, sf_dir):
    """Runs of the last 14 days (and runs without a start), newest first."""
    from fleetlens.sources import snapshot

    ws = _ws(spark, sf_dir)
    runs = snapshot.with_start_date(ws.runs)
    return snapshot.load_runs_window(runs, costing.window_start(ws.as_of_ms, 14)).select("run_id", "start_time", "start_date")


@query("runs_flattened")
def q_runs_flattened(spark, sf_dir):
    """Runs with state and cluster id as columns."""
    from fleetlens.sources import snapshot

    return snapshot.flatten_runs(_ws(spark, sf_dir).runs)


SYNCED_AT = "2024-01-31T00:00:00+00:00"


def _landed_store(spark, sf_dir, *landings):
    """A new workspace store fed by the stream from records landed in a new folder.
    Each landing is (synced_at, [(kind, records), ...]): its records land in this order,
    then one sync drains them. Returns the store and the landing folder."""
    from fleetlens.session import shared_folder
    from fleetlens.sources.store import WorkspaceStore
    from fleetlens.streaming.incremental_sync import sync_once

    landing, root, stream = (shared_folder(spark, x) for x in ("landing", "store", "stream"))
    n = 0
    for synced_at, records in landings:
        for kind, rows in records:
            n += 1
            rows.write.text(f"{landing}/{kind}/{n:03d}")
        sync_once(spark, landing, root, synced_at=synced_at, checkpoint_location=stream)
    return WorkspaceStore(spark, root), landing


@query("synced_runs")
def q_synced_runs(spark, sf_dir):
    """Run records landed in three files and drained in two syncs (the
    second has two records of some runs), then an epoch run again. Restarted runs change
    their day, runs without a start get one."""
    from fleetlens.sources import fixtures as X
    from fleetlens.streaming import incremental_sync as I

    events = X.table(spark, sf_dir, "events")
    store, landing = _landed_store(
        spark, sf_dir,
        ("2024-01-30T00:00:00+00:00", [("runs", X.raw_runs_json(events))]),
        (SYNCED_AT, [("runs", X.raw_run_restarts(events)), ("runs", X.raw_run_corrections(events))]),
    )
    ((application, epoch),) = store.state()[1]["epochs"].items()
    first = spark.read.text(f"{landing}/runs/001").select("value", *[F.col(f"_metadata.{c}").alias(c) for c in I._FILE])
    assert I.merge_epoch(store, first, application, epoch, "never")["replayed"]
    return store.read_runs().select("run_id", "job_id", "start_time", "duration_ms", "day", F.col("state.result_state").alias("result_state"), F.lit(store.metadata_get("last_sync_at")).alias("last_sync_at"))


@query("synced_jobs")
def q_synced_jobs(spark, sf_dir):
    """Jobs and their renames landed for one sync; the last record of a job wins."""
    from fleetlens.sources import fixtures as X

    customer = X.table(spark, sf_dir, "customer")
    store, _ = _landed_store(spark, sf_dir, (SYNCED_AT, [("jobs", X.raw_jobs_json(customer)), ("jobs", X.raw_job_renames(customer))]))
    return store.read("jobs").select("job_id", "name", "creator_user_name", F.size(F.coalesce("job_clusters", F.array().cast(store.read("jobs").schema["job_clusters"].dataType))).alias("n_job_clusters"))


@query("synced_clusters")
def q_synced_clusters(spark, sf_dir):
    """Clusters and their resizes landed before the runs that refer to some of
    them; those enter the store, each as last landed."""
    from fleetlens.sources import fixtures as X

    supplier = X.table(spark, sf_dir, "supplier")
    store, _ = _landed_store(
        spark, sf_dir,
        ("2024-01-30T00:00:00+00:00", [("clusters", X.raw_clusters_json(supplier)), ("clusters", X.raw_cluster_resizes(supplier))]),
        (SYNCED_AT, [("runs", X.raw_runs_json(X.table(spark, sf_dir, "events")))]),
    )
    return store.read("clusters").select("cluster_id", "cluster_name", "node_type_id", "num_workers")


@query("sync_counts")
def q_sync_counts(spark, sf_dir):
    """What one sync of jobs, runs and referenced clusters saved, and what the
    store then holds, all from one commit."""
    from fleetlens.sources import fixtures as X

    tables = [X.table(spark, sf_dir, t) for t in ("customer", "events", "supplier")]
    records = [("jobs", X.raw_jobs_json(tables[0])), ("runs", X.raw_runs_json(tables[1])), ("clusters", X.raw_clusters_json(tables[2]))]
    store, _ = _landed_store(spark, sf_dir, (SYNCED_AT, records))
    _, state = store.state()
    saved = state["last_sync"]
    held = store.read_runs(state=state).agg(F.count("*").alias("runs"))
    return held.select(
        *[F.lit(saved[c]).cast("long").alias(c) for c in ("saved_jobs", "saved_runs", "saved_clusters")],
        F.lit(saved["last_sync_at"]).alias("last_sync_at"),
        "runs",
        *[store.read(t, state).agg(F.count("*")).scalar().alias(t) for t in ("jobs", "clusters", "clusters_waiting")],
    )


@query("metadata_last_write")
def q_metadata(spark, sf_dir):
    """key/value writes in three commits (the last row of a key wins within one,
    the later commit over all), with a writer that crashes before its commit."""
    from fleetlens.session import shared_folder
    from fleetlens.sources import fixtures as X
    from fleetlens.sources.store import LANDED, WorkspaceStore

    store = WorkspaceStore(spark, shared_folder(spark, "metadata"))
    c = F.col("c_custkey")
    rows = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), (c % 1000).cast("string")).alias("key"), F.col("c_name").alias("value"), F.struct(c.alias("line")).alias(LANDED), (c % 3).alias("write"))
    for i in range(3):
        store._merged("metadata", rows.withColumn("value", F.lit("never")).drop("write"), store.state()[1])  # crashed
        store.metadata_put(rows.where(F.col("write") == i).drop("write"))
    return store.read("metadata").withColumn("commits", F.lit(store.state()[0]).cast("long"))


@query("store_dashboard_summary")
def q_store_dashboard(spark, sf_dir):
    """Workspace and pricing config saved to a store, the headline numbers
    read back from its commit."""
    from fleetlens.session import shared_folder
    from fleetlens.sources.store import Batch, WorkspaceStore

    ws = _ws(spark, sf_dir)
    store = WorkspaceStore(spark, shared_folder(spark, "store"))
    store.save_pricing_config(ws.pricing_config.withColumn("ordinal", F.lit(0)))
    store.sync(Batch(ws.jobs, ws.runs, ws.clusters), SYNCED_AT)
    return Dashboard.from_store(store, ws.as_of_ms, WINDOW_DAYS).summary()


@query("json_round_trip")
def q_json_round_trip(spark, sf_dir):
    """Jobs, runs and clusters to JSON lines and back: rows, rows that differ, and the
    job clusters without a key that the import drops."""
    from fleetlens.session import shared_folder
    from fleetlens.sources import codec

    ws = _ws(spark, sf_dir)
    keyless = F.struct(F.lit(None).cast("string").alias("job_cluster_key"), F.col("job_clusters")[0]["new_cluster"].alias("new_cluster"))
    jobs = ws.jobs.withColumn("job_clusters", F.when(F.col("job_id") % 3 == 0, F.concat("job_clusters", F.array(keyless))).otherwise(F.col("job_clusters")))
    out = None
    for name, df, want in (("jobs", jobs, ws.jobs), ("runs", ws.runs, ws.runs), ("clusters", ws.clusters, ws.clusters)):
        path = shared_folder(spark, f"export-{name}")
        codec.export_json(df, path)
        back = codec.import_json(spark, path, df.schema)
        differ = codec.differences(want, back)
        kept = F.sum(F.size("job_clusters")) if name == "jobs" else F.lit(0)
        row = back.agg(F.count("*").alias("rows"), kept.cast("long").alias("kept")).select(
            F.lit(name).alias("table_name"), "rows",
            differ.agg(F.max(F.col("only_left") + F.col("only_right"))).scalar().alias("differences"),
            (df.agg((F.sum(F.size("job_clusters")) if name == "jobs" else F.lit(0)).cast("long")).scalar() - F.col("kept")).alias("dropped_job_clusters"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _line_history(spark, sf_dir):
    """lineitem appended in three syncs (one per return flag), the last row per key of each."""
    from fleetlens.operators.dedupe import latest_by_key
    from fleetlens.session import shared_folder
    from fleetlens.sources import snapshot
    from fleetlens.sources.fixtures import table

    root = shared_folder(spark, "history")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    for day, flag in enumerate("ANR", 1):
        batch = latest_by_key(li.where(F.col("l_returnflag") == flag), LINE_KEYS, ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"])
        snapshot.append_history(batch, root, "lines", f"2024-01-0{day}T00:00:00")
    return snapshot.read_history(spark, root, "lines")


LINE_KEYS = ["l_orderkey", "l_linenumber"]


@query("history_as_of")
def q_history_as_of(spark, sf_dir):
    """The state after each of three syncs, from the history up to its time."""
    from fleetlens.sources import snapshot

    history = _line_history(spark, sf_dir)
    out = None
    for day in (1, 2, 3):
        at = f"2024-01-0{day}T00:00:00"
        state = snapshot.state_as_of(history, LINE_KEYS, at).select(F.lit(at).alias("as_of"), *LINE_KEYS, "l_quantity", "l_returnflag", "synced_at")
        out = state if out is None else out.unionByName(state)
    return out


@query("history_validity")
def q_history_validity(spark, sf_dir):
    """From when until when each synced row held."""
    from fleetlens.sources import snapshot

    return snapshot.validity_intervals(_line_history(spark, sf_dir), LINE_KEYS).select(*LINE_KEYS, "l_quantity", "valid_from", "valid_to")


@query("snapshot_history")
def q_snapshot_history(spark, sf_dir):
    """Lineitem as an appended history (synced at ship date): versions per
    key and the latest state."""
    from fleetlens.sources.fixtures import table

    li = table(spark, sf_dir, "lineitem").withColumn("synced_at", F.col("l_shipdate"))
    order = F.struct("synced_at", "l_extendedprice", "l_partkey", "l_suppkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("version_count"),
        F.min("synced_at").alias("first_synced_at"),
        F.max("synced_at").alias("last_synced_at"),
        F.max_by("l_quantity", order).alias("latest_quantity"),
    )


# ------------------------------------------------ B: observability (ours)


def _obs(spark, sf_dir, window_days=WINDOW_DAYS):
    from fleetlens.operators import observability as O

    d = _dash(spark, sf_dir, window_days=window_days)
    return O, d


@query("job_stats")
def q_job_stats(spark, sf_dir):
    """B1: per-job run statistics over the window."""
    O, d = _obs(spark, sf_dir)
    s = O.job_stats(d.runs, d.costed, d.window_start_ms, d.window_days)
    return s.select(
        "job_id", "run_count", "success_count", "failure_count", _r4("failure_rate").alias("failure_rate"),
        "avg_duration_ms", "p95_duration_ms", "last_run_time", "last_success_time", "last_failure_time",
        py_round("estimated_cost", 2).alias("estimated_cost"), "window_days",
    )


@query("failure_above_fleet")
def q_failure_above_fleet(spark, sf_dir):
    """B2: jobs failing more often than the fleet (>= 5 runs)."""
    O, d = _obs(spark, sf_dir)
    s = O.profile_stats(O.run_profile(d.runs, d.window_start_ms))
    return O.failure_above_fleet(s, 5).select(
        "job_id", "run_count", "failure_count", _r4("failure_rate").alias("failure_rate"),
        _r4("fleet_failure_rate").alias("fleet_failure_rate"),
    )


@query("execution_frequency")
def q_execution_frequency(spark, sf_dir):
    """Runs per day and median gap between starts."""
    O, d = _obs(spark, sf_dir)
    f = O.execution_frequency(d.runs, d.window_start_ms, d.window_days)
    return f.select("job_id", "run_count", _r4("runs_per_day").alias("runs_per_day"), "median_gap_ms")


@query("unstable_jobs")
def q_unstable(spark, sf_dir):
    """Jobs with duration cv >= 0.5 (>= 3 runs)."""
    O, d = _obs(spark, sf_dir)
    u = O.unstable_jobs(d.runs, d.window_start_ms, 0.5, 3)
    return u.select(
        "job_id", "run_count", py_round("avg_duration_ms", 2).alias("avg_duration_ms"),
        py_round("stddev_duration_ms", 2).alias("stddev_duration_ms"), _r4("cv").alias("cv"),
    )


@query("runtime_degradation")
def q_degradation(spark, sf_dir):
    """Recent vs earlier half-window mean duration and slope."""
    O, d = _obs(spark, sf_dir)
    g = O.runtime_degradation(d.runs, d.as_of_ms, d.window_days, 0.2)
    return g.select(
        "job_id", py_round("earlier_avg_ms", 2).alias("earlier_avg_ms"), py_round("recent_avg_ms", 2).alias("recent_avg_ms"),
        _r4("change_pct").alias("change_pct"), py_round("slope_ms_per_day", 2).alias("slope_ms_per_day"), "degrading",
    )


@query("orphan_jobs")
def q_orphans(spark, sf_dir):
    """Jobs without owner, paused, or without runs in the window."""
    O, d = _obs(spark, sf_dir)
    o = O.orphan_jobs(d.jobs, d.runs, d.window_start_ms)
    return o.select("job_id", "name", F.array_join("reasons", ",").alias("reasons"))


@query("cost_period_delta")
def q_period_delta(spark, sf_dir):
    """Last 14 days vs the 14 days before, per job."""
    from fleetlens.operators import observability as O

    d = _dash(spark, sf_dir, window_days=28)
    p = O.cost_period_delta(d.costed, d.as_of_ms, 14)
    return p.select(
        "job_id", py_round("current_cost", 2).alias("current_cost"), py_round("previous_cost", 2).alias("previous_cost"),
        "current_runs", "previous_runs", py_round("delta_cost", 2).alias("delta_cost"), _r4("delta_pct").alias("delta_pct"),
    )


@query("dbus_consumed")
def q_dbus(spark, sf_dir):
    """Usage units per job."""
    O, d = _obs(spark, sf_dir)
    ws = _ws(spark, sf_dir)
    u = O.usage_units(d.costed, ws.pricing_config)
    return u.groupBy("job_id").agg(_r4(O.dbus_from_ms(F.sum("dbu_ms"))).alias("dbus"))


@query("job_health_status")
def q_health(spark, sf_dir):
    """Failing / degrading / unstable / healthy per job."""
    O, d = _obs(spark, sf_dir)
    profile = O.run_profile(d.runs, d.window_start_ms)
    g = O.runtime_degradation(d.runs, d.as_of_ms, d.window_days, 0.2)
    return O.job_health_status(O.profile_stats(profile), g, O.profile_spread(profile))


# ------------------------------------------------- B: freshness (ours)


def _health(spark, sf_dir):
    from fleetlens.operators import freshness as H
    from fleetlens.sources import fixtures as X

    orders = X.table(spark, sf_dir, "orders")
    return H, X, orders


def _updates(H, X, orders):
    """The update log by (table, day): last updates, the clock and the volumes."""
    return H.daily_updates(X.table_updates(orders))


@query("table_freshness")
def q_freshness(spark, sf_dir):
    """Last update vs SLA per table (clock = latest update)."""
    H, X, orders = _health(spark, sf_dir)
    upd = _updates(H, X, orders)
    as_of = upd.agg(F.max("updated_at")).scalar()
    f = H.table_freshness(upd, X.table_slas(upd.withColumnRenamed("table_name", "o_orderpriority")), as_of)
    return f.select(
        "table_name", "last_updated_at", "sla_hours", py_round("lag_hours", 2).alias("lag_hours"), "stale",
        py_round("hours_late", 2).alias("hours_late"),
    )


@query("volume_anomalies")
def q_volume(spark, sf_dir):
    """Days whose volume fell >= 50% below the trailing 7-day mean."""
    H, X, orders = _health(spark, sf_dir)
    a = H.volume_anomalies(H.daily_volume(_updates(H, X, orders)), 7, 0.5)
    return a.select("table_name", "day", "volume", _r4("expected").alias("expected"), _r4("drop_pct").alias("drop_pct"))


def _schema_changes(spark, sf_dir):
    """Every year of the log against the one before; the types per year are written
    once, as first and last year and the changes all read them."""
    H, X, orders = _health(spark, sf_dir)
    return H.schema_changes_by_period(summaries.materialize(H.type_history(X.schema_observations(orders))))


@query("schema_changes")
def q_schema_changes(spark, sf_dir):
    """Columns added / removed / retyped in each year against the one before."""
    return _schema_changes(spark, sf_dir).select("table_name", "column_name", "period", "old_type", "new_type", "change")


@query("data_issues")
def q_data_issues(spark, sf_dir):
    """Stale, inconsistent and volume issues in one table."""
    H, X, orders = _health(spark, sf_dir)
    upd = summaries.materialize(_updates(H, X, orders))  # written once, read five times
    fresh = H.table_freshness(upd, X.table_slas(upd.withColumnRenamed("table_name", "o_orderpriority")), upd.agg(F.max("updated_at")).scalar())
    anomalies = H.volume_anomalies(H.daily_volume(upd), 7, 0.5)
    return H.data_issues(fresh, _schema_changes(spark, sf_dir), anomalies)


# ----------------------------------------------------- B: alerts (ours)


def _rules(spark):
    """The configured threshold rules (a config table, like the pricing entries)."""
    return spark.createDataFrame(
        [
            ("high_failure_rate", "job", "failure_rate", ">=", 0.3, "medium"),
            ("high_cost", "job", "total_cost", ">=", 150.0, "high"),
            ("busy_job", "job", "run_count", ">=", 80.0, "low"),
            ("missed_sla", "table", "hours_late", ">", 0.0, "high"),
        ],
        "rule_id string, subject_type string, metric string, op string, threshold double, severity string",
    )


def _alerts(spark, sf_dir):
    from fleetlens.operators import alerts as A
    from fleetlens.operators import observability as O

    d = _dash(spark, sf_dir)
    stats = O.profile_stats(O.run_profile(d.runs, d.window_start_ms))
    stats = stats.join(d.costed.groupBy("job_id").agg(money_sum("estimated_cost").alias("total_cost")), "job_id", "left")
    H, X, orders = _health(spark, sf_dir)
    upd = _updates(H, X, orders)
    fresh = H.table_freshness(upd, X.table_slas(upd.withColumnRenamed("table_name", "o_orderpriority")), upd.agg(F.max("updated_at")).scalar())
    metrics = A.melt_metrics(stats, "job", "job_id", ["failure_rate", "total_cost", "run_count"]).unionByName(
        A.melt_metrics(fresh, "table", "table_name", ["hours_late"])
    )
    return A, A.threshold_alerts(metrics, _rules(spark))


@query("threshold_alerts")
def q_threshold_alerts(spark, sf_dir):
    """Rule hits over job and table metrics (>= fires at equality)."""
    _, a = _alerts(spark, sf_dir)
    return a.select("rule_id", "severity", "subject_type", "subject_key", "metric", _r4("value").alias("value"))


@query("alert_counts")
def q_alert_counts(spark, sf_dir):
    """Threshold alerts per severity."""
    A, a = _alerts(spark, sf_dir)
    return A.alert_counts(a)


@query("cost_anomalies")
def q_cost_anomalies(spark, sf_dir):
    """Job-days >= 2 stddev from the trailing 7-active-day mean."""
    from fleetlens.operators import alerts as A

    d = _dash(spark, sf_dir)
    an = A.cost_anomalies(A.daily_job_cost(d.costed), 7, 2.0, 3)
    return an.select(
        "job_id", "day", _r4("cost").alias("cost"), _r4("baseline").alias("baseline"),
        _r4("baseline_stddev").alias("baseline_stddev"),
    )


# ---------------------------------------------------- F4 bars / P6 refresh


@query("cost_over_time_bars")
def q_cost_over_time_bars(spark, sf_dir):
    """G6 + F4: daily series with bar widths (floor 8%)."""
    b = summaries.cost_over_time_bars(_dash(spark, sf_dir).costed, 8.0)
    return b.select("date", "total_cost", "run_count", _r4("bar_pct").alias("bar_pct"))


@query("top_jobs_bars")
def q_top_jobs_bars(spark, sf_dir):
    """K6 + F4: eight most expensive jobs with bar widths (floor 10%)."""
    b = summaries.top_jobs_bars(_dash(spark, sf_dir).job_summaries(), 8, 10.0)
    return b.select("job_id", "job_name", "total_cost", _r4("bar_pct").alias("bar_pct"))


@query("pricing_config_refresh")
def q_config_refresh(spark, sf_dir):
    """Encode the config entries, refresh the discovered node types from
    the clusters (I12), decode again: the refreshed discovery list."""
    from fleetlens.sources import ingest

    ws = _ws(spark, sf_dir)
    stored = pricing.encode_config(ws.pricing_config, None, None)
    refreshed = pricing.refresh_discovered(stored, ingest.distinct_node_types(ws.clusters), "2024-01-31T00:00:00+00:00")
    entries, disc = pricing.decode_config(refreshed)
    n_entries = entries.agg(F.count("*")).scalar()
    return disc.select(F.col("ordinal").cast("long").alias("ordinal"), "node_type_id", n_entries.alias("entry_count"))


@query("data_issues_upstream")
def q_data_issues_upstream(spark, sf_dir):
    """B13 + B14: data issues with the one-hop upstream tables of their table."""
    H, X, orders = _health(spark, sf_dir)
    edges = X.lineage_edges(orders, X.table(spark, sf_dir, "lineitem"))
    issues = q_data_issues(spark, sf_dir)
    out = H.with_upstream(issues, edges)
    return out.select("issue_type", "table_name", "detail", F.array_join("upstream_tables", ",").alias("upstream_tables"))


@query("load_clusters_ordered")
def q_load_clusters(spark, sf_dir):
    """Clusters by id (the lookup side of C4, flattened)."""
    from fleetlens.sources import snapshot

    c = snapshot.load_clusters(_ws(spark, sf_dir).clusters)
    return c.select(
        "cluster_id", "node_type_id", "driver_node_type_id", "num_workers",
        F.col("autoscale.min_workers").alias("as_min"), F.col("autoscale.max_workers").alias("as_max"),
    )
