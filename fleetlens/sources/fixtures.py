"""Derive the domain tables (runs, jobs, clusters, pricing config) from the driver tables.

The driver's parquet tables hold no workspace metadata, so the rules below
build it column by column (see FIXTURES.md §3). Every rule is a column
expression over a full table scan: the derived tables grow with the inputs.
The DuckDB oracle in ``__spark_entry__`` repeats the same rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.session import app_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: str, n: int) -> Column:
    return F.col(c) % F.lit(n)


def _spec(node_type: Column, workers: Column | None = None, driver: Column | None = None,
          autoscale: Column | None = None) -> Column:
    null_s = F.lit(None).cast("string")
    null_i = F.lit(None).cast("int")
    return F.struct(
        null_s.alias("spark_version"),
        node_type.cast("string").alias("node_type_id"),
        (driver if driver is not None else null_s).cast("string").alias("driver_node_type_id"),
        (workers if workers is not None else null_i).cast("int").alias("num_workers"),
        (autoscale if autoscale is not None else F.lit(None).cast(S.AUTOSCALE)).alias("autoscale"),
        null_i.alias("autotermination_minutes"),
    )


def raw_run_fields(events: DataFrame) -> DataFrame:
    """Per-event columns shared by the typed runs and the raw JSON records."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("run_id"),
        F.when(_mod("event_id", 97) == 0, F.lit(None)).otherwise(F.col("user_id")).cast("long").alias("job_id"),
        F.when(_mod("event_id", 89) == 0, F.lit(None))
        .otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
        .cast("long")
        .alias("start_time"),
        F.when(_mod("event_id", 83) == 0, F.lit(None))
        .when(_mod("event_id", 79) == 0, F.lit(0))
        .otherwise(F.round(F.col("value") * F.lit(60000.0)))
        .cast("long")
        .alias("duration_ms"),
        F.col("event_type"),
        k.alias("k"),
        F.col("event_id"),
        F.col("ts"),
    )


def runs_from_events(events: DataFrame) -> DataFrame:
    """runs <- events (one run per event)."""
    r = raw_run_fields(events)
    k = F.col("k")
    spec = F.when(
        _mod("event_id", 3) == 0,
        _spec(
            F.when(_mod("event_id", 51) == 0, F.lit(None)).otherwise(F.concat(F.lit("NATION_"), (k % 26).cast("string"))),
            workers=k % 6,
        ),
    )
    instance = F.when(
        _mod("event_id", 3) == 1,
        F.struct(
            F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("cluster_id"),
            F.lit(None).cast("string").alias("spark_context_id"),
        ),
    )
    tags = F.when(
        _mod("event_id", 2) == 0,
        F.create_map(
            F.lit("Tables"),
            F.concat(F.lit("raw.t"), (k % 10).cast("string"), F.lit("; raw.t"), (k % 7).cast("string")),
        ),
    )
    state = F.struct(
        F.when(_mod("event_id", 101) == 0, F.lit("RUNNING")).otherwise(F.lit("TERMINATED")).alias("life_cycle_state"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("result_state"),
        F.lit(None).cast("string").alias("state_message"),
    )
    return r.select(
        "run_id",
        "job_id",
        F.concat(F.lit("run-"), F.col("event_type")).alias("run_name"),
        F.lit(None).cast("string").alias("creator_user_name"),
        F.concat(F.lit("/jobs/runs/"), F.col("run_id").cast("string")).alias("run_page_url"),
        F.lit("PERIODIC").alias("trigger"),
        "start_time",
        (F.col("start_time") + F.col("duration_ms")).alias("end_time"),
        "duration_ms",
        state.alias("state"),
        instance.alias("cluster_instance"),
        spec.cast(S.CLUSTER_SPEC).alias("cluster_spec"),
        tags.cast(S.TAGS).alias("tags"),
    )


def jobs_from_customers(customer: DataFrame) -> DataFrame:
    """jobs <- customer; every 13th key is left out so some runs have no job."""
    ck = F.col("c_custkey")
    tables = F.concat(F.lit("gold.n"), F.col("c_nationkey").cast("string"), F.lit(", silver.s"), (ck % 5).cast("string"))
    tags = F.when(ck % 11 == 0, F.create_map(F.lit("tables"), tables)).otherwise(
        F.create_map(F.lit("pipeline"), F.col("c_mktsegment"), F.lit("tables"), tables)
    )
    etl = F.struct(
        F.lit("main").alias("task_key"),
        F.lit(None).cast("string").alias("notebook_path"),
        F.lit("etl").alias("cluster_ref"),
    )
    adhoc = F.struct(
        F.lit("adhoc").alias("task_key"),
        F.lit(None).cast("string").alias("notebook_path"),
        F.lit("adhoc").alias("cluster_ref"),
    )
    tasks = F.when(ck % 7 == 0, F.array(etl, adhoc)).otherwise(F.array(etl))
    job_clusters = F.array(
        F.struct(
            F.lit("etl").alias("job_cluster_key"),
            _spec(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), workers=ck % 4).alias("new_cluster"),
        )
    )
    schedule = F.struct(
        F.lit("0 0 * * * ?").alias("quartz_cron_expression"),
        F.lit("UTC").alias("timezone_id"),
        F.when(ck % 19 == 0, F.lit("PAUSED")).otherwise(F.lit("UNPAUSED")).alias("pause_status"),
    )
    return customer.where(ck % 13 != 0).select(
        ck.cast("long").alias("job_id"),
        F.col("c_name").alias("name"),
        F.when(ck % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("owner"), ck.cast("string"))).alias("creator_user_name"),
        F.lit(None).cast("long").alias("created_time"),
        tags.cast(S.TAGS).alias("tags"),
        schedule.alias("schedule"),
        F.lit(1).alias("max_concurrent_runs"),
        tasks.cast(S.JOBS["tasks"].dataType).alias("tasks"),
        job_clusters.cast(S.JOBS["job_clusters"].dataType).alias("job_clusters"),
    )


def clusters_from_suppliers(supplier: DataFrame) -> DataFrame:
    """clusters <- supplier (cluster id = supplier name)."""
    sk = F.col("s_suppkey")
    nk = F.col("s_nationkey")
    autoscaled = sk % 5 == 0
    return supplier.select(
        F.col("s_name").alias("cluster_id"),
        F.col("s_name").alias("cluster_name"),
        F.lit(None).cast("string").alias("spark_version"),
        F.concat(F.lit("NATION_"), nk.cast("string")).alias("node_type_id"),
        F.when(sk % 3 == 0, F.concat(F.lit("NATION_"), ((nk + 1) % 25).cast("string"))).alias("driver_node_type_id"),
        F.when(~autoscaled, sk % 8).cast("int").alias("num_workers"),
        F.when(autoscaled, F.struct((sk % 4).cast("int").alias("min_workers"), (sk % 4 + 4).cast("int").alias("max_workers")))
        .cast(S.AUTOSCALE)
        .alias("autoscale"),
        F.lit(None).cast("int").alias("autotermination_minutes"),
    )


def pricing_config_from_nations(nation: DataFrame) -> DataFrame:
    """pricing config entries <- nation (every nation key ending in 9 is unpriced)."""
    nk = F.col("n_nationkey")
    return nation.select(
        F.col("n_name").alias("node_type_id"),
        F.when(nk % 10 == 9, F.lit(0.0)).otherwise(F.lit(0.5) + F.lit(0.5) * F.col("n_regionkey")).cast("double").alias("dbus_per_hour"),
        F.when(nk % 2 == 0, F.lit("premium")).otherwise(F.lit("enterprise")).alias("plan"),
    )


@dataclass(frozen=True)
class Workspace:
    """The four domain tables plus the analysis clock, derived from one sf folder."""

    runs: DataFrame
    jobs: DataFrame
    clusters: DataFrame
    pricing_config: DataFrame
    as_of_ms: int


_AS_OF: dict[tuple[str, str], int] = {}


def _as_of_ms(spark: SparkSession, sf_dir: str) -> int:
    key = (app_id(spark), sf_dir)
    if key not in _AS_OF:
        _AS_OF[key] = _compute_as_of_ms(spark, sf_dir)
    return _AS_OF[key]


def _compute_as_of_ms(spark: SparkSession, sf_dir: str) -> int:
    row = _table(spark, sf_dir, "events").agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("m")).first()
    return int(row["m"]) if row and row["m"] is not None else 0


def as_of_ms(spark: SparkSession, sf_dir: str) -> int:
    """Analysis clock for the fixtures: the latest event time (one-row aggregate)."""
    return _as_of_ms(spark, sf_dir)


_WORKSPACES: dict[tuple[str, str], Workspace] = {}


def load_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The derived workspace of ``sf_dir`` (lazy DataFrames, built once per
    session and folder: they are immutable plans, reused by every view)."""
    key = (app_id(spark), sf_dir)
    ws = _WORKSPACES.get(key)
    if ws is None:
        ws = _WORKSPACES[key] = _build_workspace(spark, sf_dir)
    return ws


def _build_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    from fleetlens.plans.joins import spread_small_input

    return Workspace(
        runs=runs_from_events(spread_small_input(_table(spark, sf_dir, "events"))),
        jobs=jobs_from_customers(_table(spark, sf_dir, "customer")),
        clusters=clusters_from_suppliers(_table(spark, sf_dir, "supplier")),
        pricing_config=pricing_config_from_nations(_table(spark, sf_dir, "nation")),
        as_of_ms=as_of_ms(spark, sf_dir),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)


# ------------------------------------------------------------ raw JSON records


def raw_runs_json(events: DataFrame) -> DataFrame:
    """Landed run records (one JSON document per row) <- events.

    Variations exercised by the ingest rules: ``run_duration`` 0 on every 5th
    event (falls back to ``execution_duration``, missing on every 7th, then to
    end - start); ids as JSON strings on every 4th event; the cluster spec
    wrapped in ``new_cluster`` on even events.
    """
    r = raw_run_fields(events)
    eid, k = F.col("event_id"), F.col("k")
    dur = F.col("duration_ms")
    spec = F.struct(
        F.when(eid % 51 == 0, F.lit(None)).otherwise(F.concat(F.lit("NATION_"), (k % 26).cast("string"))).alias("node_type_id"),
        (k % 6).cast("int").alias("num_workers"),
    )
    record = F.struct(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("job_id"),
        F.col("start_time"),
        (F.col("start_time") + dur).alias("end_time"),
        F.when(eid % 5 == 0, F.lit(0).cast("bigint")).otherwise(dur).alias("run_duration"),
        F.when(eid % 7 == 0, F.lit(None).cast("bigint")).otherwise(dur).alias("execution_duration"),
        F.struct(
            F.when(eid % 101 == 0, F.lit("RUNNING")).otherwise(F.lit("TERMINATED")).alias("life_cycle_state"),
            F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("result_state"),
        ).alias("state"),
        F.when(eid % 3 == 1, F.struct(F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("cluster_id"))).alias(
            "cluster_instance"
        ),
        F.when(eid % 2 == 0, F.create_map(F.lit("Tables"), F.concat(F.lit("raw.t"), (k % 10).cast("string")))).alias("tags"),
    )
    # The id stays a JSON string ("123") on every 4th record, a number elsewhere.
    js = F.to_json(record)
    js = F.when(eid % 4 != 0, F.regexp_replace(js, r'^\{"run_id":"(\d+)"', '{"run_id":$1')).otherwise(js)
    # The spec is appended as text: flat on odd events, wrapped in new_cluster on even ones.
    spec_js = F.to_json(spec)
    spec_js = F.when(eid % 2 == 0, F.concat(F.lit('{"new_cluster":'), spec_js, F.lit("}"))).otherwise(spec_js)
    body = F.expr("left(j, length(j) - 1)")
    out = r.select(js.alias("j"), F.when(eid % 3 == 0, spec_js).alias("s"))
    return out.select(
        F.when(F.col("s").isNull(), F.col("j")).otherwise(F.concat(body, F.lit(',"cluster_spec":'), F.col("s"), F.lit("}"))).alias("value")
    )


def raw_jobs_json(customer: DataFrame) -> DataFrame:
    """Landed job records <- customer (all customers; settings nested as in the API).

    Variations: empty name on every 23rd key (name falls back to the id); a
    second task on every 7th key that points at an existing cluster instead of
    a job cluster; a task without key on every 29th; an extra job cluster
    without key on every 3rd (dropped on ingest); no tags on every 11th.
    """
    ck = F.col("c_custkey")
    main = F.struct(
        F.when(ck % 29 == 0, F.lit(None)).otherwise(F.lit("main")).alias("task_key"),
        F.lit("etl").alias("job_cluster_key"),
        F.struct(F.concat(F.lit("/jobs/"), ck.cast("string")).alias("notebook_path")).alias("notebook_task"),
    )
    second = F.struct(
        F.lit("adhoc").alias("task_key"),
        F.lit(None).cast("string").alias("job_cluster_key"),
        F.struct(F.lit(None).cast("string").alias("notebook_path")).alias("notebook_task"),
        F.concat(F.lit("cluster-"), ck.cast("string")).alias("existing_cluster_id"),
    )
    main_full = F.struct(
        main["task_key"].alias("task_key"), main["job_cluster_key"].alias("job_cluster_key"),
        main["notebook_task"].alias("notebook_task"), F.lit(None).cast("string").alias("existing_cluster_id"),
    )
    tasks = F.when(ck % 7 == 0, F.array(main_full, second)).otherwise(F.array(main_full))
    new_cluster = F.struct(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("node_type_id"),
        (ck % 4).cast("int").alias("num_workers"),
    )
    good = F.struct(F.lit("etl").alias("job_cluster_key"), new_cluster.alias("new_cluster"))
    bad = F.struct(F.lit(None).cast("string").alias("job_cluster_key"), new_cluster.alias("new_cluster"))
    job_clusters = F.when(ck % 3 == 0, F.array(good, bad)).otherwise(F.array(good))
    tags = F.when(ck % 11 == 0, F.lit(None).cast("map<string,string>")).otherwise(
        F.create_map(F.lit("pipeline"), F.col("c_mktsegment"))
    )
    settings = F.struct(
        F.when(ck % 23 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        tags.alias("tags"),
        F.struct(F.when(ck % 19 == 0, F.lit("PAUSED")).otherwise(F.lit("UNPAUSED")).alias("pause_status")).alias("schedule"),
        tasks.alias("tasks"),
        job_clusters.alias("job_clusters"),
    )
    record = F.struct(
        ck.alias("job_id"),
        F.when(ck % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("owner"), ck.cast("string"))).alias("creator_user_name"),
        settings.alias("settings"),
    )
    return customer.select(F.to_json(record).alias("value"))


def raw_clusters_json(supplier: DataFrame) -> DataFrame:
    """Landed cluster records <- supplier. ``num_workers`` is a JSON string on
    every 4th key; autoscale misses its upper bound on every 10th (-> NULL)."""
    sk, nk = F.col("s_suppkey"), F.col("s_nationkey")
    auto = F.when(
        sk % 5 == 0,
        F.struct((sk % 4).cast("int").alias("min_workers"), F.when(sk % 10 != 0, (sk % 4 + 4).cast("int")).alias("max_workers")),
    )
    workers = F.when(sk % 5 != 0, (sk % 8).cast("int"))
    record = F.struct(
        F.col("s_name").alias("cluster_id"),
        F.col("s_name").alias("cluster_name"),
        F.concat(F.lit("NATION_"), nk.cast("string")).alias("node_type_id"),
        F.when(sk % 3 == 0, F.concat(F.lit("NATION_"), ((nk + 1) % 25).cast("string"))).alias("driver_node_type_id"),
        F.when(sk % 4 == 0, workers.cast("string")).alias("nw_text"),
        F.when(sk % 4 != 0, workers).alias("num_workers"),
        auto.alias("autoscale"),
    )
    js = F.to_json(record)
    # move the text form into num_workers (a JSON string, e.g. "3")
    js = F.regexp_replace(js, r'"nw_text":"(\d+)"', '"num_workers":"$1"')
    return supplier.select(js.alias("value"))


DAY_MS = 86_400_000


def raw_run_restarts(events: DataFrame) -> DataFrame:
    """Later records of every third run and of those without a start: started a
    day after the event, twice as long."""
    r = raw_run_fields(events.where((_mod("event_id", 3) == 0) | (_mod("event_id", 89) == 0)))
    restart = (F.unix_millis(F.col("ts").cast("timestamp")) + DAY_MS).alias("start_time")
    return r.select(F.to_json(F.struct("run_id", "job_id", restart, (F.col("duration_ms") * 2).alias("run_duration"))).alias("value"))


def raw_run_corrections(events: DataFrame) -> DataFrame:
    """Still later records of every fifth run: a millisecond longer, as first started."""
    r = raw_run_fields(events.where(_mod("event_id", 5) == 0))
    return r.select(F.to_json(F.struct("run_id", "job_id", "start_time", (F.col("duration_ms") + 1).alias("run_duration"))).alias("value"))


def raw_job_renames(customer: DataFrame) -> DataFrame:
    """Later records of every fourth job: a new name, nothing else set."""
    c = customer.where(_mod("c_custkey", 4) == 0)
    return c.select(F.to_json(F.struct(F.col("c_custkey").alias("job_id"), F.struct(F.concat(F.lit("a new name of "), "c_name").alias("name")).alias("settings"))).alias("value"))


def raw_cluster_resizes(supplier: DataFrame) -> DataFrame:
    """Later records of every third cluster: 9 workers, an earlier name."""
    c = supplier.where(_mod("s_suppkey", 3) == 0)
    return c.select(F.to_json(F.struct(F.col("s_name").alias("cluster_id"), F.lit("A").alias("cluster_name"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("node_type_id"), F.lit(9).alias("num_workers"))).alias("value"))


# ---------------------------------------------------------- table health logs


def table_updates(orders: DataFrame) -> DataFrame:
    """Update log <- orders: each order is a one-row write to the table named
    by its priority, at its order date."""
    return orders.select(
        F.col("o_orderpriority").alias("table_name"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(1).cast("long").alias("row_count"),
    )


def table_slas(orders: DataFrame) -> DataFrame:
    """SLA per table: 12 hours times the priority digit (1-URGENT -> 12 h)."""
    return (
        orders.select(F.col("o_orderpriority").alias("table_name"))
        .distinct()
        .select("table_name", (F.lit(12.0) * F.substring("table_name", 1, 1).cast("double")).alias("sla_hours"))
    )


def schema_observations(orders: DataFrame) -> DataFrame:
    """Schema log <- orders: table = priority, column = c<custkey mod 200>,
    type = order status, observed at the order date."""
    return orders.select(
        F.col("o_orderpriority").alias("table_name"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 200).cast("string")).alias("column_name"),
        F.col("o_orderstatus").alias("data_type"),
        F.col("o_orderdate").alias("observed_at"),
    )


def lineage_edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Upstream edges <- lineitem joined to orders: the table named by an
    order's priority is fed by the line-item slice of each return flag its
    lines carry (table_name, upstream_table), distinct."""
    return (
        lineitem.select("l_orderkey", "l_returnflag")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
        .select(
            F.col("o_orderpriority").alias("table_name"),
            F.concat(F.lit("lineitem_"), F.col("l_returnflag")).alias("upstream_table"),
        )
        .distinct()
    )
