"""DuckDB SQL recomputing each registered query from the driver tables.

Used only by the parity check (``__spark_entry__.oracle_sql``). The fixture
rules of ``sources.fixtures`` are repeated as CTEs; the costing rules are
written directly in SQL. Literal and cast rules that keep both engines
bit-identical: doubles as ``::DOUBLE``, epoch ms as ``epoch_us(ts) // 1000``,
Python-style rounding as ``CAST(printf('%.Nf', x) AS DOUBLE)``.
"""

from __future__ import annotations

WINDOW_DAYS = 30


def r(expr: str, n: int) -> str:
    """Python round(x, n) in DuckDB."""
    return f"CAST(printf('%.{n}f', {expr}) AS DOUBLE)"


def msum(expr: str, filt: str = "") -> str:
    """Sum of unrounded costs as exact decimals."""
    return f"CAST(sum(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18))){filt} AS DOUBLE)"


def split_sql(expr: str) -> str:
    """Split a tag value on , ; newline, strip whitespace, drop empty parts (NULL -> [])."""
    return (
        "coalesce(list_filter(list_transform(string_split_regex("
        + expr
        + ", '[,;\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), [])"
    )


BASE = r"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
runs AS (
  SELECT event_id AS run_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS job_id,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS start_time,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 0
         ELSE CAST(round(value * 60000) AS BIGINT) END AS duration_ms,
    event_type,
    CASE WHEN event_id % 101 = 0 THEN 'RUNNING' ELSE 'TERMINATED' END AS life_cycle_state,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS result_state,
    event_id % 3 = 0 AS has_spec,
    CASE WHEN event_id % 3 = 0 AND event_id % 51 <> 0 THEN 'NATION_' || (k % 26) END AS spec_node,
    CASE WHEN event_id % 3 = 0 THEN k % 6 END AS spec_workers,
    CASE WHEN event_id % 3 = 1 THEN 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') END AS cluster_id,
    CASE WHEN event_id % 2 = 0 THEN 'raw.t' || (k % 10) || '; raw.t' || (k % 7) END AS run_tables_tag,
    '/jobs/runs/' || event_id AS run_page_url,
    k
  FROM ev
),
jobs AS (
  SELECT c_custkey AS job_id, c_name AS name,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS pipeline_tag,
    'gold.n' || c_nationkey || ', silver.s' || (c_custkey % 5) AS tables_tag,
    c_custkey % 7 = 0 AS ambiguous,
    'NATION_' || c_nationkey AS jc_node,
    CAST(c_custkey % 4 AS INTEGER) AS jc_workers,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'owner' || c_custkey END AS creator_user_name,
    CASE WHEN c_custkey % 19 = 0 THEN 'PAUSED' ELSE 'UNPAUSED' END AS pause_status
  FROM customer WHERE c_custkey % 13 <> 0
),
clusters AS (
  SELECT s_name AS cluster_id, 'NATION_' || s_nationkey AS node_type_id,
    CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || ((s_nationkey + 1) % 25) END AS driver_node_type_id,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 8 AS INTEGER) END AS num_workers,
    CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 4 AS INTEGER) END AS as_min,
    CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 4 + 4 AS INTEGER) END AS as_max
  FROM supplier
),
pricing_config AS (
  SELECT n_name AS node_type_id,
    CASE WHEN n_nationkey % 10 = 9 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * n_regionkey END AS dbus_per_hour,
    CASE WHEN n_nationkey % 2 = 0 THEN 'premium' ELSE 'enterprise' END AS plan
  FROM nation
),
rates AS (
  SELECT node_type_id,
    dbus_per_hour * CASE WHEN plan = 'premium' THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END AS rate,
    'USD' AS currency
  FROM pricing_config WHERE dbus_per_hour > 0
),
params AS (SELECT (SELECT epoch_us(max(ts)) // 1000 FROM events) AS as_of_ms)
"""


def resolved_cte(window_days: int = WINDOW_DAYS, strategy: str = "average") -> str:
    if strategy == "max":
        scaled = "c.as_max::DOUBLE"
    elif strategy == "min":
        scaled = "c.as_min::DOUBLE"
    else:
        scaled = "(c.as_min::DOUBLE + c.as_max::DOUBLE) / 2.0::DOUBLE"
    return f"""
loaded AS (
  SELECT r.* FROM runs r, params p
  WHERE r.start_time IS NULL OR r.start_time >= p.as_of_ms - {int(window_days)} * CAST(86400000 AS BIGINT)
),
resolved AS (
  SELECT l.*,
    CASE WHEN l.has_spec THEN 'run.cluster_spec'
         WHEN c.cluster_id IS NOT NULL THEN 'cluster_lookup'
         WHEN j.job_id IS NOT NULL AND NOT j.ambiguous THEN 'job.job_clusters'
         ELSE 'unresolved' END AS source,
    CASE WHEN l.has_spec THEN l.spec_node
         WHEN c.cluster_id IS NOT NULL THEN c.node_type_id
         WHEN j.job_id IS NOT NULL AND NOT j.ambiguous THEN j.jc_node END AS node_type_id,
    CASE WHEN l.has_spec THEN NULL WHEN c.cluster_id IS NOT NULL THEN c.driver_node_type_id END AS driver_raw,
    CASE WHEN l.has_spec THEN l.spec_workers::DOUBLE
         WHEN c.cluster_id IS NOT NULL THEN coalesce(c.num_workers::DOUBLE, {scaled}, 0.0::DOUBLE)
         WHEN j.job_id IS NOT NULL AND NOT j.ambiguous THEN j.jc_workers::DOUBLE
         ELSE 0.0::DOUBLE END AS workers,
    j.job_id IS NOT NULL AS job_found,
    j.name AS job_name_raw,
    list_distinct(list_concat({split_sql('l.run_tables_tag')},
      CASE WHEN j.job_id IS NULL THEN [] ELSE {split_sql('j.tables_tag')} END)) AS table_keys,
    CASE WHEN j.job_id IS NULL THEN [] ELSE {split_sql('j.pipeline_tag')} END AS pipeline_keys
  FROM loaded l
  LEFT JOIN clusters c ON l.cluster_id = c.cluster_id
  LEFT JOIN jobs j ON l.job_id = j.job_id
)"""


def costed_cte(include_driver: bool = True) -> str:
    if include_driver:
        return """
costed AS (
  SELECT x.run_id, x.job_id, x.start_time, x.duration_ms, x.source, x.node_type_id, x.run_page_url,
    x.table_keys, x.pipeline_keys, w.currency, x.workers,
    coalesce(x.driver_raw, x.node_type_id) AS driver_node_type_id,
    x.workers + 1.0::DOUBLE AS billable_nodes,
    w.rate * x.workers + d.rate AS hourly_rate,
    (w.rate * x.workers + d.rate) * (x.duration_ms / 3600000.0::DOUBLE) AS estimated_cost
  FROM resolved x
  JOIN rates w ON w.node_type_id = x.node_type_id
  JOIN rates d ON d.node_type_id = coalesce(x.driver_raw, x.node_type_id)
  WHERE x.duration_ms > 0 AND x.job_id IS NOT NULL
)"""
    return """
costed AS (
  SELECT x.run_id, x.job_id, x.start_time, x.duration_ms, x.source, x.node_type_id, x.run_page_url,
    x.table_keys, x.pipeline_keys, w.currency, x.workers,
    coalesce(x.driver_raw, x.node_type_id) AS driver_node_type_id,
    x.workers AS billable_nodes,
    w.rate * x.workers AS hourly_rate,
    (w.rate * x.workers) * (x.duration_ms / 3600000.0::DOUBLE) AS estimated_cost
  FROM resolved x
  JOIN rates w ON w.node_type_id = x.node_type_id
  WHERE x.duration_ms > 0 AND x.job_id IS NOT NULL
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in (BASE, *ctes))


def costed_sql(body: str, *, window_days: int = WINDOW_DAYS, strategy: str = "average", include_driver: bool = True,
               extra: tuple[str, ...] = ()) -> str:
    return with_ctes(resolved_cte(window_days, strategy), costed_cte(include_driver), *extra) + "\n" + body


RUN_COST_COLS = f"""run_id, job_id, currency, {r('estimated_cost', 4)} AS estimated_cost, duration_ms,
  billable_nodes, {r('hourly_rate', 4)} AS hourly_rate, source"""

JOB_AGG = f"""
job_agg AS (
  SELECT job_id, {msum('estimated_cost')} AS units, {msum('estimated_cost')} AS total_cost,
    count(*) AS run_count, max(start_time) AS last_run_time
  FROM costed GROUP BY job_id
),
job_sum AS (
  SELECT a.job_id, coalesce(j.name, 'job-' || a.job_id) AS job_name, a.total_cost,
    CASE WHEN t.total <> 0 THEN a.total_cost / t.total ELSE 0.0 END AS cost_share,
    a.run_count, a.total_cost / a.run_count AS avg_cost_per_run, a.last_run_time,
    (SELECT coalesce(arg_max(currency, coalesce(start_time, -9223372036854775808)), 'USD') FROM costed) AS currency
  FROM job_agg a LEFT JOIN jobs j ON a.job_id = j.job_id,
    (SELECT coalesce({msum('estimated_cost')}, 0.0) AS total FROM costed) t
)"""


def named_agg(keys: str, name: str, window_days: int = WINDOW_DAYS) -> str:
    days = float(max(1, window_days))
    return f"""
{name}_x AS (
  SELECT c.run_id, c.start_time, c.currency, u.key, c.estimated_cost / len(c.{keys}) AS share
  FROM costed c, unnest(c.{keys}) AS u(key)
  WHERE len(c.{keys}) > 0
  UNION ALL
  SELECT c.run_id, c.start_time, c.currency, NULL, c.estimated_cost FROM costed c WHERE len(c.{keys}) = 0
),
{name}_all AS (
  SELECT key, {msum('share')} AS total_cost, {msum('share')} AS units,
    count(*) AS run_count, max(start_time) AS last_seen_time
  FROM {name}_x GROUP BY key
),
{name}_sum AS (
  SELECT key, key AS label, total_cost,
    CASE WHEN g.t <> 0 THEN total_cost / g.t ELSE 0.0 END AS cost_share,
    run_count, total_cost / run_count AS avg_cost_per_run,
    total_cost / {days}::DOUBLE AS cost_per_day, run_count AS attribution_count, last_seen_time
  FROM {name}_all, (SELECT {msum('estimated_cost')} AS t FROM costed) g
  WHERE key IS NOT NULL
)"""


JOB_PRESENT = f"""job_id, job_name, {r('total_cost', 2)} AS total_cost, {r('cost_share', 4)} AS cost_share, run_count,
  {r('avg_cost_per_run', 2)} AS avg_cost_per_run, last_run_time"""

NAMED_PRESENT = f"""key, label, {r('total_cost', 2)} AS total_cost, {r('cost_share', 4)} AS cost_share, run_count,
  {r('avg_cost_per_run', 2)} AS avg_cost_per_run, {r('cost_per_day', 2)} AS cost_per_day, attribution_count,
  last_seen_time"""


def pct(expr: str) -> str:
    return f"printf('%.1f', ({expr}) * 100.0::DOUBLE) || '%'"


def money(expr: str) -> str:
    return f"printf('%.2f', {expr})"


def insights_sql(threshold: float = 0.35, where: str = "") -> str:
    body = f"""
SELECT kind, subject_type, subject_key, message, {r('metric_value', 4)} AS metric_value, currency,
  CAST(row_number() OVER (ORDER BY grp, rnk, sub) - 1 AS BIGINT) AS position
FROM (
  SELECT 0 AS grp, rnk, 0 AS sub, 'expensive_job' AS kind, 'job' AS subject_type, CAST(job_id AS VARCHAR) AS subject_key,
    'Job ''' || job_name || ''' accounts for ' || {pct('cost_share')} || ' of total cost with ' || {money('total_cost')} || ' ' || currency || '.' AS message,
    total_cost AS metric_value, currency
  FROM top_j
  UNION ALL
  SELECT 0, rnk, 1, 'dominant_cost_share', 'job', CAST(job_id AS VARCHAR),
    'Job ''' || job_name || ''' exceeds the configured cost share threshold at ' || {pct('cost_share')} || ' of total spend.',
    cost_share, currency
  FROM top_j WHERE cost_share >= {float(threshold)}::DOUBLE
  UNION ALL
  SELECT 1, rnk, 0, 'expensive_pipeline', 'pipeline', key,
    'Pipeline ''' || label || ''' accounts for ' || {pct('cost_share')} || ' of total cost with ' || {money('total_cost')} || ' ' || cur || '.',
    total_cost, cur
  FROM top_p
  UNION ALL
  SELECT 2, rnk, 0, 'expensive_table', 'table', key,
    'Table ''' || label || ''' costs ' || {money('cost_per_day')} || ' ' || cur || ' per day to maintain in this window.',
    cost_per_day, cur
  FROM top_t
) z
WHERE (SELECT coalesce(sum(estimated_cost), 0.0) FROM costed) > 0
"""
    tops = """
top_j AS (
  SELECT *, row_number() OVER (ORDER BY total_cost DESC, last_run_time DESC NULLS LAST, job_id) - 1 AS rnk
  FROM job_sum ORDER BY total_cost DESC, last_run_time DESC NULLS LAST, job_id LIMIT 3
),
top_p AS (
  SELECT *, (SELECT currency FROM job_sum LIMIT 1) AS cur,
    row_number() OVER (ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key) - 1 AS rnk
  FROM pipe_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 3
),
top_t AS (
  SELECT *, (SELECT currency FROM job_sum LIMIT 1) AS cur,
    row_number() OVER (ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key) - 1 AS rnk
  FROM tab_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 3
)"""
    sql = costed_sql(
        body,
        extra=(JOB_AGG, named_agg("pipeline_keys", "pipe"), named_agg("table_keys", "tab"), tops),
    )
    if where:
        sql = f"SELECT * FROM ({sql}) q WHERE {where}"
    return sql


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["run_costs"] = costed_sql(f"SELECT {RUN_COST_COLS} FROM costed")
    q["run_costs_no_driver"] = costed_sql(f"SELECT {RUN_COST_COLS} FROM costed", include_driver=False)
    for strat, key in (("average", "worker_count_avg"), ("min", "worker_count_min"), ("max", "worker_count_max")):
        q[key] = costed_sql(f"SELECT run_id, billable_nodes, {r('estimated_cost', 4)} AS estimated_cost FROM costed", strategy=strat)
    q["cost_by_source"] = costed_sql(
        f"SELECT source, count(*) AS run_count, {r(msum('estimated_cost'), 2)} AS total_cost FROM costed GROUP BY source"
    )
    q["runs_in_window"] = with_ctes() + """
SELECT run_id, job_id, start_time FROM runs, params p
WHERE start_time IS NULL OR start_time >= p.as_of_ms - 7 * CAST(86400000 AS BIGINT)"""
    q["billable_runs"] = with_ctes() + "\nSELECT run_id, duration_ms FROM runs WHERE duration_ms > 0"
    q["cluster_lookup_join"] = with_ctes() + """
SELECT r.run_id, r.cluster_id, c.node_type_id, c.cluster_id IS NOT NULL AS found
FROM runs r LEFT JOIN clusters c ON r.cluster_id = c.cluster_id"""
    q["job_cluster_resolution"] = with_ctes() + """
SELECT job_id, CASE WHEN ambiguous THEN NULL ELSE 'etl' END AS cluster_ref,
  CASE WHEN ambiguous THEN NULL ELSE jc_node END AS node_type_id,
  CASE WHEN ambiguous THEN NULL ELSE jc_workers END AS num_workers,
  NOT ambiguous AS resolved
FROM jobs"""
    q["run_job_join"] = with_ctes() + """
SELECT r.run_id, r.job_id,
  CASE WHEN r.job_id IS NOT NULL THEN coalesce(j.name, 'job-' || r.job_id) END AS job_name,
  j.job_id IS NOT NULL AS job_found
FROM runs r LEFT JOIN jobs j ON r.job_id = j.job_id"""
    q["uncosted_runs_by_reason"] = with_ctes(resolved_cte()) + """
SELECT reason, count(*) AS run_count FROM (
  SELECT CASE
    WHEN x.duration_ms IS NULL OR x.duration_ms <= 0 THEN 'no_billable_duration'
    WHEN x.source = 'unresolved' THEN 'unresolved_cluster'
    WHEN x.node_type_id IS NULL THEN 'no_node_type'
    WHEN w.node_type_id IS NULL THEN 'unpriced_worker'
    WHEN d.node_type_id IS NULL THEN 'unpriced_driver'
    WHEN x.job_id IS NULL THEN 'no_job' END AS reason
  FROM resolved x
  LEFT JOIN rates w ON w.node_type_id = x.node_type_id
  LEFT JOIN rates d ON d.node_type_id = coalesce(x.driver_raw, x.node_type_id)
) z WHERE reason IS NOT NULL GROUP BY reason"""
    # attribution
    q["tag_values_split"] = with_ctes() + f"""
SELECT job_id, CAST(pos - 1 AS BIGINT) AS pos, value FROM (
  SELECT job_id, unnest(v) AS value, generate_subscripts(v, 1) AS pos
  FROM (SELECT job_id, {split_sql('tables_tag')} AS v FROM jobs)
)"""
    q["run_table_keys"] = costed_sql(
        "SELECT run_id, CAST(len(table_keys) AS BIGINT) AS key_count, array_to_string(list_sort(table_keys), '|') AS keys, "
        "CAST(len(pipeline_keys) AS BIGINT) AS pipeline_key_count FROM costed"
    )
    q["cost_attribution_exploded"] = costed_sql(
        f"SELECT c.run_id, u.key, {r('c.estimated_cost / len(c.table_keys)', 4)} AS share "
        "FROM costed c, unnest(c.table_keys) AS u(key) WHERE len(c.table_keys) > 0"
    )
    # summaries
    q["total_cost"] = costed_sql(
        f"SELECT coalesce(arg_max(currency, coalesce(start_time, -9223372036854775808)), 'USD') AS currency, "
        f"{r('coalesce(' + msum('estimated_cost') + ', 0.0)', 2)} AS total_cost, count(*) AS run_count FROM costed"
    )
    q["cost_by_job"] = costed_sql(f"SELECT {JOB_PRESENT} FROM job_sum", extra=(JOB_AGG,))
    q["top_jobs"] = costed_sql(
        f"SELECT {JOB_PRESENT} FROM job_sum ORDER BY total_cost DESC, last_run_time DESC NULLS LAST, job_id LIMIT 10",
        extra=(JOB_AGG,),
    )
    q["cost_by_pipeline"] = costed_sql(f"SELECT {NAMED_PRESENT} FROM pipe_sum", extra=(named_agg("pipeline_keys", "pipe"),))
    q["cost_by_table"] = costed_sql(f"SELECT {NAMED_PRESENT} FROM tab_sum", extra=(named_agg("table_keys", "tab"),))
    q["top_pipelines"] = costed_sql(
        f"SELECT {NAMED_PRESENT} FROM pipe_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 3",
        extra=(named_agg("pipeline_keys", "pipe"),),
    )
    q["top_tables"] = costed_sql(
        f"SELECT {NAMED_PRESENT} FROM tab_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 8",
        extra=(named_agg("table_keys", "tab"),),
    )
    q["cost_over_time"] = costed_sql(
        f"SELECT strftime(make_timestamp(start_time * 1000), '%Y-%m-%d') AS date, {r(msum('estimated_cost'), 2)} AS total_cost, "
        "count(*) AS run_count FROM costed WHERE start_time IS NOT NULL GROUP BY 1"
    )
    q["summary_kpis"] = costed_sql(
        f"""
SELECT CAST({WINDOW_DAYS} AS INTEGER) AS window_days,
  coalesce((SELECT arg_max(currency, coalesce(start_time, -9223372036854775808)) FROM costed), 'USD') AS currency,
  {r('coalesce(sum(units), 0.0)', 2)} AS total_cost,
  CAST(coalesce(sum(run_count), 0) AS BIGINT) AS run_count,
  count(*) AS job_count,
  (SELECT count(*) FROM pipe_sum) AS pipeline_count,
  (SELECT count(*) FROM tab_sum) AS table_count,
  CASE WHEN coalesce(sum(run_count), 0) > 0 THEN {r('(sum(units)) / sum(run_count)', 2)} ELSE 0.0 END AS avg_cost_per_run,
  (SELECT job_name FROM job_sum ORDER BY total_cost DESC, last_run_time DESC NULLS LAST, job_id LIMIT 1) AS most_expensive_job,
  (SELECT label FROM pipe_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 1) AS most_expensive_pipeline,
  (SELECT label FROM tab_sum ORDER BY total_cost DESC, last_seen_time DESC NULLS LAST, key LIMIT 1) AS most_expensive_table,
  CAST(NULL AS VARCHAR) AS last_sync_at
FROM job_agg""",
        extra=(JOB_AGG, named_agg("pipeline_keys", "pipe"), named_agg("table_keys", "tab")),
    )
    q["coverage"] = costed_sql(
        """
SELECT (SELECT count(*) FROM loaded) AS total_runs,
  (SELECT count(*) FROM costed) AS costed_runs,
  greatest((SELECT count(*) FROM loaded) - (SELECT count(*) FROM costed), 0) AS uncosted_runs,
  (SELECT string_agg(node_type_id, ',' ORDER BY node_type_id) FROM rates) AS priced_node_types"""
    )
    q["top_runs_by_cost"] = costed_sql(f"SELECT {RUN_COST_COLS} FROM costed ORDER BY estimated_cost DESC, run_id LIMIT 20")
    q["recent_runs"] = costed_sql(
        f"""
SELECT c.run_id, c.job_id, coalesce(j.name, 'job-' || c.job_id) AS job_name, {r('c.estimated_cost', 2)} AS estimated_cost,
  c.duration_ms, c.start_time, c.run_page_url, c.currency, c.source
FROM (SELECT * FROM costed ORDER BY coalesce(start_time, 0) DESC, estimated_cost DESC, run_id LIMIT 20) c
LEFT JOIN jobs j ON c.job_id = j.job_id"""
    )
    presets = " UNION ALL ".join(
        f"SELECT {d} AS window_days, {r('coalesce(' + msum('estimated_cost', ' FILTER (WHERE start_time IS NULL OR start_time >= (SELECT as_of_ms FROM params) - ' + str(d) + ' * CAST(86400000 AS BIGINT))') + ', 0.0)', 2)} AS total_cost, "
        f"count(*) FILTER (WHERE start_time IS NULL OR start_time >= (SELECT as_of_ms FROM params) - {d} * CAST(86400000 AS BIGINT)) AS run_count FROM costed"
        for d in (7, 14, 30, 90)
    )
    q["cost_by_window_presets"] = costed_sql(presets, window_days=90)
    # insights
    q["insights"] = insights_sql()
    q["insights_jobs"] = insights_sql(where="kind = 'expensive_job'")
    q["insights_dominant_share"] = insights_sql(0.01, where="kind = 'dominant_cost_share'")
    q["insights_pipelines"] = insights_sql(where="subject_type = 'pipeline'")
    q["insights_tables"] = insights_sql(where="subject_type = 'table'")
    # pricing
    q["pricing_rates"] = with_ctes() + f"""
SELECT node_type_id, {r('rate', 4)} AS dbu_rate_per_hour, currency, 0.0::DOUBLE AS infrastructure_rate_per_hour,
  {r('rate + 0.0::DOUBLE', 4)} AS total_rate_per_hour FROM rates"""
    q.update(more_queries())
    q["store_dashboard_summary"] = q["summary_kpis"].replace("CAST(NULL AS VARCHAR) AS last_sync_at", "'2024-01-31T00:00:00+00:00' AS last_sync_at")
    q.update(tier_b_queries())
    q["cost_over_time_bars"] = costed_sql(f"""
SELECT date, total_cost, run_count,
  {r('greatest(8.0::DOUBLE, total_cost / greatest((SELECT max(total_cost) FROM s), 1.0::DOUBLE) * 100.0::DOUBLE)', 4)} AS bar_pct
FROM s""", extra=(f"""s AS (
  SELECT strftime(make_timestamp(start_time * 1000), '%Y-%m-%d') AS date, {r(msum('estimated_cost'), 2)} AS total_cost,
    count(*) AS run_count FROM costed WHERE start_time IS NOT NULL GROUP BY 1
)""",))
    q["top_jobs_bars"] = costed_sql(f"""
SELECT job_id, job_name, total_cost,
  {r('greatest(10.0::DOUBLE, total_cost / greatest((SELECT max(total_cost) FROM p), 1.0::DOUBLE) * 100.0::DOUBLE)', 4)} AS bar_pct
FROM p ORDER BY total_cost DESC, last_run_time DESC NULLS LAST, job_id LIMIT 8""",
        extra=(JOB_AGG, f"p AS (SELECT job_id, job_name, {r('total_cost', 2)} AS total_cost, last_run_time FROM job_sum)"))
    q["pricing_config_refresh"] = with_ctes() + f"""
SELECT CAST(row_number() OVER (ORDER BY node_type) - 1 AS BIGINT) AS ordinal, node_type AS node_type_id,
  (SELECT count(*) FROM pricing_config) AS entry_count
FROM {_node_types_sql()}"""
    q["pricing_reference_rates"] = with_ctes() + f"""
SELECT node_type_id, dbus_per_hour, plan,
  {r("dbus_per_hour * CASE WHEN plan = 'premium' THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END", 4)} AS jobs_rate_per_hour,
  {r("dbus_per_hour * CASE WHEN plan = 'premium' THEN 0.55::DOUBLE ELSE 0.65::DOUBLE END", 4)} AS all_purpose_rate_per_hour
FROM pricing_config"""
    return q


def _node_types_sql() -> str:
    return """(SELECT DISTINCT trim(x) AS node_type FROM (
    SELECT driver_node_type_id AS x FROM clusters UNION ALL SELECT node_type_id FROM clusters
  ) WHERE x IS NOT NULL AND trim(x) <> '')"""


def _rates_view(dbus: str, plan: str) -> str:
    shown = f"CASE WHEN lower(coalesce({plan}, 'premium')) IN ('premium', 'enterprise') THEN lower(coalesce({plan}, 'premium')) ELSE 'premium' END"
    d = f"coalesce({dbus}, 0.0::DOUBLE)"
    return (
        f"{d} AS dbus_per_hour, {shown} AS plan, "
        f"{r(f'{d} * CASE WHEN {shown} = ' + chr(39) + 'premium' + chr(39) + ' THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END', 4)} AS jobs_rate_per_hour, "
        f"{r(f'{d} * CASE WHEN {shown} = ' + chr(39) + 'premium' + chr(39) + ' THEN 0.55::DOUBLE ELSE 0.65::DOUBLE END', 4)} AS all_purpose_rate_per_hour"
    )


def more_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["pricing_config_view"] = with_ctes() + f""",
disc AS (SELECT node_type, row_number() OVER (ORDER BY node_type) - 1 AS ordinal FROM {_node_types_sql()}),
v AS (
  SELECT coalesce(d.node_type, p.node_type_id) AS node_type_id,
    CASE WHEN d.node_type IS NOT NULL THEN coalesce(p.dbus_per_hour, 0.0::DOUBLE) ELSE p.dbus_per_hour END AS dbus,
    p.plan AS plan_raw, d.node_type IS NOT NULL AS discovered,
    CASE WHEN d.node_type IS NOT NULL THEN 0 ELSE 1 END AS section, d.ordinal
  FROM disc d FULL OUTER JOIN pricing_config p ON d.node_type = p.node_type_id
)
SELECT node_type_id, {_rates_view('dbus', 'plan_raw')}, discovered,
  CAST(row_number() OVER (ORDER BY section, ordinal, node_type_id) - 1 AS BIGINT) AS position
FROM v"""
    q["pricing_config_normalised"] = """
WITH n AS (
  SELECT *, CASE WHEN n_nationkey % 10 = 9 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * n_regionkey END AS dbus,
    CASE WHEN n_nationkey % 8 = 7 THEN 'gold' WHEN n_nationkey % 2 = 0 THEN 'premium' ELSE 'enterprise' END AS plan0
  FROM nation
),
raw AS (
  SELECT '  ' || n_name || ' ' AS node_type_id, dbus AS dbus_per_hour,
    CASE WHEN n_nationkey % 3 = 0 THEN upper(plan0) || ' ' ELSE plan0 END AS plan, CAST(n_nationkey * 2 AS BIGINT) AS ordinal
  FROM n
  UNION ALL
  SELECT n_name, dbus * 2.0::DOUBLE, 'Premium', CAST(n_nationkey * 2 + 1 AS BIGINT) FROM n WHERE n_regionkey = 0
  UNION ALL
  SELECT ' ', 1.0::DOUBLE, 'premium', CAST(r_regionkey + 1000 AS BIGINT) FROM region
),
cleaned AS (
  SELECT trim(node_type_id) AS node_type_id, coalesce(dbus_per_hour, 0.0::DOUBLE) AS dbus_per_hour,
    lower(trim(coalesce(plan, 'premium'))) AS plan, ordinal
  FROM raw WHERE trim(node_type_id) <> ''
),
latest AS (
  SELECT * FROM (SELECT *, min(CASE WHEN dbus_per_hour < 0 THEN 'negative_dbus' WHEN plan NOT IN ('premium', 'enterprise') THEN 'unsupported_plan' END) OVER (PARTITION BY node_type_id) AS bad, row_number() OVER (PARTITION BY node_type_id ORDER BY ordinal DESC) AS rn FROM cleaned) WHERE rn = 1
)
SELECT node_type_id, dbus_per_hour, plan, bad AS violation
FROM latest"""
    q["pricing_config_counts"] = with_ctes() + f"""
SELECT (SELECT count(*) FROM {_node_types_sql()}) AS discovered_count,
  (SELECT count(*) FILTER (WHERE dbus_per_hour > 0) FROM pricing_config) AS configured_count"""
    q["dimension_dedupe"] = with_ctes() + """
SELECT c.cluster_id,
  CASE WHEN s.s_name IS NOT NULL THEN CAST(s.s_suppkey % 8 + 1 AS INTEGER) ELSE c.num_workers END AS num_workers,
  CASE WHEN s.s_name IS NOT NULL THEN 1 ELSE 0 END AS batch
FROM clusters c LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c.cluster_id = s.s_name"""
    q["normalise_runs"] = with_ctes() + """
SELECT run_id, job_id, start_time, start_time + duration_ms AS end_time,
  coalesce(nullif(CASE WHEN run_id % 5 = 0 THEN 0 ELSE duration_ms END, 0),
           CASE WHEN run_id % 7 = 0 THEN NULL ELSE duration_ms END,
           CASE WHEN start_time IS NOT NULL AND start_time + duration_ms IS NOT NULL THEN greatest(0, duration_ms) END) AS duration_ms,
  life_cycle_state, result_state, cluster_id, has_spec, spec_node AS spec_node_type,
  CAST(spec_workers AS INTEGER) AS spec_workers,
  CASE WHEN run_id % 2 = 0 THEN 'raw.t' || (k % 10) END AS tables_tag
FROM runs"""
    q["normalise_jobs"] = """
SELECT c_custkey AS job_id,
  CASE WHEN c_custkey % 23 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'owner' || c_custkey END AS creator_user_name,
  CASE WHEN c_custkey % 19 = 0 THEN 'PAUSED' ELSE 'UNPAUSED' END AS pause_status,
  CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS task_count,
  CAST(CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unknown_tasks,
  CASE WHEN c_custkey % 7 = 0 THEN 'cluster-' || c_custkey || '|etl' ELSE 'etl' END AS cluster_refs,
  CAST(1 AS BIGINT) AS job_cluster_count,
  'NATION_' || c_nationkey AS jc_node_type,
  CAST(c_custkey % 4 AS INTEGER) AS jc_workers,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS pipeline_tag
FROM customer"""
    q["normalise_clusters"] = """
SELECT s_name AS cluster_id, 'NATION_' || s_nationkey AS node_type_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || ((s_nationkey + 1) % 25) END AS driver_node_type_id,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 8 AS INTEGER) END AS num_workers,
  CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 4 AS INTEGER) END AS as_min,
  CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 4 + 4 AS INTEGER) END AS as_max
FROM supplier"""
    q["completed_runs_limit"] = with_ctes() + """
SELECT run_id, start_time FROM runs WHERE life_cycle_state IN ('TERMINATED', 'SKIPPED', 'INTERNAL_ERROR')
ORDER BY start_time DESC NULLS LAST, run_id DESC LIMIT 250"""
    q["distinct_cluster_ids"] = with_ctes() + "\nSELECT DISTINCT cluster_id FROM runs WHERE cluster_id IS NOT NULL AND cluster_id <> ''"
    q["referenced_clusters_semi"] = with_ctes() + """
SELECT cluster_id, node_type_id FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM runs WHERE cluster_id <> '')"""
    q["distinct_node_types"] = with_ctes() + f"\nSELECT node_type FROM {_node_types_sql()}"
    q["upsert_latest_by_key"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem
) WHERE rn = 1"""
    q["load_jobs_ordered"] = with_ctes() + "\nSELECT job_id, name FROM jobs ORDER BY name, job_id"
    q["load_clusters_ordered"] = with_ctes() + """
SELECT cluster_id, node_type_id, driver_node_type_id, num_workers, as_min, as_max FROM clusters ORDER BY cluster_id"""
    q["load_runs_window"] = with_ctes() + """
SELECT run_id, start_time, strftime(make_timestamp(start_time * 1000), '%Y-%m-%d') AS start_date
FROM runs, params p WHERE start_time IS NULL OR start_time >= p.as_of_ms - 14 * CAST(86400000 AS BIGINT)"""
    q["runs_flattened"] = with_ctes() + """
SELECT run_id, job_id, 'run-' || event_type AS run_name, start_time, start_time + duration_ms AS end_time, duration_ms,
  life_cycle_state, result_state, cluster_id FROM runs"""
    q["synced_runs"] = with_ctes() + """,
landed AS (
  SELECT run_id, job_id, start_time, result_state, 1 AS landing,
    coalesce(nullif(CASE WHEN run_id % 5 = 0 THEN 0 ELSE duration_ms END, 0),
             CASE WHEN run_id % 7 = 0 THEN NULL ELSE duration_ms END,
             CASE WHEN start_time IS NOT NULL AND duration_ms IS NOT NULL THEN greatest(0, duration_ms) END) AS duration_ms
  FROM runs
  UNION ALL
  SELECT r.run_id, r.job_id, epoch_us(e.ts) // 1000 + 86400000, NULL, 2, nullif(r.duration_ms * 2, 0)
  FROM runs r JOIN events e ON e.event_id = r.run_id WHERE run_id % 3 = 0 OR run_id % 89 = 0
  UNION ALL
  SELECT run_id, job_id, start_time, NULL, 3, nullif(duration_ms + 1, 0) FROM runs WHERE run_id % 5 = 0
)
SELECT run_id, job_id, start_time, duration_ms, result_state, '2024-01-31T00:00:00+00:00' AS last_sync_at,
  coalesce(strftime(make_timestamp(start_time * 1000), '%Y-%m-%d'), 'none') AS day
FROM landed QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY landing DESC) = 1"""
    q["synced_jobs"] = """
SELECT c_custkey AS job_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'a new name of ' || c_name WHEN c_custkey % 23 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE 'owner' || c_custkey END AS creator_user_name,
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS n_job_clusters
FROM customer"""
    q["synced_clusters"] = with_ctes() + """
SELECT s_name AS cluster_id, CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE s_name END AS cluster_name, 'NATION_' || s_nationkey AS node_type_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 9 WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 8 AS INTEGER) END AS num_workers
FROM supplier WHERE s_name IN (SELECT cluster_id FROM runs)"""
    q["sync_counts"] = with_ctes() + """,
wanted AS (SELECT count(*) AS n FROM supplier WHERE s_name IN (SELECT cluster_id FROM runs))
SELECT (SELECT count(*) FROM customer) AS saved_jobs, (SELECT count(*) FROM runs) AS saved_runs, n AS saved_clusters,
  '2024-01-31T00:00:00+00:00' AS last_sync_at, (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM customer) AS jobs,
  n AS clusters, (SELECT count(*) FROM supplier) - n AS clusters_waiting
FROM wanted"""
    q["metadata_last_write"] = """
SELECT 'customer/' || c_custkey % 1000 AS key, c_name AS value, CAST(3 AS BIGINT) AS commits
FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey % 3 DESC, c_custkey DESC) = 1"""
    q["json_round_trip"] = with_ctes() + """
SELECT 'jobs' AS table_name, count(*) AS rows, CAST(0 AS BIGINT) AS differences,
  CAST(count(*) FILTER (WHERE job_id % 3 = 0) AS BIGINT) AS dropped_job_clusters FROM jobs
UNION ALL SELECT 'runs', count(*), 0, 0 FROM runs
UNION ALL SELECT 'clusters', count(*), 0, 0 FROM clusters"""
    lines = """
WITH synced AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN '2024-01-01T00:00:00' WHEN 'N' THEN '2024-01-02T00:00:00' ELSE '2024-01-03T00:00:00' END AS synced_at
  FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1)"""
    q["history_as_of"] = lines + """
SELECT t.as_of, l_orderkey, l_linenumber, l_quantity, l_returnflag, synced_at
FROM synced JOIN (SELECT DISTINCT synced_at AS as_of FROM synced) t ON synced_at <= as_of
QUALIFY row_number() OVER (PARTITION BY as_of, l_orderkey, l_linenumber ORDER BY synced_at DESC) = 1"""
    q["history_validity"] = lines + """
SELECT l_orderkey, l_linenumber, l_quantity, synced_at AS valid_from,
  (SELECT min(b.synced_at) FROM synced b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.synced_at > a.synced_at) AS valid_to
FROM synced a"""
    q["snapshot_history"] = """
SELECT l_orderkey, l_linenumber, count(*) AS version_count, min(l_shipdate) AS first_synced_at,
  max(l_shipdate) AS last_synced_at,
  arg_max(l_quantity, struct_pack(a := l_shipdate, b := l_extendedprice, c := l_partkey, d := l_suppkey)) AS latest_quantity
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
    return q


DAY_MS = "CAST(86400000 AS BIGINT)"
FAIL = "('FAILED', 'TIMEDOUT')"

STATS = f"""
base AS (SELECT job_id, start_time, duration_ms, result_state FROM loaded WHERE job_id IS NOT NULL),
p95 AS (
  SELECT job_id, duration_ms AS p95 FROM (
    SELECT job_id, duration_ms, row_number() OVER (PARTITION BY job_id ORDER BY duration_ms) AS rn,
      count(*) OVER (PARTITION BY job_id) AS n
    FROM base WHERE duration_ms IS NOT NULL
  ) WHERE rn = CAST(ceil(0.95 * n) AS BIGINT)
),
st AS (
  SELECT job_id, count(*) AS run_count,
    count(*) FILTER (WHERE result_state = 'SUCCESS') AS success_count,
    count(*) FILTER (WHERE result_state IN {FAIL}) AS failure_count,
    CAST(round(avg(duration_ms)) AS BIGINT) AS avg_duration_ms,
    max(start_time) AS last_run_time,
    max(start_time) FILTER (WHERE result_state = 'SUCCESS') AS last_success_time,
    max(start_time) FILTER (WHERE result_state IN {FAIL}) AS last_failure_time
  FROM base GROUP BY job_id
),
jcost AS (SELECT job_id, {msum('estimated_cost')} AS estimated_cost FROM costed GROUP BY job_id)"""

DEGRADE = f"""
dbase AS (
  SELECT job_id, start_time, duration_ms::DOUBLE AS d FROM runs, params p
  WHERE job_id IS NOT NULL AND duration_ms IS NOT NULL AND start_time >= p.as_of_ms - 30 * {DAY_MS}
),
dagg AS (
  SELECT job_id,
    avg(d) FILTER (WHERE start_time < (SELECT as_of_ms FROM params) - 15 * {DAY_MS}) AS earlier,
    avg(d) FILTER (WHERE start_time >= (SELECT as_of_ms FROM params) - 15 * {DAY_MS}) AS recent,
    regr_slope(d, (start_time - ((SELECT as_of_ms FROM params) - 30 * {DAY_MS}))::DOUBLE / 86400000.0::DOUBLE) AS slope
  FROM dbase GROUP BY job_id
),
deg AS (
  SELECT job_id, earlier, recent, (recent - earlier) / earlier AS change_pct, slope,
    (recent - earlier) / earlier >= 0.2::DOUBLE AS degrading
  FROM dagg WHERE earlier IS NOT NULL AND recent IS NOT NULL AND earlier > 0
),
spread AS (
  SELECT job_id, count(*) AS n, avg(duration_ms) AS a, stddev_samp(duration_ms) AS sd,
    stddev_samp(duration_ms) / avg(duration_ms) AS cv
  FROM loaded WHERE job_id IS NOT NULL AND duration_ms IS NOT NULL GROUP BY job_id
)"""

FRESH = f"""
upd AS (SELECT o_orderpriority AS table_name, o_orderdate AS updated_at FROM orders),
lastu AS (SELECT table_name, max(updated_at) AS last_updated_at FROM upd GROUP BY table_name),
sla AS (
  SELECT DISTINCT o_orderpriority AS table_name, 12.0::DOUBLE * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS sla_hours
  FROM orders
),
fresh AS (
  SELECT l.table_name, l.last_updated_at, s.sla_hours,
    (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(l.last_updated_at)) / 3.6e9::DOUBLE AS lag_hours
  FROM lastu l LEFT JOIN sla s ON l.table_name = s.table_name
),
fresh2 AS (
  SELECT *, lag_hours > sla_hours AS stale, greatest(lag_hours - sla_hours, 0.0::DOUBLE) AS hours_late FROM fresh
),
seen AS (
  SELECT o_orderpriority AS table_name, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS volume
  FROM orders GROUP BY 1, 2
),
vol AS (
  SELECT d.table_name, d.day, coalesce(s.volume, 0) AS volume
  FROM (SELECT table_name, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM seen), INTERVAL 1 DAY)) AS DATE) AS day
        FROM seen GROUP BY table_name) d
  LEFT JOIN seen s ON s.table_name = d.table_name AND s.day = d.day
),
volw AS (
  SELECT *, avg(volume) OVER w AS expected, count(volume) OVER w AS n FROM vol
  WINDOW w AS (PARTITION BY table_name ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
),
anom AS (
  SELECT table_name, day, volume, expected, 1.0::DOUBLE - volume / expected AS drop_pct FROM volw
  WHERE n = 7 AND expected > 0 AND 1.0::DOUBLE - volume / expected >= 0.5::DOUBLE
),
obs AS (
  SELECT o_orderpriority AS table_name, 'c' || (o_custkey % 200) AS column_name, o_orderstatus AS data_type,
    o_orderdate AS observed_at FROM orders
),
yearly AS (
  SELECT table_name, column_name, year(observed_at) AS y, data_type FROM obs
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name, year(observed_at) ORDER BY observed_at DESC, data_type DESC) = 1
),
years AS (SELECT unnest(range(min(y) + 1, max(y) + 1)) AS period FROM yearly),
changes AS (
  SELECT coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.column_name, a.column_name) AS column_name,
    coalesce(b.period, a.period) AS period, b.data_type AS old_type, a.data_type AS new_type,
    CASE WHEN b.data_type IS NULL THEN 'added' WHEN a.data_type IS NULL THEN 'removed'
         WHEN b.data_type <> a.data_type THEN 'retyped' END AS change
  FROM (SELECT * FROM yearly JOIN years ON y = period - 1) b
  FULL OUTER JOIN (SELECT * FROM yearly JOIN years ON y = period) a
    ON b.table_name = a.table_name AND b.column_name = a.column_name AND b.period = a.period
)"""

ALERTS = """
rules AS (
  SELECT * FROM (VALUES
    ('high_failure_rate', 'job', 'failure_rate', '>=', 0.3::DOUBLE, 'medium'),
    ('high_cost', 'job', 'total_cost', '>=', 150.0::DOUBLE, 'high'),
    ('busy_job', 'job', 'run_count', '>=', 80.0::DOUBLE, 'low'),
    ('missed_sla', 'table', 'hours_late', '>', 0.0::DOUBLE, 'high')
  ) t(rule_id, subject_type, metric, op, threshold, severity)
),
metrics AS (
  SELECT 'job' AS subject_type, CAST(st.job_id AS VARCHAR) AS subject_key, 'failure_rate' AS metric,
    st.failure_count::DOUBLE / st.run_count AS value FROM st
  UNION ALL SELECT 'job', CAST(st.job_id AS VARCHAR), 'total_cost', c.estimated_cost FROM st LEFT JOIN jcost c ON st.job_id = c.job_id
  UNION ALL SELECT 'job', CAST(st.job_id AS VARCHAR), 'run_count', st.run_count::DOUBLE FROM st
  UNION ALL SELECT 'table', table_name, 'hours_late', hours_late FROM fresh2
),
hits AS (
  SELECT r.rule_id, r.severity, m.subject_type, m.subject_key, m.metric, m.value FROM metrics m
  JOIN rules r ON m.subject_type = r.subject_type AND m.metric = r.metric
  WHERE CASE r.op WHEN '>=' THEN m.value >= r.threshold WHEN '>' THEN m.value > r.threshold
                  WHEN '<=' THEN m.value <= r.threshold WHEN '<' THEN m.value < r.threshold
                  WHEN '==' THEN m.value = r.threshold ELSE false END
)"""


def tier_b_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["job_stats"] = costed_sql(
        f"""
SELECT st.job_id, run_count, success_count, failure_count, {r('failure_count::DOUBLE / run_count', 4)} AS failure_rate,
  avg_duration_ms, p95.p95 AS p95_duration_ms, last_run_time, last_success_time, last_failure_time,
  {r('c.estimated_cost', 2)} AS estimated_cost, CAST(30 AS INTEGER) AS window_days
FROM st LEFT JOIN p95 ON st.job_id = p95.job_id LEFT JOIN jcost c ON st.job_id = c.job_id""",
        extra=(STATS,),
    )
    q["failure_above_fleet"] = costed_sql(
        f"""
SELECT job_id, run_count, failure_count, {r('failure_count::DOUBLE / run_count', 4)} AS failure_rate,
  {r('f.fleet', 4)} AS fleet_failure_rate
FROM st, (SELECT sum(failure_count)::DOUBLE / sum(run_count)::DOUBLE AS fleet FROM st) f
WHERE run_count >= 5 AND failure_count::DOUBLE / run_count > f.fleet""",
        extra=(STATS,),
    )
    q["execution_frequency"] = costed_sql(
        f"""
SELECT c.job_id, c.run_count, {r('c.run_count / 30.0::DOUBLE', 4)} AS runs_per_day, m.median_gap_ms
FROM (SELECT job_id, count(*) AS run_count FROM loaded WHERE job_id IS NOT NULL GROUP BY job_id) c
LEFT JOIN (
  SELECT job_id, gap AS median_gap_ms FROM (
    SELECT job_id, gap, row_number() OVER (PARTITION BY job_id ORDER BY gap) AS rn, count(*) OVER (PARTITION BY job_id) AS n
    FROM (SELECT job_id, start_time - lag(start_time) OVER (PARTITION BY job_id ORDER BY start_time) AS gap
          FROM loaded WHERE job_id IS NOT NULL AND start_time IS NOT NULL) WHERE gap IS NOT NULL
  ) WHERE rn = CAST(ceil(0.5 * n) AS BIGINT)
) m ON c.job_id = m.job_id"""
    )
    q["unstable_jobs"] = costed_sql(
        f"""
SELECT job_id, n AS run_count, {r('a', 2)} AS avg_duration_ms, {r('sd', 2)} AS stddev_duration_ms, {r('cv', 4)} AS cv
FROM spread WHERE n >= 3 AND cv >= 0.5::DOUBLE""",
        extra=(DEGRADE,),
    )
    q["runtime_degradation"] = costed_sql(
        f"""
SELECT job_id, {r('earlier', 2)} AS earlier_avg_ms, {r('recent', 2)} AS recent_avg_ms, {r('change_pct', 4)} AS change_pct,
  {r('slope', 2)} AS slope_ms_per_day, degrading FROM deg""",
        extra=(DEGRADE,),
    )
    q["orphan_jobs"] = costed_sql(
        """
SELECT job_id, name, reasons FROM (
  SELECT j.job_id, j.name, concat_ws(',',
    CASE WHEN j.creator_user_name IS NULL OR j.creator_user_name = '' THEN 'no_owner' END,
    CASE WHEN j.pause_status = 'PAUSED' THEN 'paused_schedule' END,
    CASE WHEN r.job_id IS NULL THEN 'no_recent_runs' END) AS reasons
  FROM jobs j LEFT JOIN (SELECT DISTINCT job_id FROM loaded WHERE job_id IS NOT NULL) r ON j.job_id = r.job_id
) WHERE reasons <> ''"""
    )
    cur = f"(start_time IS NULL OR start_time >= (SELECT as_of_ms FROM params) - 14 * {DAY_MS})"
    prev = (
        f"(start_time >= (SELECT as_of_ms FROM params) - 28 * {DAY_MS} AND start_time < (SELECT as_of_ms FROM params) - 14 * {DAY_MS})"
    )
    q["cost_period_delta"] = costed_sql(
        f"""
SELECT job_id, {r('cc', 2)} AS current_cost, {r('pc', 2)} AS previous_cost, current_runs, previous_runs,
  {r('cc - pc', 2)} AS delta_cost, {r('CASE WHEN pc <> 0 THEN (cc - pc) / pc END', 4)} AS delta_pct
FROM (
  SELECT job_id, coalesce({msum('estimated_cost', ' FILTER (WHERE ' + cur + ')')}, 0.0::DOUBLE) AS cc,
    coalesce({msum('estimated_cost', ' FILTER (WHERE ' + prev + ')')}, 0.0::DOUBLE) AS pc,
    count(*) FILTER (WHERE {cur}) AS current_runs, count(*) FILTER (WHERE {prev}) AS previous_runs
  FROM costed GROUP BY job_id
)""",
        window_days=28,
    )
    q["dbus_consumed"] = costed_sql(
        f"""
SELECT c.job_id, {r('sum((coalesce(w.dbus_per_hour, 0.0::DOUBLE) * c.workers + coalesce(d.dbus_per_hour, 0.0::DOUBLE)) * c.duration_ms) / 3600000.0::DOUBLE', 4)} AS dbus
FROM costed c LEFT JOIN pricing_config w ON w.node_type_id = c.node_type_id
LEFT JOIN pricing_config d ON d.node_type_id = c.driver_node_type_id
GROUP BY c.job_id"""
    )
    q["job_health_status"] = costed_sql(
        """
SELECT st.job_id, CASE
  WHEN st.failure_count::DOUBLE / st.run_count >= 0.25::DOUBLE THEN 'failing'
  WHEN coalesce(deg.degrading, false) THEN 'degrading'
  WHEN sp.n >= 3 AND sp.cv >= 0.5::DOUBLE THEN 'unstable'
  ELSE 'healthy' END AS status
FROM st LEFT JOIN deg ON st.job_id = deg.job_id LEFT JOIN spread sp ON st.job_id = sp.job_id""",
        extra=(STATS, DEGRADE),
    )
    q["table_freshness"] = with_ctes(FRESH) + f"""
SELECT table_name, last_updated_at, sla_hours, {r('lag_hours', 2)} AS lag_hours, stale, {r('hours_late', 2)} AS hours_late
FROM fresh2"""
    q["volume_anomalies"] = with_ctes(FRESH) + f"""
SELECT table_name, day, volume, {r('expected', 4)} AS expected, {r('drop_pct', 4)} AS drop_pct FROM anom"""
    q["schema_changes"] = with_ctes(FRESH) + "\nSELECT table_name, column_name, period, old_type, new_type, change FROM changes WHERE change IS NOT NULL"
    q["data_issues"] = with_ctes(FRESH) + """
SELECT 'stale' AS issue_type, table_name, 'missed its SLA by ' || printf('%.1f', hours_late) || ' hours' AS detail
FROM fresh2 WHERE stale
UNION ALL
SELECT 'inconsistent', table_name, change || ' column ' || column_name || ' in ' || period FROM changes WHERE change IN ('removed', 'retyped')
UNION ALL
SELECT 'volume_anomaly', table_name,
  'volume dropped ' || printf('%.0f', drop_pct * 100.0::DOUBLE) || '% below expected on ' || CAST(day AS VARCHAR)
FROM anom"""
    q["threshold_alerts"] = costed_sql(
        f"SELECT rule_id, severity, subject_type, subject_key, metric, {r('value', 4)} AS value FROM hits",
        extra=(STATS, FRESH, ALERTS),
    )
    q["data_issues_upstream"] = with_ctes(FRESH) + """,
issues AS (
  SELECT 'stale' AS issue_type, table_name, 'missed its SLA by ' || printf('%.1f', hours_late) || ' hours' AS detail
  FROM fresh2 WHERE stale
  UNION ALL
  SELECT 'inconsistent', table_name, change || ' column ' || column_name || ' in ' || period FROM changes WHERE change IN ('removed', 'retyped')
  UNION ALL
  SELECT 'volume_anomaly', table_name,
    'volume dropped ' || printf('%.0f', drop_pct * 100.0::DOUBLE) || '% below expected on ' || CAST(day AS VARCHAR)
  FROM anom
),
edges AS (
  SELECT DISTINCT o.o_orderpriority AS table_name, 'lineitem_' || l.l_returnflag AS upstream_table
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
up AS (SELECT table_name, string_agg(upstream_table, ',' ORDER BY upstream_table) AS upstream_tables FROM edges GROUP BY table_name)
SELECT i.issue_type, i.table_name, i.detail, u.upstream_tables FROM issues i LEFT JOIN up u ON i.table_name = u.table_name"""
    q["alert_counts"] = costed_sql(
        "SELECT severity, count(*) AS alert_count FROM hits GROUP BY severity", extra=(STATS, FRESH, ALERTS)
    )
    q["cost_anomalies"] = costed_sql(
        f"""
SELECT job_id, day, {r('cost', 4)} AS cost, {r('baseline', 4)} AS baseline, {r('sd', 4)} AS baseline_stddev FROM (
  SELECT *, avg(cost) OVER w AS baseline, stddev_samp(cost) OVER w AS sd, count(cost) OVER w AS history
  FROM (SELECT job_id, CAST(make_timestamp(start_time * 1000) AS DATE) AS day, {msum('estimated_cost')} AS cost
        FROM costed WHERE start_time IS NOT NULL GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY job_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
) WHERE history >= 3 AND sd > 0 AND abs(cost - baseline) >= 2.0::DOUBLE * sd"""
    )
    return q
