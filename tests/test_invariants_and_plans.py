"""Invariants on the fixture workspace and physical-plan checks."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import costing, summaries
from fleetlens.operators.attribution import explode_costs
from fleetlens.plans.dashboard import Dashboard
from fleetlens.sources.fixtures import load_workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dash(spark):
    ws = load_workspace(spark, SF)
    return Dashboard.from_config(ws.runs, ws.jobs, ws.clusters, ws.pricing_config, ws.as_of_ms)


def test_expected_fixture_counts(dash):
    by_source = {r.source: r["count"] for r in dash.costed.groupBy("source").count().collect()}
    assert by_source == {"run.cluster_spec": 264, "cluster_lookup": 24, "job.job_clusters": 420}
    cov = dash.coverage().first()
    assert (cov.total_runs, cov.costed_runs) == (1000, 708)
    assert cov.costed_runs + cov.uncosted_runs == cov.total_runs


def test_job_costs_sum_to_total(dash):
    total = dash.costed.agg(F.sum("estimated_cost")).first()[0]
    by_job = dash.job_summaries().agg(F.sum("total_cost"), F.sum("cost_share")).first()
    assert by_job[0] == pytest.approx(total)
    assert by_job[1] == pytest.approx(1.0)


def test_exploded_shares_sum_to_tagged_cost(dash):
    c = dash.costed
    tagged = c.where(F.size("table_keys") > 0).agg(F.sum("estimated_cost")).first()[0]
    shares = explode_costs(c, "table_keys").agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(tagged)


def test_uncosted_reasons_add_up(dash):
    d = dash.diagnosed()
    n_reasons = costing.uncosted_by_reason(d).agg(F.sum("run_count")).first()[0]
    assert n_reasons + dash.costed.count() == d.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_costing_plan_is_one_broadcast_pipeline(dash):
    p = _plan(dash.costed)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in p
    assert "BroadcastHashJoin" in p
    # no shuffle of run rows: only broadcast exchanges
    assert "Exchange hashpartitioning" not in p and "SinglePartition" not in p


def test_job_summary_is_hash_aggregate(dash):
    from fleetlens.operators import summaries

    # the aggregation over the costed runs, not what is read back from it
    for agg in (summaries.job_aggregate(dash.costed), summaries.named_aggregate(dash.costed, "table_keys"), summaries.fused_aggregate(dash.costed)):
        p = _plan(agg)
        assert "HashAggregate" in p and "SortAggregate" not in p
    p = _plan(dash.job_summaries())
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_window_filter_reaches_scan(spark, scratch):
    from fleetlens.sources import snapshot

    ws = load_workspace(spark, SF)
    runs = snapshot.with_start_date(ws.runs)
    snapshot.write_snapshot(runs, scratch, "runs", ["start_date"])
    stored = snapshot.read_snapshot(spark, scratch, "runs")
    w = costing.window_start(ws.as_of_ms, 7)
    loaded = snapshot.load_runs_window(stored, w)
    p = _plan(loaded)
    assert "PartitionFilters: [" in p and "start_date" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters" in p
    assert loaded.count() == costing.runs_in_window(ws.runs, w).count()
    # costing over the partitioned snapshot prunes days too, and pushes the row predicates
    from fleetlens.operators import pricing

    costed = costing.cost_runs(stored, ws.jobs, ws.clusters, pricing.effective_rates(ws.pricing_config), window_start_ms=w)
    cp = _plan(costed)
    assert "start_date" in cp.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(duration_ms)" in cp  # the row predicates reach the scan (string is truncated)
    assert costed.count() == costing.cost_runs(
        ws.runs, ws.jobs, ws.clusters, pricing.effective_rates(ws.pricing_config), window_start_ms=w
    ).count()


def test_materialized_dashboard_gives_same_views(spark):
    ws = load_workspace(spark, SF)
    live = Dashboard.from_config(ws.runs, ws.jobs, ws.clusters, ws.pricing_config, ws.as_of_ms)
    mat = Dashboard.from_config(ws.runs, ws.jobs, ws.clusters, ws.pricing_config, ws.as_of_ms).materialize()
    for view in ("top_jobs", "top_tables", "cost_over_time", "summary"):
        assert sorted(getattr(live, view)().collect()) == sorted(getattr(mat, view)().collect()), view
    # views over the written fact read only the columns they need
    p = mat.cost_over_time()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<start_time:bigint,estimated_cost:double>" in p


def test_dashboard_views_bundle(spark):
    ws = load_workspace(spark, SF)
    d = Dashboard.from_config(ws.runs, ws.jobs, ws.clusters, ws.pricing_config, ws.as_of_ms)
    v = d.views()
    assert set(v) == {"summary", "cost_over_time", "top_jobs", "top_pipelines", "top_tables", "recent_runs", "insights", "coverage"}
    s = v["summary"].first()
    assert s.run_count == 708 and s.most_expensive_job == v["top_jobs"].first().job_name
    assert v["coverage"].first().costed_runs == 708
    assert v["recent_runs"].count() == 20
