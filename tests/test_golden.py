"""Golden values of the source's own tests and worked example (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import costing, insights, pricing, summaries
from fleetlens.operators.costing import CostConfig
from fleetlens.plans.dashboard import Dashboard
from tests import helpers as H

M5 = "m5d.large"


def _cost_one(spark, run, rate_pairs, jobs=(), clusters=(), cfg=CostConfig()):
    r = H.runs(spark, [run])
    j = H.jobs(spark, list(jobs))
    c = H.clusters(spark, list(clusters))
    rows = costing.cost_runs(r, j, c, H.rates(spark, rate_pairs), cfg).collect()
    assert len(rows) == 1
    return rows[0]


def test_u1_run_spec(spark):
    row = _cost_one(spark, {"run_id": 10, "job_id": 1, "duration_ms": 7_200_000,
                            "cluster_spec": {"node_type_id": M5, "num_workers": 2}}, [(M5, 0.5)])
    assert row.source == "run.cluster_spec"
    assert row.billable_nodes == pytest.approx(3.0)
    assert row.hourly_rate == pytest.approx(1.5)
    assert row.estimated_cost == pytest.approx(3.0)


def test_u2_cluster_lookup(spark):
    row = _cost_one(
        spark,
        {"run_id": 11, "job_id": 2, "duration_ms": 1_800_000, "cluster_instance": {"cluster_id": "abc"}},
        [(M5, 1.2)],
        clusters=[{"cluster_id": "abc", "node_type_id": M5, "num_workers": 1}],
    )
    assert row.source == "cluster_lookup"
    assert row.billable_nodes == pytest.approx(2.0)
    assert row.estimated_cost == pytest.approx(1.2)


def test_u3_report(spark):
    jobs = H.jobs(spark, [
        {"job_id": 1, "name": "bronze-refresh", "tags": {"pipeline": "ingestion", "tables": "bronze.events,bronze.orders"}},
        {"job_id": 2, "name": "gold-aggregate", "tags": {"pipeline": "serving"}},
    ])
    runs = H.runs(spark, [
        {"run_id": 100, "job_id": 1, "start_time": 1000, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 3}},
        {"run_id": 101, "job_id": 1, "start_time": 2000, "duration_ms": 1_800_000, "cluster_spec": {"node_type_id": M5, "num_workers": 1}},
        {"run_id": 102, "job_id": 2, "start_time": 3000, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 1},
         "tags": {"tables": "gold.orders"}},
    ])
    cfg = CostConfig(expensive_job_share_threshold=0.30, top_n_insights=2)
    costed = costing.cost_runs(runs, jobs, H.clusters(spark, []), H.rates(spark, [(M5, 1.0)]), cfg)
    total = costed.agg(F.sum("estimated_cost")).first()[0]
    assert total == pytest.approx(7.0)
    js = summaries.job_summaries(costed, jobs, cfg)
    ranked = js.orderBy(*summaries.rank_jobs(js)).collect()
    assert [r.job_id for r in ranked] == [1, 2]
    assert ranked[0].total_cost == pytest.approx(5.0)
    assert ranked[0].cost_share == pytest.approx(5 / 7)
    assert ranked[0].avg_cost_per_run == pytest.approx(2.5)
    assert ranked[0].last_run_time == 2000
    ps = summaries.named_summaries(costed, "pipeline_keys", 10, cfg)
    top_p = ps.orderBy(*summaries.rank_named()).first()
    assert top_p.label == "ingestion" and top_p.total_cost == pytest.approx(5.0)
    ts = summaries.named_summaries(costed, "table_keys", 10, cfg)
    gold = ts.where(F.col("key") == "gold.orders").first()
    assert gold.cost_per_day == pytest.approx(0.2)
    ins = insights.all_insights(js, ps, ts, summaries.grand_total(costed), cfg).collect()
    kinds = [i.kind for i in sorted(ins, key=lambda i: i.position)]
    assert "dominant_cost_share" in kinds and "expensive_table" in kinds
    # N1/N2 interleaved, then pipelines, then tables
    assert kinds[:2] == ["expensive_job", "dominant_cost_share"]
    msg = [i.message for i in ins if i.kind == "expensive_job" and i.subject_key == "1"][0]
    assert msg == "Job 'bronze-refresh' accounts for 71.4% of total cost with 5.00 USD."


def test_u4_autoscale_average(spark):
    row = _cost_one(spark, {"run_id": 12, "job_id": 3, "duration_ms": 3_600_000,
                            "cluster_spec": {"node_type_id": M5, "autoscale": {"min_workers": 2, "max_workers": 6}}}, [(M5, 2.0)])
    assert row.billable_nodes == pytest.approx(5.0)
    assert row.estimated_cost == pytest.approx(10.0)


@pytest.mark.parametrize("strategy,nodes", [("min", 3.0), ("max", 7.0)])
def test_autoscale_strategies(spark, strategy, nodes):
    row = _cost_one(spark, {"run_id": 12, "job_id": 3, "duration_ms": 3_600_000,
                            "cluster_spec": {"node_type_id": M5, "autoscale": {"min_workers": 2, "max_workers": 6}}},
                    [(M5, 2.0)], cfg=CostConfig(autoscale_strategy=strategy))
    assert row.billable_nodes == pytest.approx(nodes)


def test_u5_distinct_driver_price(spark):
    row = _cost_one(spark, {"run_id": 13, "job_id": 4, "duration_ms": 3_600_000,
                            "cluster_spec": {"node_type_id": "worker.large", "driver_node_type_id": "driver.large", "num_workers": 2}},
                    [("worker.large", 1.0), ("driver.large", 3.0)])
    assert row.hourly_rate == pytest.approx(5.0)
    assert row.estimated_cost == pytest.approx(5.0)


def test_u6_job_cluster_fallback(spark):
    row = _cost_one(
        spark, {"run_id": 14, "job_id": 5, "duration_ms": 3_600_000}, [(M5, 1.0)],
        jobs=[{"job_id": 5, "name": "job-cluster-backed", "tasks": [{"task_key": "main", "cluster_ref": "etl"}],
               "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": M5, "num_workers": 1}}]}],
    )
    assert row.source == "job.job_clusters"
    assert row.estimated_cost == pytest.approx(2.0)


def _u7_dashboard(spark):
    jobs = H.jobs(spark, [
        {"job_id": 1, "name": "bronze-refresh", "tags": {"pipeline": "ingestion", "tables": "bronze.events"}},
        {"job_id": 2, "name": "gold-aggregate", "tags": {"pipeline": "serving", "tables": "gold.orders"}},
    ])
    runs = H.runs(spark, [
        {"run_id": 100, "job_id": 1, "start_time": 1_700_000_000_000, "duration_ms": 3_600_000,
         "cluster_spec": {"node_type_id": M5, "num_workers": 1}},
        {"run_id": 101, "job_id": 2, "start_time": 1_700_050_000_000, "duration_ms": 7_200_000,
         "cluster_spec": {"node_type_id": M5, "num_workers": 2}},
    ])
    conf = H.config(spark, [(M5, 2.0, "premium")])
    return Dashboard.from_config(runs, jobs, H.clusters(spark, []), conf, as_of_ms=1_700_100_000_000, window_days=3650)


def test_u7_dashboard(spark):
    d = _u7_dashboard(spark)
    s = d.summary().first()
    assert s.currency == "USD"
    assert s.total_cost == pytest.approx(2.4)
    assert s.pipeline_count == 2 and s.table_count == 2
    assert s.most_expensive_pipeline == "serving"
    assert s.most_expensive_table == "gold.orders"
    assert s.most_expensive_job == "gold-aggregate"
    assert d.coverage().first().costed_runs == 2
    assert d.top_jobs().first().job_name == "gold-aggregate"
    assert d.top_pipelines().first().label == "serving"
    assert d.top_tables().first().label == "gold.orders"
    assert any(i.subject_type == "table" for i in d.insights().collect())
    first = d.insights(limit=2).collect()
    assert sorted(i.position for i in first) == [0, 1]
    assert d.recent_runs(20).count() == 2


def test_u8_pricing_round_trip(spark):
    raw = spark.createDataFrame(
        [("m5d.large", 2.0, "premium", 0), ("i3.xlarge", 3.0, "enterprise", 1)],
        "node_type_id string, dbus_per_hour double, plan string, ordinal long",
    )
    entries = pricing.assert_valid_config(pricing.normalise_config(raw))
    discovered = spark.createDataFrame([("m5d.large", 0), ("i3.xlarge", 1)], "node_type_id string, ordinal long")
    view = pricing.config_view(discovered, entries).collect()
    assert [v.node_type_id for v in view] == ["m5d.large", "i3.xlarge"]
    assert view[0].plan == "premium" and view[0].jobs_rate_per_hour == pytest.approx(0.3)
    assert view[1].plan == "enterprise" and view[1].all_purpose_rate_per_hour == pytest.approx(1.95)


def test_u9_worked_example(spark):
    conf = H.config(spark, [("m5d.large", 2.0, "premium")])
    rates = pricing.effective_rates(conf)
    r = H.runs(spark, [{"run_id": 1, "job_id": 1, "duration_ms": 7_200_000, "cluster_spec": {"node_type_id": M5, "num_workers": 2}}])
    row = costing.cost_runs(r, H.jobs(spark, []), H.clusters(spark, []), rates).first()
    assert row.estimated_cost == pytest.approx(1.80)
