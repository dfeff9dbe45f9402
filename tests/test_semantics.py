"""One test per uncosted reason and per source quirk, plus zero state."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import merge_tag_values, split_tag_value, tag_lookup, tag_values, TABLE_TAG_KEYS
from fleetlens.operators import costing, insights, pricing, summaries
from fleetlens.operators.costing import CostConfig
from fleetlens.plans.dashboard import Dashboard
from tests import helpers as H

M5 = "m5d.large"


def _diag(spark, runs, rate_pairs, jobs=(), clusters=(), cfg=CostConfig(), w=None):
    r = H.runs(spark, runs)
    out = costing.diagnose_runs(r, H.jobs(spark, list(jobs)), H.clusters(spark, list(clusters)), H.rates(spark, rate_pairs), cfg,
                                window_start_ms=w)
    return {row.run_id: row.reason for row in out.collect()}


def test_reasons_in_order(spark):
    runs = [
        {"run_id": 1, "job_id": 1, "duration_ms": 0, "cluster_spec": {"node_type_id": M5, "num_workers": 1}},
        {"run_id": 2, "job_id": 1, "duration_ms": None, "cluster_spec": {"node_type_id": M5}},
        {"run_id": 3, "job_id": 1, "duration_ms": -5, "cluster_spec": {"node_type_id": M5}},
        {"run_id": 4, "job_id": 1, "duration_ms": 1000},
        {"run_id": 5, "job_id": 1, "duration_ms": 1000, "cluster_spec": {"num_workers": 2}},
        {"run_id": 6, "job_id": 1, "duration_ms": 1000, "cluster_spec": {"node_type_id": "unknown"}},
        {"run_id": 7, "job_id": 1, "duration_ms": 1000, "cluster_spec": {"node_type_id": M5, "driver_node_type_id": "unknown"}},
        {"run_id": 8, "job_id": None, "duration_ms": 1000, "cluster_spec": {"node_type_id": M5}},
        {"run_id": 9, "job_id": 1, "duration_ms": 1000, "cluster_spec": {"node_type_id": M5}},
    ]
    got = _diag(spark, runs, [(M5, 1.0)])
    assert got == {
        1: "no_billable_duration", 2: "no_billable_duration", 3: "no_billable_duration",
        4: "unresolved_cluster", 5: "no_node_type", 6: "unpriced_worker", 7: "unpriced_driver",
        8: "no_job", 9: None,
    }


def test_empty_spec_blocks_fall_through(spark):
    """A present spec without node type does not fall back to the cluster lookup."""
    got = _diag(
        spark,
        [{"run_id": 1, "job_id": 1, "duration_ms": 1000, "cluster_spec": {}, "cluster_instance": {"cluster_id": "abc"}}],
        [(M5, 1.0)], clusters=[{"cluster_id": "abc", "node_type_id": M5, "num_workers": 1}],
    )
    assert got == {1: "no_node_type"}


def test_empty_cluster_id_is_not_looked_up(spark):
    got = _diag(
        spark, [{"run_id": 1, "job_id": 1, "duration_ms": 1000, "cluster_instance": {"cluster_id": ""}}],
        [(M5, 1.0)], clusters=[{"cluster_id": "", "node_type_id": M5}],
    )
    assert got == {1: "unresolved_cluster"}


def test_blank_driver_falls_back_and_no_driver_mode(spark):
    r = H.runs(spark, [{"run_id": 1, "job_id": 1, "duration_ms": 3_600_000,
                        "cluster_spec": {"node_type_id": M5, "driver_node_type_id": "", "num_workers": 1}},
                       {"run_id": 2, "job_id": 1, "duration_ms": 3_600_000,
                        "cluster_spec": {"node_type_id": M5, "driver_node_type_id": "gpu", "num_workers": 1}}])
    rates = H.rates(spark, [(M5, 1.0)])
    with_driver = {x.run_id: x.estimated_cost for x in costing.cost_runs(r, H.jobs(spark, []), H.clusters(spark, []), rates).collect()}
    assert with_driver == {1: pytest.approx(2.0)}
    no_driver = costing.cost_runs(r, H.jobs(spark, []), H.clusters(spark, []), rates, CostConfig(include_driver=False)).collect()
    assert {x.run_id: x.estimated_cost for x in no_driver} == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
    assert {x.billable_nodes for x in no_driver} == {1.0}


def test_job_cluster_needs_single_ref(spark):
    jobs = H.jobs(spark, [
        {"job_id": 1, "tasks": [{"task_key": "a", "cluster_ref": "etl"}, {"task_key": "b", "cluster_ref": "other"}],
         "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": M5, "num_workers": 1}}]},
        {"job_id": 2, "tasks": [{"task_key": "a", "cluster_ref": "etl"}, {"task_key": "b", "cluster_ref": "etl"},
                                {"task_key": "c", "cluster_ref": None}],
         "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": M5, "num_workers": 3}},
                          {"job_cluster_key": "etl", "new_cluster": {"node_type_id": M5, "num_workers": 9}}]},
        {"job_id": 3, "tasks": [{"task_key": "a", "cluster_ref": "etl"}], "job_clusters": []},
    ])
    res = {r.job_id: r for r in costing.job_cluster_resolution(jobs).collect()}
    assert res[1].resolved is False
    assert res[2].resolved is True and res[2].num_workers == 3  # first matching entry
    assert res[3].resolved is False


def test_window_keeps_boundary_and_null_starts(spark):
    r = H.runs(spark, [{"run_id": 1, "start_time": 999}, {"run_id": 2, "start_time": 1000}, {"run_id": 3, "start_time": None}])
    assert sorted(x.run_id for x in costing.runs_in_window(r, 1000).collect()) == [2, 3]
    with pytest.raises(ValueError):
        costing.window_start(0, 0)


def test_tag_functions(spark):
    df = spark.range(1).select(
        F.map_from_arrays(F.array(F.lit("Tables"), F.lit("TABLES"), F.lit("pipeline")),
                          F.array(F.lit("first"), F.lit(" a ;b,\n c ,, "), F.lit(""))).alias("tags")
    )
    row = df.select(
        tag_lookup("tags", "tables").alias("v"),
        tag_values("tags", TABLE_TAG_KEYS).alias("vals"),
        tag_values("tags", ("pipeline",)).alias("pipes"),
        split_tag_value(F.lit("x;;y")).alias("split"),
        merge_tag_values(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))).alias("merged"),
        tag_values(F.lit(None).cast("map<string,string>"), TABLE_TAG_KEYS).alias("none"),
    ).first()
    assert row.v == " a ;b,\n c ,, "  # the later colliding key wins
    assert row.vals == ["a", "b", "c"]
    assert row.pipes == []  # empty values are skipped
    assert row.split == ["x", "y"]
    assert row.merged == ["x", "y", "z"]
    assert row.none == []


def test_equal_split_and_untagged(spark):
    jobs = H.jobs(spark, [{"job_id": 1, "tags": {"tables": "t1, t2"}}])
    runs = H.runs(spark, [
        {"run_id": 1, "job_id": 1, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 1},
         "tags": {"Table": "t2;t3"}},
        {"run_id": 2, "job_id": 9, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 1}},
    ])
    costed = costing.cost_runs(runs, jobs, H.clusters(spark, []), H.rates(spark, [(M5, 1.0)]))
    ts = {r.key: r for r in summaries.named_summaries(costed, "table_keys", 1).collect()}
    assert set(ts) == {"t1", "t2", "t3"}
    assert ts["t2"].total_cost == pytest.approx(2.0 / 3)
    # the untagged run of a missing job still counts in the grand total
    assert ts["t2"].cost_share == pytest.approx((2.0 / 3) / 4.0)
    js = {r.job_id: r.job_name for r in summaries.job_summaries(costed, jobs).collect()}
    assert js == {1: "job1", 9: "job-9"}


def test_dominant_share_fires_at_equality(spark):
    jobs = H.jobs(spark, [{"job_id": 1}, {"job_id": 2}])
    runs = H.runs(spark, [
        {"run_id": 1, "job_id": 1, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 0}},
        {"run_id": 2, "job_id": 2, "duration_ms": 3_600_000, "cluster_spec": {"node_type_id": M5, "num_workers": 0}},
    ])
    cfg = CostConfig(expensive_job_share_threshold=0.5)
    costed = costing.cost_runs(runs, jobs, H.clusters(spark, []), H.rates(spark, [(M5, 1.0)]), cfg)
    js = summaries.job_summaries(costed, jobs, cfg)
    kinds = [r.kind for r in insights.job_insights(js, cfg).collect()]
    assert kinds.count("dominant_cost_share") == 2


def test_pricing_rules(spark):
    conf = H.config(spark, [("a", 2.0, "premium"), ("b", 2.0, "weird"), ("c", 0.0, "premium"), ("d", -1.0, "premium"),
                            ("e", 1.0, None)])
    rates = {r.node_type_id: r.dbu_rate_per_hour for r in pricing.effective_rates(conf).collect()}
    assert rates == {"a": pytest.approx(0.3), "b": pytest.approx(0.4), "e": pytest.approx(0.15)}
    view = {r.node_type_id: r for r in pricing.reference_rates(conf).collect()}
    assert view["b"].plan == "premium" and view["b"].jobs_rate_per_hour == pytest.approx(0.3)
    raw = spark.createDataFrame([(" x ", -1.0, "premium", 0)], "node_type_id string, dbus_per_hour double, plan string, ordinal long")
    with pytest.raises(ValueError):
        pricing.assert_valid_config(pricing.normalise_config(raw))


def test_decode_config(spark):
    js = ('{"cluster_node_types":["m5d.large"," ","i3.xlarge"],"entries":{"m5d.large":{"dbus_per_hour":2.0,"plan":"premium"},'
          '"bad":7},"last_refreshed_at":"2026-04-08T00:00:00+00:00"}')
    kv = spark.createDataFrame([("cluster_pricing_config", js)], "key string, value string")
    entries, disc = pricing.decode_config(kv)
    assert [(r.node_type_id, r.dbus_per_hour) for r in entries.collect()] == [("m5d.large", 2.0)]
    assert [(r.ordinal, r.node_type_id) for r in disc.orderBy("ordinal").collect()] == [(0, "m5d.large"), (2, "i3.xlarge")]


def test_zero_state(spark):
    d = Dashboard.from_config(H.runs(spark, []), H.jobs(spark, []), H.clusters(spark, []),
                              H.config(spark, [(M5, 1.0, "premium")]), as_of_ms=10**12)
    s = d.summary().first()
    assert (s.total_cost, s.run_count, s.job_count, s.pipeline_count, s.table_count, s.avg_cost_per_run) == (0.0, 0, 0, 0, 0, 0.0)
    assert s.most_expensive_job is None and s.currency == "USD"
    assert d.insights().count() == 0
    assert d.cost_over_time().count() == 0
    cov = d.coverage().first()
    assert (cov.total_runs, cov.costed_runs, cov.uncosted_runs, cov.priced_node_types) == (0, 0, 0, M5)
    assert d.recent_runs().count() == 0
    with pytest.raises(ValueError):
        d.recent_runs(-1)


def test_repeated_dimension_rows_last_one_counts(spark):
    """Two rows for one cluster, job and rate: the run is costed once, by the last."""
    runs = H.runs(spark, [{"run_id": 1, "job_id": 1, "duration_ms": 3_600_000, "cluster_instance": {"cluster_id": "c"}}])
    clusters = H.clusters(spark, [{"cluster_id": "c", "node_type_id": M5, "num_workers": n} for n in (3, 2)]).withColumn("seq", 9 - F.col("num_workers"))
    jobs = H.jobs(spark, [{"job_id": 1, "name": "a"}, {"job_id": 1, "name": "b"}]).withColumn("seq", F.ascii("name"))
    cfg = CostConfig(dimension_order="seq")
    got = costing.cost_runs(runs, jobs, clusters, H.rates(spark, [(M5, 1.0)]), cfg).collect()
    assert [(r.run_id, r.estimated_cost) for r in got] == [(1, 3.0)]
    assert costing.diagnose_runs(runs, jobs, clusters, H.rates(spark, [(M5, 1.0)]), cfg).count() == 1


def test_repeated_dimension_rows_count_once_without_any_setting(spark):
    """No order named: the row stored last counts, for clusters, jobs and rates; an
    ``ordinal`` column orders them where there is one."""
    runs = H.runs(spark, [{"run_id": 1, "job_id": 1, "duration_ms": 3_600_000, "cluster_instance": {"cluster_id": "c"}}])
    clusters = H.clusters(spark, [{"cluster_id": "c", "node_type_id": M5, "num_workers": n} for n in (3, 2)]).coalesce(1)
    jobs = H.jobs(spark, [{"job_id": 1, "name": "a"}, {"job_id": 1, "name": "b"}]).coalesce(1)
    rates = H.rates(spark, [(M5, 7.0), (M5, 1.0)]).coalesce(1)
    assert [r.estimated_cost for r in costing.cost_runs(runs, jobs, clusters, rates).collect()] == [3.0]
    assert costing.diagnose_runs(runs, jobs, clusters, rates).count() == 1
    ordered = clusters.withColumn("ordinal", F.col("num_workers"))
    assert [r.estimated_cost for r in costing.cost_runs(runs, jobs, ordered, rates).collect()] == [4.0]


def test_tag_values_strip_unicode_space(spark):
    df = spark.createDataFrame([({"table": "a , a, b"},)], "tags map<string,string>")
    assert df.select(tag_values("tags", TABLE_TAG_KEYS).alias("v")).first().v == ["a", "a", "b"]


def test_percentiles_are_exact_for_large_jobs(spark):
    import math

    from pyspark.sql import functions as F

    from fleetlens.operators.observability import execution_frequency, job_stats

    n = 40_000
    runs = spark.range(3 * n).select(
        (F.col("id") % 3).cast("string").alias("job_id"),
        (F.col("id") * F.col("id") % 1_000_003 * 977).alias("start_time"),
        (F.col("id") * F.col("id") * 31 % 100_000_007).alias("duration_ms"),
        F.lit("SUCCESS").alias("result_state"),
    )
    by = {}
    for r in runs.collect():
        by.setdefault(r["job_id"], []).append((r["start_time"], r["duration_ms"]))
    p95 = {j: sorted(d for _, d in v)[math.ceil(0.95 * n) - 1] for j, v in by.items()}
    gaps = {j: sorted(b - a for a, b in zip(s, s[1:])) for j, v in by.items() for s in [sorted(t for t, _ in v)]}
    assert {r["job_id"]: r["p95_duration_ms"] for r in job_stats(runs, None, None, 30).collect()} == p95
    median = {r["job_id"]: r["median_gap_ms"] for r in execution_frequency(runs, None, 30).collect()}
    assert median == {j: g[math.ceil(0.5 * len(g)) - 1] for j, g in gaps.items()}
    sketch = runs.groupBy("job_id").agg(F.percentile_approx("duration_ms", 0.95, 10_000).alias("x")).collect()
    assert {r["job_id"]: r["x"] for r in sketch} != p95  # what the sketch gives is not exact here


def test_gaps_of_a_hot_hour_and_of_equal_starts(spark):
    """A third of all runs in one hour, many of them in the same millisecond: the
    median as a plain sort gives it, in windows of a minute's distinct starts."""
    from fleetlens.operators import observability as O

    n = 30_000
    i = F.col("id")
    hot = 1_000_000 + (i * i % 9973) * 300  # within the hour, with ties
    runs = spark.range(n).select(F.when(i % 3 == 0, 1).otherwise(i % 40 + 2).cast("long").alias("job_id"), F.when(i % 3 == 0, hot).when(i % 11 == 0, None).otherwise(i * 777_777).alias("start_time"), F.lit(1).cast("long").alias("duration_ms"), F.lit("SUCCESS").alias("result_state"))
    by = {}
    for r in runs.where("start_time is not null").collect():
        by.setdefault(r["job_id"], []).append(r["start_time"])
    gaps = {j: sorted(b - a for a, b in zip(sorted(s), sorted(s)[1:])) for j, s in by.items()}
    got = {r["job_id"]: r["median_gap_ms"] for r in O.execution_frequency(runs, None, 30).collect()}
    assert got == {j: g[-(-len(g) // 2) - 1] for j, g in gaps.items()}
    each = {(r["job_id"], r["gap_ms"]): r["n"] for r in O.run_gaps(O.job_starts(runs, None)).groupBy("job_id", "gap_ms").agg(F.sum("n").alias("n")).collect()}
    assert {k[1]: v for k, v in each.items() if k[0] == 1} == {x: gaps[1].count(x) for x in set(gaps[1])}


def test_profile_written_or_not_gives_the_same(spark):
    from fleetlens.operators import observability as O

    runs = spark.range(5000).select((F.col("id") % 7).alias("job_id"), F.col("id").alias("start_time"), F.when(F.col("id") % 5 > 0, F.col("id") * 7919 % 1_000_003).alias("duration_ms"), F.when(F.col("id") % 4 == 0, "FAILED").otherwise("SUCCESS").alias("result_state"))
    profile = O.run_profile(runs, None, write=True)
    a, b = O.job_stats(runs, None, None, 30).collect(), O.job_stats(runs, None, None, 30, profile=profile).collect()
    assert sorted(a) == sorted(b) and len(a) == 7
    exact = {r["job_id"]: r for r in runs.groupBy("job_id").agg(F.count("duration_ms").alias("n"), F.stddev_samp("duration_ms").alias("sd")).collect()}
    for r in O.profile_spread(profile).collect():
        assert r["run_count"] == exact[r["job_id"]]["n"] and r["stddev_duration_ms"] == pytest.approx(exact[r["job_id"]]["sd"], rel=1e-12)
