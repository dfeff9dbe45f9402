"""A hot job holding a third of all runs: the salted path gives the same answer."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import costing, summaries
from fleetlens.operators.costing import CostConfig
from tests import helpers as H

M5 = "m5d.large"


def test_hot_job_salted_equals_broadcast(spark):
    n = 3000
    runs = spark.range(n).select(
        F.col("id").alias("run_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).cast("long").alias("job_id"),
        (F.col("id") * 1000).alias("start_time"),
        (F.col("id") % 7 * 60_000 + 60_000).alias("duration_ms"),
        F.when(F.col("id") % 2 == 0, F.struct(F.lit(None).cast("string").alias("cluster_id"),
                                              F.lit(None).cast("string").alias("spark_context_id"))).alias("cluster_instance"),
    )
    runs = runs.select(
        "*",
        F.lit(None).cast("struct<spark_version:string,node_type_id:string,driver_node_type_id:string,num_workers:int,"
                         "autoscale:struct<min_workers:int,max_workers:int>,autotermination_minutes:int>").alias("cluster_spec"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    )
    jobs = H.jobs(spark, [
        {"job_id": j, "tasks": [{"task_key": "t", "cluster_ref": "etl"}],
         "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": M5, "num_workers": j % 3}}]}
        for j in range(1, 52)
    ])
    rates = H.rates(spark, [(M5, 1.0)])
    clusters = H.clusters(spark, [])
    wide = costing.cost_runs(runs, jobs, clusters, rates)
    salted = costing.cost_runs(runs, jobs, clusters, rates, CostConfig(max_broadcast_rows=0, salt_buckets=8))
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan
    summed = lambda costed: {r.job_id: (r.total_cost, r.run_count) for r in summaries.job_summaries(costed, jobs).collect()}
    a, b = summed(wide), summed(salted)
    assert a == b and a[1][1] == n // 3
    agg_plan = summaries.job_aggregate(salted)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in agg_plan  # the hot job is pre-reduced per task before the shuffle
    assert sum(v[0] for v in a.values()) == pytest.approx(wide.agg(F.sum("estimated_cost")).first()[0])


@pytest.mark.parametrize("salt_by", ["run_id", None])
def test_a_dimension_found_too_large_is_never_broadcast(spark, salt_by):
    """Nor where Spark takes it for small by the bytes of its plan."""
    from fleetlens.plans.joins import join_dimension

    fact = spark.range(200).select(F.col("id").alias("run_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 40).alias("job_id"))
    dim = spark.range(30).select(F.col("id").alias("job_id"), F.col("id").cast("string").alias("name"))
    out = join_dimension(fact, dim, "job_id", "left", max_broadcast_rows=10, salt_by=salt_by)
    want = {(i, i % 40 if i % 9 else None, str(i % 40) if i % 9 and i % 40 < 30 else None) for i in range(200)}
    assert {(r.run_id, r.job_id, r.name) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
