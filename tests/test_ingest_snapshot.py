"""Ingest parsing rules, snapshot store and the streaming incremental sync."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.sources import codec, ingest, snapshot


def _raw(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def test_runs_parsing_rules(spark):
    docs = [
        {"run_id": "1", "job_id": "7", "run_duration": 0, "execution_duration": None, "start_time": 100, "end_time": 350},
        {"run_id": 2, "run_duration": 0, "execution_duration": 0},
        {"run_id": 3, "run_duration": 5, "cluster_spec": {}},
        {"run_id": 4, "cluster_spec": {"new_cluster": {"node_type_id": "x", "num_workers": "2"}}},
        {"run_id": 5, "cluster_spec": {"new_cluster": "nope", "node_type_id": "y", "autoscale": {"min_workers": 1}}},
        {"run_id": 6, "tags": {}, "start_time": 500, "end_time": 400},
        {"run_id": "abc"},
        "not json",
    ]
    typed, bad = ingest.normalise_runs(_raw(spark, docs))
    rows = {r.run_id: r for r in typed.collect()}
    assert rows[1].job_id == 7 and rows[1].duration_ms == 250
    assert rows[2].duration_ms == 0
    assert rows[3].duration_ms == 5
    assert rows[3].cluster_spec is not None and rows[3].cluster_spec.node_type_id is None
    assert rows[4].cluster_spec.node_type_id == "x" and rows[4].cluster_spec.num_workers == 2
    assert rows[5].cluster_spec.node_type_id == "y" and rows[5].cluster_spec.autoscale is None
    assert rows[6].tags is None and rows[6].duration_ms == 0 and rows[6].cluster_spec is None
    assert bad.count() == 2


def test_jobs_parsing_rules(spark):
    docs = [
        {"job_id": 1, "settings": {"name": "", "tags": {"Pipeline": "p"},
                                   "tasks": [{"job_cluster_key": "", "existing_cluster_id": "c1"}, {"task_key": "t", "job_cluster_key": "etl"}],
                                   "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": "n"}},
                                                    {"new_cluster": {"node_type_id": "m"}}, {"job_cluster_key": "k"}]}},
        {"job_id": "2", "settings": "broken"},
    ]
    typed, bad = ingest.normalise_jobs(_raw(spark, docs))
    rows = {r.job_id: r for r in typed.collect()}
    assert rows[1].name == "1"
    assert [(t.task_key, t.cluster_ref) for t in rows[1].tasks] == [("unknown", "c1"), ("t", "etl")]
    assert [c.job_cluster_key for c in rows[1].job_clusters] == ["etl"]
    assert rows[2].name == "2" and rows[2].tasks is None and rows[2].schedule is None
    assert bad.count() == 0


def test_cluster_parsing_and_node_types(spark):
    docs = [
        {"cluster_id": "a", "node_type_id": " n1 ", "driver_node_type_id": "n2", "num_workers": "3"},
        {"cluster_id": "b", "node_type_id": "n1", "driver_node_type_id": "  ", "autoscale": {"min_workers": 1, "max_workers": 4}},
        {"cluster_name": "no id"},
    ]
    typed, bad = ingest.normalise_clusters(_raw(spark, docs))
    rows = {r.cluster_id: r for r in typed.collect()}
    assert rows["a"].num_workers == 3 and rows["b"].autoscale.max_workers == 4
    assert bad.count() == 1
    assert sorted(r.node_type for r in ingest.distinct_node_types(typed).collect()) == ["n1", "n2"]


def test_upsert_versions_and_history(spark, scratch):
    b1 = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b2", 2)], "k long, v string, seq long")
    assert snapshot.upsert(b1, scratch, "t", ["k"], ["seq"]) == 3
    b2 = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "k long, v string, seq long")
    snapshot.upsert(b2, scratch, "t", ["k"], ["seq"])
    cur = snapshot.read_snapshot(spark, scratch, "t")
    assert {r.k: r.v for r in cur.collect()} == {1: "a", 2: "c", 3: "d"}
    assert snapshot.current_version(spark, scratch, "t")[0] == 2
    # idempotent: merging the same batch again gives the same state
    snapshot.upsert(b2, scratch, "t", ["k"], ["seq"])
    assert {r.k: r.v for r in snapshot.read_snapshot(spark, scratch, "t").collect()} == {1: "a", 2: "c", 3: "d"}
    snapshot.append_history(b1, scratch, "t", "2026-01-01T00:00:00")
    snapshot.append_history(b2, scratch, "t", "2026-01-02T00:00:00")
    hist = spark.read.parquet(os.path.join(scratch, "t_history"))
    latest = snapshot.latest_from_history(hist.drop("seq").withColumn("seq", F.lit(0)), ["k"])
    assert {r.k: r.v for r in latest.collect()} == {1: "a", 2: "c", 3: "d"}


def test_history_as_of_and_validity(spark, scratch):
    keys = ["k"]
    for at, rows in (("2026-01-01T00:00:00", [(1, "a"), (2, "b")]), ("2026-01-02T12:30:00", [(2, "c"), (3, "d")])):
        snapshot.append_history(spark.createDataFrame(rows, "k long, v string"), scratch, "h", at)
    hist = snapshot.read_history(spark, scratch, "h")
    state = lambda at: {r.k: (r.v, r.synced_at) for r in snapshot.state_as_of(hist, keys, at).collect()}
    assert state("2025") == {} and state("2026-01-02T12:29:59") == {1: ("a", "2026-01-01T00:00:00"), 2: ("b", "2026-01-01T00:00:00")}
    assert {k: v for k, (v, _) in state("2026-01-02T12:30:00").items()} == {1: "a", 2: "c", 3: "d"}
    plan = snapshot.state_as_of(hist, keys, "2026-01-01T00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(synced_at" in plan  # later syncs are not read
    held = {(r.k, r.v): (r.valid_from, r.valid_to) for r in snapshot.validity_intervals(hist, keys).collect()}
    assert held[2, "b"] == ("2026-01-01T00:00:00", "2026-01-02T12:30:00") and held[2, "c"] == ("2026-01-02T12:30:00", None)


def test_only_one_writer_makes_a_version(spark, scratch):
    from fleetlens.sources.commits import CommitConflict

    one = spark.range(1).withColumnRenamed("id", "k")
    snapshot.write_snapshot(one, scratch, "t", after=0)
    with pytest.raises(CommitConflict):
        snapshot.write_snapshot(spark.range(2).withColumnRenamed("id", "k"), scratch, "t", after=0)
    assert snapshot.read_snapshot(spark, scratch, "t").count() == 1


def test_codec_tells_everything_apart(spark, scratch):
    import datetime as dt
    from decimal import Decimal

    schema = (
        "i long, d double, f float, s string, b boolean, x binary, n decimal(38,18), t timestamp, u timestamp_ntz, day date, "
        "m map<string,string>, a array<int>, st struct<p:int,q:struct<r:string>>, deep array<struct<m:map<string,double>,a:array<string>>>"
    )
    nan, inf = float("nan"), float("inf")
    utc = dt.timezone.utc
    rows = [
        (None,) * 14,
        (2**63 - 1, nan, nan, "", True, b"\x00\xff", Decimal("12345678901234567890.123456789012345678"), dt.datetime(2024, 1, 2, 3, 4, 5, 678901, utc), dt.datetime(2024, 1, 2, 3, 4, 5, 1), dt.date(1969, 12, 31), {}, [], (None, None), []),
        (-(2**63), inf, -inf, 'é"\\\n\u2028', False, b"", Decimal(0), None, None, None, {"k": None, "": "v"}, [None, 1], (1, (None,)), [None, ({}, []), ({"x": nan, "y": None}, [None, ""])]),
        (0, -0.0, 0.1, "null", None, None, None, None, None, None, {"k": "{}"}, [0], (None, ("",)), [(None, None)]),
        (0, -0.0, 0.1, "null", None, None, None, None, None, None, {"k": "{}"}, [0], (None, ("",)), [(None, None)]),
    ]
    df = spark.createDataFrame(rows, schema)
    codec.export_json(df, os.path.join(scratch, "x"))
    back = codec.import_json(spark, os.path.join(scratch, "x"), df.schema)
    assert back.schema == df.schema and tuple(codec.differences(df, back).first()) == (0, 0)
    assert tuple(codec.differences(df, back.limit(4)).first()) == (1, 0)  # repeats count
    changed = back.withColumn("m", F.when(F.size("m") == 0, F.lit(None)).otherwise(F.col("m")))
    assert tuple(codec.differences(df, changed).first()) == (1, 1)  # an empty map is not a missing one
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        codec.from_documents(spark.createDataFrame([("{",)], "value string"), df.schema).collect()


def test_import_drops_incomplete_job_clusters(spark, scratch):
    jobs = spark.createDataFrame(
        [{"job_id": 1, "name": "j", "tags": {"a": "b"},
          "job_clusters": [{"job_cluster_key": "etl", "new_cluster": {"node_type_id": "n"}}, {"job_cluster_key": None, "new_cluster": None}, {"job_cluster_key": "x", "new_cluster": None}]},
         {"job_id": 2}],
        S.JOBS,
    )
    path = os.path.join(scratch, "jobs_json")
    codec.export_json(jobs, path)
    back = {r.job_id: r for r in codec.import_json(spark, path, S.JOBS).collect()}
    assert back[1].tags == {"a": "b"} and [c.job_cluster_key for c in back[1].job_clusters] == ["etl"] and back[2].job_clusters is None


def test_salted_join_matches_broadcast(spark):
    from fleetlens.plans.joins import join_dimension

    fact = spark.range(0, 2000).select(F.col("id").alias("run_id"), (F.col("id") % 3).alias("job_id"))
    dim = spark.range(0, 3).select(F.col("id").alias("job_id"), (F.col("id") * 10).alias("w"))
    b = join_dimension(fact, dim, "job_id", "left")
    s = join_dimension(fact, dim, "job_id", "left", max_broadcast_rows=1, salt_by="run_id", salt_buckets=8)
    assert sorted(b.collect()) == sorted(s.collect())
    plan = s._jdf.queryExecution().executedPlan().toString()
    # the join keys include the salt (AQE may still broadcast this tiny test dimension at runtime)
    assert "__salt" in plan


def test_unreadable_pointer_is_not_an_empty_store(spark, scratch):
    snapshot.write_snapshot(spark.range(3).withColumnRenamed("id", "job_id"), scratch, "jobs")
    assert snapshot.current_version(spark, scratch, "jobs")[0] == 1
    assert snapshot.current_version(spark, scratch, "nothing") is None
