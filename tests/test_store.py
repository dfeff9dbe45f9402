"""The workspace store: commits, last landed wins, moved runs, replays, two writers."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import store as ST
from fleetlens.sources.commits import CommitConflict, CommitLog
from fleetlens.sources.store import Batch, WorkspaceStore
from fleetlens.streaming import incremental_sync as I
from tests import helpers as H

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01


def landed(df, order):
    """``df`` with the landing order of each row's ``order`` column."""
    return df.withColumn(ST.LANDED, F.struct(order.alias("line")))


def runs_of(spark, rows):
    """[(run_id, start_ms, duration)], landed in this order."""
    n = {i: r for i, r in enumerate(rows)}
    df = spark.createDataFrame([(i, *r) for i, r in n.items()], "i long, run_id long, start_time long, duration_ms long")
    typed = df.select("i", "run_id", "start_time", "duration_ms", *[F.lit(None).cast(f.dataType).alias(f.name) for f in H.S.RUNS.fields if f.name not in ("run_id", "start_time", "duration_ms")])
    return landed(typed.select(*H.S.RUNS.names, "i"), F.col("i")).drop("i")


def state_of(store):
    return {r.run_id: (r.day, r.duration_ms) for r in store.read_runs().collect()}


def test_one_of_two_writers_makes_a_commit(spark, scratch):
    a, b = CommitLog(spark, scratch), CommitLog(spark, scratch)
    assert a.latest() == (0, {})
    a.commit(1, {"by": "a"})
    with pytest.raises(CommitConflict):
        b.commit(1, {"by": "b"})
    assert b.latest() == (1, {"by": "a"})
    assert not [n for n in os.listdir(os.path.join(scratch, "_commits")) if n.startswith(".draft") and not n.endswith(".crc")]


def test_a_lost_race_starts_over_on_the_winners_state(spark, scratch):
    store, other = WorkspaceStore(spark, scratch), WorkspaceStore(spark, scratch)
    put = lambda s, k, v: s.metadata_put(spark.createDataFrame([(k, v)], "key string, value string"))
    n, state = store.state()
    put(other, "theirs", "1")
    with pytest.raises(CommitConflict):
        store._commit(n, state, tables={})
    put(store, "ours", "2")
    assert (store.metadata_get("theirs"), store.metadata_get("ours"), store.metadata_get("none")) == ("1", "2", None)
    assert store.state()[0] == 2


def test_metadata_last_write_and_a_crash_before_the_commit(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    entries = landed(spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("other", "x", 1)], "key string, value string, seq long"), F.col("seq")).drop("seq")
    store.metadata_put(entries)
    folder = store._merged("metadata", spark.createDataFrame([("k", "never")], "key string, value string"), store.state()[1])
    assert store.metadata_get("k") == "new"  # the folder is there, no commit names it
    store.metadata_put(spark.createDataFrame([("k", "newer")], "key string, value string"))
    assert (store.metadata_get("k"), store.metadata_get("other")) == ("newer", "x")
    assert store.remove_unreferenced(keep_commits=1) == 2 and not os.path.exists(os.path.join(scratch, folder))
    assert store.metadata_get("k") == "newer"


def test_runs_move_between_days_and_the_last_landed_wins(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    first = [(1, T0, 10), (2, None, 20), (3, T0 + DAY, 30), (4, T0 + 2 * DAY, 40), (1, T0, 11)]
    assert store.sync(Batch(runs=runs_of(spark, first)), "t1")["saved_runs"] == 5
    assert state_of(store) == {1: ("2024-01-01", 11), 2: ("none", 20), 3: ("2024-01-02", 30), 4: ("2024-01-03", 40)}
    before = store.state()[1]["runs"]
    # run 2 starts, run 3 changes its day (which empties the old one), run 1 twice in one batch
    store.sync(Batch(runs=runs_of(spark, [(2, T0, 21), (3, T0, 31), (1, T0 + DAY, 12), (1, T0, 13)])), "t2")
    assert state_of(store) == {1: ("2024-01-01", 13), 2: ("2024-01-01", 21), 3: ("2024-01-01", 31), 4: ("2024-01-03", 40)}
    after = store.state()[1]["runs"]
    assert set(after) == {"2024-01-01", "2024-01-03"} and after["2024-01-03"] == before["2024-01-03"]
    assert {r.run_id for r in store.read_runs(T0 + DAY).collect()} == {4}
    assert store.metadata_get("last_sync_at") == "t2"


def test_a_sync_reads_only_the_buckets_of_its_keys(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    store.sync(Batch(runs=runs_of(spark, [(i, T0, i) for i in range(300)])), "t1")
    keys = spark.createDataFrame([(7,)], "run_id long").select("run_id", F.lit("x").alias("day"), F.pmod(F.xxhash64("run_id"), F.lit(ST.INDEX_BUCKETS)).cast("int").alias("bucket"))
    places = store._places(keys, store.state()[1]["index"])
    assert [tuple(r) for r in places.collect()] == [(7, "2024-01-01")]
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_index_parts_are_merged(spark, scratch, monkeypatch):
    monkeypatch.setattr(ST, "INDEX_PARTS", 2)
    store = WorkspaceStore(spark, scratch)
    for i in range(5):
        store.sync(Batch(runs=runs_of(spark, [(1, T0 + i * DAY, i), (10 + i, T0, i)])), f"t{i}")
        assert len(store.state()[1]["index"]) <= 2
    got = state_of(store)
    assert got[1] == ("2024-01-05", 4) and len(got) == 6 and store.read_runs().count() == 6


def test_a_replayed_epoch_changes_nothing(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    batch = Batch(runs=runs_of(spark, [(1, T0, 1)]))
    assert not store.sync(batch, "t1", "app", 0)["replayed"]
    assert store.sync(Batch(runs=runs_of(spark, [(1, T0, 99)])), "t2", "app", 0)["replayed"]
    assert state_of(store) == {1: ("2024-01-01", 1)} and store.state()[0] == 1 and store.metadata_get("last_sync_at") == "t1"
    assert not store.sync(Batch(runs=runs_of(spark, [(1, T0, 2)])), "t3", "other", 0)["replayed"]


def test_clusters_wait_until_a_run_refers_to_them(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    run = lambda i, c: H.runs(spark, [{"run_id": i, "start_time": T0, "cluster_instance": {"cluster_id": c}}])
    cl = lambda *ids: H.clusters(spark, [{"cluster_id": c, "num_workers": n} for c, n in ids])
    got = store.sync(Batch(runs=run(1, "a"), clusters=cl(("a", 1), ("b", 2))), "t1")
    assert got["saved_clusters"] == 1 and [r.cluster_id for r in store.read("clusters").collect()] == ["a"]
    store.sync(Batch(clusters=cl(("a", 5), ("c", 3))), "t2")  # an update of a stored one
    store.sync(Batch(runs=run(2, "b")), "t3")
    assert {(r.cluster_id, r.num_workers) for r in store.read("clusters").collect()} == {("a", 5), ("b", 2)}
    assert [r.cluster_id for r in store.read("clusters_waiting").collect()] == ["c"]


def test_empty_store_and_empty_batch(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    assert store.read("jobs").count() == store.read_runs().count() == store.read_runs(T0).count() == 0
    got = store.sync(Batch(jobs=H.jobs(spark, []), runs=H.runs(spark, []), clusters=H.clusters(spark, [])), "t1")
    assert (got["saved_jobs"], got["saved_runs"], got["saved_clusters"]) == (0, 0, 0)
    assert store.metadata_get("last_sync_at") == "t1" and store.read_runs().count() == 0


def land(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


def test_streaming_sync(spark, scratch):
    landing, root = os.path.join(scratch, "runs", "landing"), os.path.join(scratch, "store")
    land(f"{landing}/jobs", "1.json", [{"job_id": 1, "settings": {"name": "old"}}, {"job_id": 1, "settings": {"name": "new"}}, {"job_id": 2, "settings": {"name": "z"}}, {"job_id": 2, "settings": {"name": "a"}}])
    land(f"{landing}/runs", "1.json", [{"run_id": 1, "job_id": 1, "start_time": 1000, "run_duration": 1000, "cluster_instance": {"cluster_id": "a"}}, {"run_id": 2, "start_time": 1500, "end_time": 1600}, "{broken"])
    land(f"{landing}/clusters/sub", "1.json", [{"cluster_id": "a", "cluster_name": "z", "num_workers": 1}, {"cluster_id": "a", "cluster_name": "b", "num_workers": 2}, {"cluster_id": "b"}])
    kw = dict(checkpoint_location=os.path.join(scratch, "ckpt"), quarantine_dir=os.path.join(scratch, "bad"))
    I.sync_once(spark, landing, root, synced_at="t1", **kw)
    store = WorkspaceStore(spark, root)
    assert {r.job_id: r.name for r in store.read("jobs").collect()} == {1: "new", 2: "a"}  # renamed within the batch
    assert [(r.cluster_id, r.cluster_name, r.num_workers) for r in store.read("clusters").collect()] == [("a", "b", 2)]
    assert state_of(store) == {1: ("1970-01-01", 1000), 2: ("1970-01-01", 100)}
    assert spark.read.text(os.path.join(scratch, "bad", "runs")).count() == 1
    n, state = store.state()
    assert n == 1 and state["last_sync"] == {"saved_jobs": 4, "saved_runs": 2, "saved_clusters": 2, "last_sync_at": "t1"}
    I.sync_once(spark, landing, root, synced_at="t2", **kw)  # nothing new landed
    assert store.state()[0] == 1
    land(f"{landing}/runs", "2.json", [{"run_id": 2, "start_time": 1500 + DAY, "run_duration": 400}, {"run_id": 3}])
    I.sync_once(spark, landing, root, synced_at="t3", **kw)
    assert state_of(store) == {1: ("1970-01-01", 1000), 2: ("1970-01-02", 400), 3: ("none", None)}
    # the stream's own id is the application: a replay of its last epoch is ignored
    (app, epoch), = store.state()[1]["epochs"].items()
    raw = spark.read.text(f"{landing}/runs/1.json").select("value", *[F.col(f"_metadata.{c}").alias(c) for c in I._FILE])
    assert I.merge_epoch(store, raw, app, epoch, "t4")["replayed"] and state_of(store)[2] == ("1970-01-02", 400)


def test_landing_order_is_by_file_time_then_line(spark, scratch):
    land(f"{scratch}/jobs", "b.json", [{"job_id": 1, "settings": {"name": "first"}}])
    land(f"{scratch}/jobs", "a.json", [{"job_id": 1, "settings": {"name": "second"}}, {"job_id": 1, "settings": {"name": "third"}}])
    os.utime(f"{scratch}/jobs/b.json", (1000, 1000))
    os.utime(f"{scratch}/jobs/a.json", (2000, 2000))
    store = WorkspaceStore(spark, f"{scratch}/store")
    read = lambda: spark.read.text(f"{scratch}/jobs").select("value", *[F.col(f"_metadata.{c}").alias(c) for c in I._FILE])
    I.merge_epoch(store, read(), "app", 0, "t1")
    assert store.read("jobs").first().name == "third"
    os.utime(f"{scratch}/jobs/b.json", (3000, 3000))
    I.merge_epoch(store, read(), "app", 1, "t2")
    assert store.read("jobs").first().name == "first"


def test_save_pricing_config_replaces_the_entries_or_nothing(spark, scratch):
    from fleetlens.operators import pricing

    store = WorkspaceStore(spark, scratch)
    entries = lambda *rows: spark.createDataFrame(list(enumerate_rows(rows)), "ordinal long, node_type_id string, dbus_per_hour double, plan string")
    enumerate_rows = lambda rows: ((i, *r) for i, r in enumerate(rows))
    stored = lambda: {(r.node_type_id, r.dbus_per_hour, r.plan) for r in pricing.decode_config(store.read("metadata"))[0].collect()}
    refreshed = pricing.refresh_discovered(pricing.encode_config(spark.createDataFrame([], "node_type_id string, dbus_per_hour double, plan string"), None, None), spark.createDataFrame([("n1",)], "node_type string"), "t0")
    store.metadata_put(refreshed)
    store.save_pricing_config(entries((" n1 ", 2.0, " Premium"), ("n2", 1.0, None), ("n1", 3.0, "enterprise"), ("", 1.0, "premium")))
    assert stored() == {("n1", 3.0, "enterprise"), ("n2", 1.0, "premium")}
    for bad in (("n3", -1.0, "premium"), ("n3", 1.0, "gold")):
        with pytest.raises(ValueError, match="invalid"):
            store.save_pricing_config(entries(bad))
    assert len(stored()) == 2
    store.save_pricing_config(entries(("n3", 1.0, "premium")))
    assert stored() == {("n3", 1.0, "premium")}
    config = json.loads(store.metadata_get(pricing.CONFIG_KEY))
    assert config["cluster_node_types"] == ["n1"] and config["last_refreshed_at"] == "t0"


def test_the_keys_of_a_sync_are_not_broadcast(spark, scratch):
    store = WorkspaceStore(spark, scratch)
    store.sync(Batch(runs=runs_of(spark, [(1, T0, 5), (2, T0 + DAY, 6), (None, None, 7)])), "now")
    keys = spark.range(2, 4).select(F.col("id").alias("run_id"), F.lit("d").alias("day"), F.pmod(F.xxhash64("id"), F.lit(ST.INDEX_BUCKETS)).cast("int").alias("bucket"))
    found = store._places(keys, store.state()[1]["index"])
    assert [tuple(r) for r in found.collect()] == [(2, "2024-01-02")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
