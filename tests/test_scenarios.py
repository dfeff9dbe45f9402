"""Scenario tests after the source's requirement table (T02-T10): small hand-built inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, freshness, observability
from tests import helpers as H

DAY = 86_400_000
AS_OF = 1_700_000_000_000


def _runs(spark, rows):
    """rows: (run_id, job_id, start_offset_days, duration_ms, result_state)."""
    return H.runs(spark, [
        {"run_id": rid, "job_id": jid, "start_time": AS_OF - int(days * DAY), "duration_ms": dur,
         "state": {"life_cycle_state": "TERMINATED", "result_state": res}}
        for rid, jid, days, dur, res in rows
    ])


def test_t03_runtime_degradation(spark):
    # job 1 gets slower over the window; job 2 stays flat
    rows = [(i, 1, 29 - i, 1000 + 200 * i, "SUCCESS") for i in range(28)]
    rows += [(100 + i, 2, 29 - i, 1000, "SUCCESS") for i in range(28)]
    deg = {r.job_id: r for r in observability.runtime_degradation(_runs(spark, rows), AS_OF, 30, 0.2).collect()}
    assert deg[1].degrading and deg[1].slope_ms_per_day == pytest.approx(200.0)
    assert not deg[2].degrading and deg[2].change_pct == pytest.approx(0.0)


def test_t04_failure_above_fleet_and_status(spark):
    rows = [(i, 1, i * 0.1, 1000, "FAILED" if i % 2 == 0 else "SUCCESS") for i in range(10)]
    rows += [(100 + i, 2, i * 0.1, 1000, "SUCCESS") for i in range(10)]
    runs = _runs(spark, rows)
    stats = observability.job_stats(runs, None, AS_OF - 30 * DAY, 30)
    above = {r.job_id: r for r in observability.failure_above_fleet(stats, min_runs=5).collect()}
    assert set(above) == {1}
    assert above[1].failure_rate == pytest.approx(0.5) and above[1].fleet_failure_rate == pytest.approx(0.25)
    status = {
        r.job_id: r.status
        for r in observability.job_health_status(
            stats, observability.runtime_degradation(runs, AS_OF, 30), observability.duration_spread(runs, None)
        ).collect()
    }
    assert status == {1: "failing", 2: "healthy"}


def _updates(spark, rows):
    return spark.createDataFrame(
        [(t, dt.datetime(2024, 1, d), n) for t, d, n in rows], "table_name string, updated_at timestamp_ntz, row_count long"
    )


def test_t05_freshness_sla_missed(spark):
    upd = _updates(spark, [("fresh", 10, 5), ("stale", 8, 5)])
    sla = spark.createDataFrame([("fresh", 24.0), ("stale", 24.0)], "table_name string, sla_hours double")
    f = {r.table_name: r for r in freshness.table_freshness(upd, sla, F.lit(dt.datetime(2024, 1, 10, 6))).collect()}
    assert not f["fresh"].stale and f["fresh"].hours_late == 0.0
    assert f["stale"].stale and f["stale"].hours_late == pytest.approx(30.0)
    issues = freshness.data_issues(
        freshness.table_freshness(upd, sla, F.lit(dt.datetime(2024, 1, 10, 6))),
        spark.createDataFrame([], "table_name string, column_name string, old_type string, new_type string, change string"),
        spark.createDataFrame([], "table_name string, day date, volume long, expected double, drop_pct double"),
    ).collect()
    assert [(i.issue_type, i.table_name, i.detail) for i in issues] == [("stale", "stale", "missed its SLA by 30.0 hours")]


def test_t06_volume_drop(spark):
    rows = [("t", d, 100) for d in range(1, 8)] + [("t", 8, 15), ("t", 9, 100)]
    vol = freshness.daily_volume(_updates(spark, rows))
    an = freshness.volume_anomalies(vol, trailing=7, drop_threshold=0.8).collect()
    assert [(a.day.day, a.volume, a.expected) for a in an] == [(8, 15, 100.0)]
    assert an[0].drop_pct == pytest.approx(0.85)


def test_t07_missing_optional_data_degrades(spark):
    issues = spark.createDataFrame([("stale", "t", "x")], "issue_type string, table_name string, detail string")
    out = freshness.with_upstream(issues, None).first()
    assert out.upstream_tables is None
    edges = spark.createDataFrame([("t", "u2"), ("t", "u1"), ("t", "u1")], "table_name string, upstream_table string")
    assert freshness.with_upstream(issues, edges).first().upstream_tables == ["u1", "u2"]


def test_t10_threshold_boundary(spark):
    metrics = spark.createDataFrame([("job", "1", "failure_rate", 0.3), ("job", "2", "failure_rate", 0.2999),
                                     ("job", "3", "failure_rate", None)],
                                    "subject_type string, subject_key string, metric string, value double")
    rules = spark.createDataFrame([("r", "job", "failure_rate", ">=", 0.3, "medium"), ("s", "job", "failure_rate", ">", 0.3, "high")],
                                  "rule_id string, subject_type string, metric string, op string, threshold double, severity string")
    hits = alerts.threshold_alerts(metrics, rules).collect()
    assert [(h.rule_id, h.subject_key) for h in hits] == [("r", "1")]
    assert {r.severity: r.alert_count for r in alerts.alert_counts(alerts.threshold_alerts(metrics, rules)).collect()} == {"medium": 1}


def test_cost_anomaly_flags_spike(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    costs = [10.0, 11.0, 9.0, 10.0, 10.5, 9.5, 10.0, 40.0, 10.0, 10.0]
    daily = spark.createDataFrame([(1, d, c) for d, c in zip(days, costs)], "job_id long, day date, cost double")
    an = alerts.cost_anomalies(daily, trailing=7, k=2.0, min_history=3).collect()
    assert [a.day.day for a in an] == [8]


def test_orphans_and_frequency(spark):
    jobs = H.jobs(spark, [
        {"job_id": 1, "creator_user_name": "a", "schedule": {"pause_status": "UNPAUSED"}},
        {"job_id": 2, "creator_user_name": None, "schedule": {"pause_status": "PAUSED"}},
    ])
    runs = _runs(spark, [(1, 1, 1.0, 10, "SUCCESS"), (2, 1, 0.5, 10, "SUCCESS"), (3, 1, 0.25, 10, "SUCCESS")])
    orphans = {r.job_id: r.reasons for r in observability.orphan_jobs(jobs, runs, AS_OF - 30 * DAY).collect()}
    assert orphans == {2: ["no_owner", "paused_schedule", "no_recent_runs"]}
    freq = observability.execution_frequency(runs, AS_OF - 30 * DAY, 30).first()
    assert freq.run_count == 3 and freq.median_gap_ms == DAY // 4  # gaps 12 h and 6 h -> nearest-rank median


def test_schema_changes_of_every_period(spark):
    """A column that comes, changes its type, goes and comes back; one that stays; one
    only seen in the last year; NULL times belong to no year."""
    import datetime as dt

    day = lambda y, m=6: dt.datetime(y, m, 1)
    seen = [("t", "stays", "int", day(y)) for y in range(2000, 2006)]
    seen += [("t", "c", "int", day(2001)), ("t", "c", "str", day(2002, 1)), ("t", "c", "long", day(2002, 2)), ("t", "c", "long", day(2005)), ("t", "late", "int", day(2005)), ("u", "x", "int", day(2003)), ("t", "null", "int", None)]
    obs = spark.createDataFrame(seen, "table_name string, column_name string, data_type string, observed_at timestamp_ntz")
    got = {tuple(r) for r in freshness.schema_changes_by_period(freshness.type_history(obs)).collect()}
    assert got == {
        ("t", "c", 2001, None, "int", "added"), ("t", "c", 2002, "int", "long", "retyped"), ("t", "c", 2003, "long", None, "removed"), ("t", "c", 2005, None, "long", "added"),
        ("t", "late", 2005, None, "int", "added"), ("u", "x", 2003, None, "int", "added"), ("u", "x", 2004, "int", None, "removed"),
    }
    assert freshness.schema_changes_by_period(freshness.type_history(obs.limit(0))).count() == 0
