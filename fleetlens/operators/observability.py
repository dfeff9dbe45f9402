"""Job observability (B1-B9). The source declares these but has no code; the
rules below are ours and every threshold is a parameter.

Scale notes: ``run_profile`` is one partial (map-side) aggregation of the runs to
(job, bucket of durations) rows; counts, the fleet rate, means, spreads
and the status are read from it, and it names the bucket that holds a percentile's rank.
Only the runs in those buckets are then looked at again, to name the value:
percentiles are the exact nearest rank at every size, and no group is collected.
Gaps between consecutive starts are computed in (job, minute) windows over distinct
starts (60,000 at most, however many runs a job has in a minute) and stitched on
a table with a row per job and minute, so no window ever holds a job's runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import MS_PER_DAY, money_sum
from fleetlens.operators.costing import runs_in_window
from fleetlens.operators.summaries import materialize
from fleetlens.plans.joins import DEFAULT_BROADCAST_ROWS, join_dimension, row_count_at_most

# Result states counted as success / failure.
SUCCESS_STATES = ("SUCCESS",)
FAILURE_STATES = ("FAILED", "TIMEDOUT")
#: Values (ms) of a percentile's bucket: at most so many distinct ones are ranked.
RANK_BUCKET = 65_536
MS_PER_MINUTE = 60_000


def _result(runs: DataFrame) -> Column:
    return F.col("state.result_state") if "state" in runs.columns else F.col("result_state")


def _bucket(value: Column) -> Column:
    return F.floor(value / F.lit(RANK_BUCKET))


def held_buckets(counts: DataFrame, key: str, p: float) -> DataFrame:
    """(key, _b, _inside): the bucket with the rank ceil(p * n) of each key and the
    rank within it, from ``counts`` (key, _b, _n)."""
    per_key = Window.partitionBy(key)
    so_far = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.select(key, "_b", "_n", F.sum("_n").over(so_far).alias("_upto"), F.greatest(F.ceil(F.lit(p) * F.sum("_n").over(per_key)), F.lit(1)).alias("_rank"))
    inside = F.col("_rank") - F.col("_upto") + F.col("_n")
    return upto.where((F.col("_upto") >= F.col("_rank")) & (inside >= 1)).select(key, "_b", inside.alias("_inside"))


def value_at(values: DataFrame, held: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the value with rank ``_inside`` among those of the held bucket.
    ``values`` has (key, _v, _w); rows of other buckets fall away before anything is
    grouped."""
    v = values.withColumn("_b", _bucket(F.col("_v"))).join(held, [key, "_b"])
    each = v.groupBy(key, "_v").agg(F.sum("_w").alias("_n"), F.any_value("_inside").alias("_inside"))
    so_far = Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = each.withColumn("_upto", F.sum("_n").over(so_far))
    return ranked.where(F.col("_upto") >= F.col("_inside")).groupBy(key).agg(F.min("_v").alias(name))


def exact_percentile(df: DataFrame, key: str, value: str, p: float, name: str, weight: str | None = None) -> DataFrame:
    """(key, name): the nearest-rank percentile, value number ceil(p * n), of each
    key's non-NULL values (each counted ``weight`` times); keys without any have no row."""
    v = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counts = v.groupBy(key, _bucket(F.col("_v")).alias("_b")).agg(F.sum("_w").alias("_n"))
    return value_at(v, held_buckets(counts, key, p), key, name)


def _observed(runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    return runs_in_window(runs, window_start_ms).where(F.col("job_id").isNotNull()).select(
        "job_id", "start_time", "duration_ms", _result(runs).alias("result_state")
    )


def run_profile(
    runs: DataFrame, window_start_ms: int | None, *, failure_states: tuple[str, ...] = FAILURE_STATES, write: bool = False
) -> DataFrame:
    """One pass over the runs: a row per job and bucket of durations (NULL for runs
    without one) with mergeable counts and sums. ``write`` it once where several things
    are read from it over many runs: they then scan the runs no more (a small write
    costs more than a narrow scan of few runs)."""
    ok, bad, d = F.col("result_state").isin(*SUCCESS_STATES), F.col("result_state").isin(*failure_states), F.col("duration_ms")
    profile = _observed(runs, window_start_ms).groupBy("job_id", _bucket(d).alias("_b")).agg(
        F.count("*").alias("run_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(bad).alias("failure_count"),
        F.count("duration_ms").alias("timed_count"),
        F.sum("duration_ms").alias("duration_sum"),
        F.sum(d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).alias("square_sum"),
        F.max("start_time").alias("last_run_time"),
        F.max(F.when(ok, F.col("start_time"))).alias("last_success_time"),
        F.max(F.when(bad, F.col("start_time"))).alias("last_failure_time"),
    )
    return materialize(profile) if write else profile


def profile_stats(profile: DataFrame) -> DataFrame:
    """Per job: counts, failure rate, mean duration and last starts of a profile."""
    stats = profile.groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("run_count", "success_count", "failure_count")],
        F.round(F.try_divide(F.sum("duration_sum").cast("double"), F.sum("timed_count").cast("double"))).cast("long").alias("avg_duration_ms"),
        *[F.max(c).alias(c) for c in ("last_run_time", "last_success_time", "last_failure_time")],
    )
    return stats.withColumn("failure_rate", F.col("failure_count") / F.col("run_count"))


def profile_spread(profile: DataFrame) -> DataFrame:
    """Per job with durations: count, mean, sample stddev and coefficient of
    variation, from exact sums: n * (sum of squares) - (sum)^2 loses no digit."""
    s = profile.groupBy("job_id").agg(
        F.sum("timed_count").alias("run_count"), F.sum("duration_sum").alias("_s"), F.sum("square_sum").cast("decimal(38,0)").alias("_q")
    ).where(F.col("run_count") > 0)
    n = F.col("run_count")
    exact = n.cast("decimal(19,0)") * F.col("_q").cast("decimal(38,0)") - F.col("_s").cast("decimal(19,0)") * F.col("_s").cast("decimal(19,0)")
    variance = F.when(n > 1, F.greatest(exact.cast("double"), F.lit(0.0)) / n / (n - 1))
    return s.select("job_id", "run_count", (F.col("_s") / n).alias("avg_duration_ms"), F.sqrt(variance).alias("stddev_duration_ms")).withColumn(
        "cv", F.try_divide(F.col("stddev_duration_ms"), F.col("avg_duration_ms"))
    )


def job_stats(
    runs: DataFrame,
    costed: DataFrame | None,
    window_start_ms: int | None,
    window_days: int,
    *,
    failure_states: tuple[str, ...] = FAILURE_STATES,
    profile: DataFrame | None = None,
) -> DataFrame:
    """B1: per job run/success/failure counts, failure rate, mean and p95
    duration (ms, rounded), last run/success/failure start, and cost. ``profile``: a
    written :func:`run_profile` of the same runs and window."""
    written = profile is not None
    if not written:
        profile = run_profile(runs, window_start_ms, failure_states=failure_states)
    counts = profile.where(F.col("_b").isNotNull()).select("job_id", "_b", F.col("timed_count").alias("_n"))
    values = _observed(runs, window_start_ms).where(F.col("duration_ms").isNotNull()).select("job_id", F.col("duration_ms").alias("_v"), F.lit(1).cast("long").alias("_w"))
    held = held_buckets(counts, "job_id", 0.95)
    # a bucket a job: its size is bounded by that of the written profile; without one
    # the join is left to AQE
    held = F.broadcast(held) if written and row_count_at_most(profile, DEFAULT_BROADCAST_ROWS) else held
    p95 = value_at(values, held, "job_id", "p95_duration_ms")
    stats = profile_stats(profile).join(p95, "job_id", "left").withColumn("window_days", F.lit(int(window_days)))
    if costed is not None:
        cost = costed.groupBy("job_id").agg(money_sum("estimated_cost").alias("estimated_cost"))
        stats = stats.join(cost, "job_id", "left")
    return stats


def fleet_failure_rate(stats: DataFrame) -> Column:
    """Scalar: failures / runs over all jobs (0 when there are no runs)."""
    return stats.agg(
        F.coalesce(F.try_divide(F.sum("failure_count").cast("double"), F.sum("run_count").cast("double")), F.lit(0.0))
    ).scalar()


def failure_above_fleet(stats: DataFrame, min_runs: int = 5) -> DataFrame:
    """B2: jobs with at least ``min_runs`` runs whose failure rate exceeds the fleet rate."""
    fleet = fleet_failure_rate(stats)
    return stats.where((F.col("run_count") >= min_runs) & (F.col("failure_rate") > fleet)).select(
        "job_id", "run_count", "failure_count", "failure_rate", fleet.alias("fleet_failure_rate")
    )


def job_starts(runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    """(job_id, start_time, k): the runs of each job by start (NULL: none), one pass."""
    base = runs_in_window(runs, window_start_ms).where(F.col("job_id").isNotNull())
    return base.groupBy("job_id", "start_time").agg(F.count("*").alias("k"))


def run_gaps(starts: DataFrame, bucket_ms: int = MS_PER_MINUTE) -> DataFrame:
    """(job_id, gap_ms, n): gaps between consecutive run starts of each job and how
    often each comes, from :func:`job_starts`.

    Runs that start together are one row (k of them have k - 1 gaps of 0), so a (job,
    bucket) window holds ``bucket_ms`` rows at most. The first start of a bucket takes its
    gap from the last one of the job's previous non-empty bucket, found by a window over
    the bucket-grain table (at most window / bucket rows per job). Runs without a start
    have no gaps: every difference with them is NULL."""
    b = starts.withColumn("bucket", F.floor(F.col("start_time") / F.lit(bucket_ms)))
    inner_w = Window.partitionBy("job_id", "bucket").orderBy("start_time")
    steps = b.select("job_id", "bucket", "start_time", "k", F.lag("start_time").over(inner_w).alias("before"))
    one = F.lit(1).cast("long")
    inner = steps.select("job_id", F.explode(F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), F.struct((F.col("start_time") - F.col("before")).alias("gap_ms"), one.alias("n"))),
        F.when(F.col("start_time").isNotNull() & (F.col("k") > 1), F.struct(F.lit(0).cast("long").alias("gap_ms"), (F.col("k") - 1).alias("n"))),
    ))).alias("g")).select("job_id", "g.*")
    bounds = steps.groupBy("job_id", "bucket").agg(F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    edge_w = Window.partitionBy("job_id").orderBy("bucket")
    edges = bounds.select("job_id", (F.col("first") - F.lag("last").over(edge_w)).alias("gap_ms"), one.alias("n")).where(F.col("gap_ms").isNotNull())
    return inner.unionByName(edges)


def execution_frequency(runs: DataFrame, window_start_ms: int | None, window_days: int) -> DataFrame:
    """Runs per day over the window and the median gap between starts
    (nearest-rank median)."""
    starts = job_starts(runs, window_start_ms)
    counts = starts.groupBy("job_id").agg(F.sum("k").alias("run_count"))
    gaps = run_gaps(starts).groupBy("job_id", "gap_ms").agg(F.sum("n").alias("n"))
    median = exact_percentile(gaps, "job_id", "gap_ms", 0.5, "median_gap_ms", "n")
    days = float(max(1, window_days))
    return counts.join(median, "job_id", "left").select(
        "job_id",
        "run_count",
        (F.col("run_count") / F.lit(days)).alias("runs_per_day"),
        "median_gap_ms",
    )


def duration_spread(runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    """Per job: count, mean, sample stddev and coefficient of variation of durations."""
    return profile_spread(run_profile(runs, window_start_ms))


def unstable_jobs(runs: DataFrame, window_start_ms: int | None, cv_threshold: float = 0.5, min_runs: int = 3) -> DataFrame:
    """Jobs whose duration stddev / mean >= ``cv_threshold`` (>= fires at equality)."""
    s = duration_spread(runs, window_start_ms)
    return s.where((F.col("run_count") >= min_runs) & (F.col("cv") >= F.lit(float(cv_threshold))))


def runtime_degradation(
    runs: DataFrame, as_of_ms: int, window_days: int, change_threshold: float = 0.2
) -> DataFrame:
    """Mean duration in the recent half of the window vs the earlier half,
    the relative change, the least-squares slope of duration on day (ms/day),
    and ``degrading`` when the change >= ``change_threshold``. Jobs need runs
    in both halves."""
    start = int(as_of_ms) - int(window_days) * MS_PER_DAY
    mid = int(as_of_ms) - int(window_days) * MS_PER_DAY // 2
    base = runs_in_window(runs, start).where(
        F.col("job_id").isNotNull() & F.col("duration_ms").isNotNull() & F.col("start_time").isNotNull()
    ).select("job_id", "start_time", F.col("duration_ms").cast("double").alias("d"))
    recent = F.col("start_time") >= F.lit(mid)
    agg = base.groupBy("job_id").agg(
        F.avg(F.when(~recent, F.col("d"))).alias("earlier_avg_ms"),
        F.avg(F.when(recent, F.col("d"))).alias("recent_avg_ms"),
        F.regr_slope(F.col("d"), (F.col("start_time") - F.lit(start)) / F.lit(float(MS_PER_DAY))).alias("slope_ms_per_day"),
    )
    change = (F.col("recent_avg_ms") - F.col("earlier_avg_ms")) / F.col("earlier_avg_ms")
    return (
        agg.where(F.col("earlier_avg_ms").isNotNull() & F.col("recent_avg_ms").isNotNull() & (F.col("earlier_avg_ms") > 0))
        .withColumn("change_pct", change)
        .withColumn("degrading", F.col("change_pct") >= F.lit(float(change_threshold)))
    )


def orphan_jobs(jobs: DataFrame, runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    """Jobs with no owner, a paused schedule, or no run in the window;
    ``reasons`` lists every rule that matched."""
    ran = runs_in_window(runs, window_start_ms).where(F.col("job_id").isNotNull()).select("job_id").distinct()
    with_runs = jobs.join(ran.withColumn("_ran", F.lit(True)), "job_id", "left")
    reasons = F.filter(
        F.array(
            F.when(F.col("creator_user_name").isNull() | (F.col("creator_user_name") == ""), F.lit("no_owner")),
            F.when(F.col("schedule.pause_status") == "PAUSED", F.lit("paused_schedule")),
            F.when(F.col("_ran").isNull(), F.lit("no_recent_runs")),
        ),
        lambda r: r.isNotNull(),
    )
    return with_runs.select("job_id", "name", reasons.alias("reasons")).where(F.size("reasons") > 0)


def cost_period_delta(costed_two_windows: DataFrame, as_of_ms: int, window_days: int) -> DataFrame:
    """Per job, cost in the current window vs the previous equal window.

    ``costed_two_windows`` must cover both windows (start >= as_of - 2w);
    runs without a start count in the current window (they are kept by every
    window, C1). ``delta_pct`` is NULL when there was no previous cost."""
    cur_start = int(as_of_ms) - int(window_days) * MS_PER_DAY
    prev_start = cur_start - int(window_days) * MS_PER_DAY
    st = F.col("start_time")
    current = st.isNull() | (st >= F.lit(cur_start))
    previous = (st >= F.lit(prev_start)) & (st < F.lit(cur_start))
    agg = costed_two_windows.groupBy("job_id").agg(
        F.coalesce(money_sum(F.when(current, F.col("estimated_cost"))), F.lit(0.0)).alias("current_cost"),
        F.coalesce(money_sum(F.when(previous, F.col("estimated_cost"))), F.lit(0.0)).alias("previous_cost"),
        F.count_if(current).alias("current_runs"),
        F.count_if(previous).alias("previous_runs"),
    )
    return agg.withColumn("delta_cost", F.col("current_cost") - F.col("previous_cost")).withColumn(
        "delta_pct", F.try_divide(F.col("delta_cost"), F.nullif(F.col("previous_cost"), F.lit(0.0)))
    )


def usage_units(costed: DataFrame, pricing_config: DataFrame, include_driver: bool = True) -> DataFrame:
    """Usage units (DBU) per costed run = (worker DBU/h x workers [+ driver
    DBU/h]) x hours. The config is node-type grain (broadcast).

    Also returns ``dbu_ms`` (DBU/h x milliseconds): aggregate that and convert
    once with :func:`dbus_from_ms`; for rates that are multiples of a binary
    fraction the sum is exact, so totals do not depend on summation order."""
    cfg = pricing_config.select("node_type_id", F.coalesce("dbus_per_hour", F.lit(0.0)).alias("w_dbus"))
    out = join_dimension(costed, cfg, "node_type_id", "left")
    per_hour = F.col("w_dbus") * F.col("workers")
    if include_driver:
        dcfg = cfg.select(F.col("node_type_id").alias("driver_node_type_id"), F.col("w_dbus").alias("d_dbus"))
        out = join_dimension(out, dcfg, "driver_node_type_id", "left")
        per_hour = per_hour + F.col("d_dbus")
    return out.select(
        "run_id",
        "job_id",
        (per_hour * F.col("duration_ms")).alias("dbu_ms"),
        (per_hour * (F.col("duration_ms") / F.lit(3_600_000.0))).alias("dbus"),
    )


def dbus_from_ms(dbu_ms: Column) -> Column:
    return dbu_ms / F.lit(3_600_000.0)


def job_health_status(
    stats: DataFrame, degradation: DataFrame, spread: DataFrame, *, failing_rate: float = 0.25,
    cv_threshold: float = 0.5, min_runs: int = 3,
) -> DataFrame:
    """First matching label of failing / degrading / unstable / healthy."""
    d = degradation.select("job_id", "degrading")
    s = spread.select("job_id", F.col("run_count").alias("_n"), "cv")
    j = stats.select("job_id", "failure_rate").join(d, "job_id", "left").join(s, "job_id", "left")
    status = (
        F.when(F.col("failure_rate") >= F.lit(float(failing_rate)), F.lit("failing"))
        .when(F.coalesce(F.col("degrading"), F.lit(False)), F.lit("degrading"))
        .when((F.col("_n") >= min_runs) & (F.col("cv") >= F.lit(float(cv_threshold))), F.lit("unstable"))
        .otherwise(F.lit("healthy"))
    )
    return j.select("job_id", status.alias("status"))
