"""Table freshness, volume and schema checks (B10-B14). Declared by the source
without code; the rules are ours and every threshold is a parameter.

Inputs are table-health logs: updates ``(table_name, updated_at, row_count)``
and schema observations ``(table_name, column_name, data_type, observed_at)``.
Everything is first aggregated to (table, day) or (table, column) grain, so
the windows below run over bounded, pre-aggregated rows, never raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.joins import join_dimension

# Issue classes.
ISSUE_STALE = "stale"
ISSUE_INCONSISTENT = "inconsistent"
ISSUE_VOLUME = "volume_anomaly"


def table_freshness(updates: DataFrame, sla: DataFrame, as_of: Column) -> DataFrame:
    """Last update per table vs its SLA (hours). ``lag_hours`` = as_of -
    last update; stale iff lag > SLA; ``hours_late`` = max(0, lag - SLA).
    ``sla`` is (table_name, sla_hours); tables without an SLA are not judged."""
    last = updates.groupBy("table_name").agg(F.max("updated_at").alias("last_updated_at"))
    lag = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_updated_at").cast("timestamp"))) / F.lit(3.6e9)
    return (
        join_dimension(last, sla, "table_name", "left")
        .withColumn("lag_hours", lag)
        .withColumn("stale", F.col("lag_hours") > F.col("sla_hours"))
        .withColumn("hours_late", F.greatest(F.col("lag_hours") - F.col("sla_hours"), F.lit(0.0)))
    )


def daily_updates(updates: DataFrame) -> DataFrame:
    """The log by (table, day): the last update and the rows of each day, one pass.
    It is a log itself, with a row per table and day, for the functions here."""
    return updates.groupBy("table_name", F.to_date("updated_at").alias("_day")).agg(
        F.max("updated_at").alias("updated_at"), F.sum("row_count").alias("row_count")
    ).drop("_day")


def daily_volume(updates: DataFrame) -> DataFrame:
    """Rows per (table, day) of the update log, with 0 for the days between a
    table's first day and the log's last one that it has no update on."""
    seen = updates.groupBy("table_name", F.to_date("updated_at").alias("day")).agg(F.sum("row_count").alias("volume"))
    last = updates.agg(F.max(F.to_date("updated_at"))).scalar()
    days = updates.groupBy("table_name").agg(F.min(F.to_date("updated_at")).alias("first")).where(F.col("first").isNotNull())
    days = days.select("table_name", F.explode(F.sequence("first", last)).alias("day"))
    return days.join(seen, ["table_name", "day"], "left").select("table_name", "day", F.coalesce("volume", F.lit(0)).alias("volume"))


def volume_anomalies(volume: DataFrame, trailing: int = 7, drop_threshold: float = 0.8) -> DataFrame:
    """A day whose volume is at least ``drop_threshold`` below the mean of
    the ``trailing`` previous days of the same table (full history required).
    ``drop_pct`` = 1 - volume / expected; >= fires at equality."""
    w = Window.partitionBy("table_name").orderBy("day").rowsBetween(-trailing, -1)
    with_exp = volume.select(
        "table_name", "day", "volume",
        F.avg("volume").over(w).alias("expected"),
        F.count("volume").over(w).alias("_n"),
    )
    return (
        with_exp.where((F.col("_n") == trailing) & (F.col("expected") > 0))
        .withColumn("drop_pct", F.lit(1.0) - F.col("volume") / F.col("expected"))
        .where(F.col("drop_pct") >= F.lit(float(drop_threshold)))
        .drop("_n")
    )


def schema_snapshot(observations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Columns observed in [start, end) with their latest observed type."""
    o = observations.where((F.col("observed_at") >= start) & (F.col("observed_at") < end))
    return o.groupBy("table_name", "column_name").agg(
        F.max_by("data_type", F.struct("observed_at", "data_type")).alias("data_type")
    )


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added / removed / retyped columns between two snapshots (full outer join)."""
    b = before.select("table_name", "column_name", F.col("data_type").alias("old_type"))
    a = after.select("table_name", "column_name", F.col("data_type").alias("new_type"))
    j = b.join(a, ["table_name", "column_name"], "full_outer")
    kind = (
        F.when(F.col("old_type").isNull(), F.lit("added"))
        .when(F.col("new_type").isNull(), F.lit("removed"))
        .when(F.col("old_type") != F.col("new_type"), F.lit("retyped"))
    )
    return j.withColumn("change", kind).where(F.col("change").isNotNull())


def type_history(observations: DataFrame, period: Column | None = None) -> DataFrame:
    """The last observed type of every column in every period it was observed in
    (default: years). Observations without a time belong to no period."""
    when = period if period is not None else F.year("observed_at")
    return (
        observations.withColumn("period", when.cast("long")).where(F.col("period").isNotNull())
        .groupBy("table_name", "column_name", "period")
        .agg(F.max_by("data_type", F.struct("observed_at", "data_type")).alias("data_type"))
    )


def schema_changes_by_period(history: DataFrame) -> DataFrame:
    """B12 over a whole log: columns added, removed or retyped in each period
    against the one before, from the log's second period to its last.

    Gaps and islands: only periods a column was observed in are rows. Where the
    one before it is further back, the column was removed after that one and added
    again here; where none follows before the log ends, it was removed after this one."""
    first, last = history.agg(F.min("period")).scalar(), history.agg(F.max("period")).scalar()
    w = Window.partitionBy("table_name", "column_name").orderBy("period")
    p, was, following = F.col("period"), F.lag("period").over(w), F.lead("period").over(w)
    h = history.select(
        "table_name", "column_name", "period", "data_type",
        was.alias("was"), F.lag("data_type").over(w).alias("was_type"), following.alias("following"), first.alias("first"), last.alias("last"),
    )
    none = F.lit(None).cast("string")

    def change(at: Column, old: Column, new: Column, kind: str) -> Column:
        return F.struct(at.alias("period"), old.alias("old_type"), new.alias("new_type"), F.lit(kind).alias("change"))

    gap = F.col("was") < p - 1
    found = F.array(
        F.when(gap, change(F.col("was") + 1, F.col("was_type"), none, "removed")),
        F.when(gap | (F.col("was").isNull() & (p > F.col("first"))), change(p, none, F.col("data_type"), "added")),
        F.when((F.col("was") == p - 1) & ~F.col("was_type").eqNullSafe(F.col("data_type")), change(p, F.col("was_type"), F.col("data_type"), "retyped")),
        F.when(F.col("following").isNull() & (p < F.col("last")), change(p + 1, F.col("data_type"), none, "removed")),
    )
    return h.select("table_name", "column_name", F.explode(F.array_compact(found)).alias("c")).select("table_name", "column_name", "c.*")


def data_issues(freshness: DataFrame, changes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Stale tables, inconsistent schemas (removed or retyped columns) and
    volume anomalies as one table of (issue_type, table_name, detail)."""
    stale = freshness.where(F.col("stale")).select(
        F.lit(ISSUE_STALE).alias("issue_type"),
        "table_name",
        F.concat(
            F.lit("missed its SLA by "), F.call_function("format_number", F.col("hours_late"), F.lit("0.0")), F.lit(" hours")
        ).alias("detail"),
    )
    what = F.concat(F.col("change"), F.lit(" column "), F.col("column_name"))
    if "period" in changes.columns:
        what = F.concat(what, F.lit(" in "), F.col("period").cast("string"))
    inconsistent = changes.where(F.col("change").isin("removed", "retyped")).select(
        F.lit(ISSUE_INCONSISTENT).alias("issue_type"), "table_name", what.alias("detail")
    )
    volume = anomalies.select(
        F.lit(ISSUE_VOLUME).alias("issue_type"),
        "table_name",
        F.concat(
            F.lit("volume dropped "), F.call_function("format_number", F.col("drop_pct") * F.lit(100.0), F.lit("0")),
            F.lit("% below expected on "), F.col("day").cast("string"),
        ).alias("detail"),
    )
    return stale.unionByName(inconsistent).unionByName(volume)


def with_upstream(issues: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Attach the one-hop upstream tables of each issue's table; without
    lineage edges the column is NULL (the feature degrades, T07)."""
    if edges is None:
        return issues.withColumn("upstream_tables", F.lit(None).cast("array<string>"))
    up = edges.groupBy("table_name").agg(F.sort_array(F.collect_set("upstream_table")).alias("upstream_tables"))
    return issues.join(up, "table_name", "left")
