"""Snapshots on Parquet (S1, S3-S6, S8, S10, B18): versioned folders and a commit log.

* ``upsert``: the current snapshot and a batch, the latest row per key
  (``latest_by_key``: partial aggregation, skew-safe), written as a **new** folder that
  a numbered commit then names (``commits.CommitLog``): a snapshot being read is
  never overwritten, and of two writers one wins.
* ``append_history`` (B18) appends each batch with its ``synced_at``; ``state_as_of``
  reads the partitions up to a time, ``validity_intervals`` says how long each row held.

The workspace as a whole (jobs, runs by day, referenced clusters, metadata, one commit
a sync) is ``store.WorkspaceStore``. Paths come from the caller (a shared folder on a
cluster, e.g. under the session's ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.functions import utc_day
from fleetlens.operators.dedupe import latest_by_key
from fleetlens.sources.commits import CommitLog

SEQ = "_sync_seq"


def _log(spark: SparkSession, root: str, name: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/{name}")


def current_version(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """(version, path) of the current snapshot, or None when there is none."""
    version, content = _log(spark, root, name).latest()
    return (version, f"{root.rstrip('/')}/{name}/{content['folder']}") if version else None


def write_snapshot(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = (), after: int | None = None) -> str:
    """Write ``df`` as the version after ``after`` (default: the current one) of
    snapshot ``name``. ``CommitConflict`` if another writer made that version."""
    spark = df.sparkSession
    log = _log(spark, root, name)
    if after is None:
        after = log.latest()[0]
    folder = f"v{after + 1:08d}-{uuid.uuid4().hex[:12]}"
    path = f"{root.rstrip('/')}/{name}/{folder}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    log.commit(after + 1, {"folder": folder})
    return path


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    cur = current_version(spark, root, name)
    return spark.read.parquet(cur[1]) if cur else None


def merge_latest(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Latest-by-key over current snapshot then batch: the batch wins on a key
    conflict; within a batch, the greatest ``order_by`` wins."""
    b = batch.withColumn(SEQ, F.lit(1))
    both = b if current is None else current.withColumn(SEQ, F.lit(0)).unionByName(b, allowMissingColumns=True)
    return latest_by_key(both, keys, [SEQ, *order_by]).drop(SEQ)


def upsert(batch: DataFrame, root: str, name: str, keys: Sequence[str], order_by: Sequence[str] = (),
           partition_by: Sequence[str] = ()) -> int:
    """Merge ``batch`` into snapshot ``name``; returns rows offered (duplicates counted)."""
    spark = batch.sparkSession
    offered = batch.count()
    cur = current_version(spark, root, name)
    merged = merge_latest(spark.read.parquet(cur[1]) if cur else None, batch, keys, order_by)
    write_snapshot(merged, root, name, partition_by, cur[0] if cur else 0)
    return offered


def with_start_date(runs: DataFrame) -> DataFrame:
    """S2 partition column: UTC day of the start (NULL when there is no start)."""
    return runs.withColumn("start_date", utc_day("start_time"))


def load_runs_window(runs: DataFrame, window_start_ms: int | None) -> DataFrame:
    """Runs with no start or a start >= the window start, newest first
    (NULL starts last). On a ``start_date``-partitioned snapshot the day
    predicate prunes partitions; the exact predicate then filters rows."""
    out = runs
    if window_start_ms is not None:
        w = F.lit(int(window_start_ms))
        if "start_date" in runs.columns:
            out = out.where(F.col("start_date").isNull() | (F.col("start_date") >= utc_day(w)))
        out = out.where(F.col("start_time").isNull() | (F.col("start_time") >= w))
    return out.orderBy(F.desc_nulls_last("start_time"), F.asc("run_id"))


def load_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs ordered by name (then id)."""
    return jobs.orderBy("name", "job_id")


def load_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters ordered by id."""
    return clusters.orderBy("cluster_id")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """State and cluster id promoted to top-level columns."""
    return runs.select(
        "run_id", "job_id", "run_name", "start_time", "end_time", "duration_ms",
        F.col("state.life_cycle_state").alias("life_cycle_state"),
        F.col("state.result_state").alias("result_state"),
        F.col("cluster_instance.cluster_id").alias("cluster_id"),
    )


# ------------------------------------------------------------------ history


def append_history(batch: DataFrame, root: str, name: str, synced_at: str) -> None:
    """Append a sync batch with its ``synced_at`` (partitioned by it)."""
    batch.withColumn("synced_at", F.lit(synced_at)).write.mode("append").partitionBy("synced_at").parquet(
        f"{root.rstrip('/')}/{name}_history"
    )


def read_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The appended history with ``synced_at`` as text, as it was given."""
    path = f"{root.rstrip('/')}/{name}_history"
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "synced_at"]
    return spark.read.schema(StructType([*fields, StructField("synced_at", StringType())])).parquet(path)


def latest_from_history(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest state per key from the appended history."""
    return latest_by_key(history, keys, ["synced_at"])


def state_as_of(history: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """The state per key after the syncs up to ``as_of``. The filter is on the
    partition column: later syncs are not read."""
    return latest_from_history(history.where(F.col("synced_at") <= F.lit(as_of)), keys)


def validity_intervals(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each synced row with the time it held from (``valid_from``) and until
    (``valid_to``, NULL while it holds). A window holds the syncs of one key."""
    following = F.lead("synced_at").over(Window.partitionBy(*keys).orderBy("synced_at"))
    return history.withColumn("valid_to", following).withColumnRenamed("synced_at", "valid_from")


def sync_counts(jobs: DataFrame, runs: DataFrame, clusters: DataFrame, last_sync_at: str | None = None) -> DataFrame:
    """Rows offered per table in one sync, plus the sync time."""
    return jobs.agg(F.count("*").alias("saved_jobs")).select(
        "saved_jobs",
        runs.agg(F.count("*")).scalar().alias("saved_runs"),
        clusters.agg(F.count("*")).scalar().alias("saved_clusters"),
        F.lit(last_sync_at).cast("string").alias("last_sync_at"),
    )
