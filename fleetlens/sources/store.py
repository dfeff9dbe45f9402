"""The workspace store: jobs, runs, clusters and metadata, committed together.

One sync is one commit of the log (``commits.CommitLog``): new folders are written
first, then one numbered file names the folders that hold each table, so a reader sees
all of a sync or nothing of it. Within a sync the record landed last wins a key, and a
sync wins over the ones before it.

* jobs, clusters, metadata (small): a whole new folder per sync that changes them.
* runs (large): a folder per UTC start day (``none`` without a start). A sync rewrites
  the days of its rows and the days that hold one of its keys now; the commit maps
  each day to the folder that holds it. That map, and the days a sync touches, are as many as
  the calendar has days, whatever the number of runs.
* ``runs_index``: where each run is. Rows (run_id, day) in folders by a hash of
  run_id, one part per sync with the runs that are new or moved; a sync reads the
  buckets of its own keys, never the keys of the whole history. After ``INDEX_PARTS``
  parts they are merged into one.
* clusters no run has referred to yet wait in ``clusters_waiting`` and enter when one
  does: the store holds the clusters its runs refer to.

Folders that no commit names (of a writer that crashed or lost) are read by nobody.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens import schemas as S
from fleetlens.functions import utc_day
from fleetlens.operators import pricing
from fleetlens.operators.dedupe import latest_by_key
from fleetlens.sources.commits import CommitConflict, CommitLog
from fleetlens.sources.ingest import distinct_cluster_ids

#: Column that orders the records of one sync; the greatest wins.
LANDED = "_landed"
NO_DAY = "none"
INDEX_BUCKETS = 64
INDEX_PARTS = 16
_INDEX = "run_id long, day string, bucket int"
_METADATA = StructType().add("key", "string").add("value", "string")
_SMALL: dict[str, tuple[str, StructType]] = {
    "jobs": ("job_id", S.JOBS),
    "clusters": ("cluster_id", S.CLUSTERS),
    "clusters_waiting": ("cluster_id", S.CLUSTERS),
    "metadata": ("key", _METADATA),
}


@dataclass(frozen=True)
class Batch:
    """Typed records of one sync; each table may have a ``_landed`` column."""

    jobs: DataFrame | None = None
    runs: DataFrame | None = None
    clusters: DataFrame | None = None


def _by_merge(keys: DataFrame) -> DataFrame:
    """Keys of a batch or of the store, for a join: as many as there are records, so they
    are not broadcast, whatever Spark estimates from the bytes of their files."""
    return keys.hint("merge")


def last_landed(records: DataFrame, key: str) -> DataFrame:
    """One record per key, the one landed last (all columns but ``_landed``).
    Without that column the keys must be unique or their choice does not matter."""
    if LANDED not in records.columns:
        return records.dropDuplicates([key])
    return latest_by_key(records, [key], [LANDED]).drop(LANDED)


class WorkspaceStore:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._log = CommitLog(spark, self._root)

    # ------------------------------------------------------------- reading

    def state(self) -> tuple[int, dict]:
        """(number, content) of the last commit."""
        return self._log.latest()

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """jobs, clusters, clusters_waiting or metadata as last committed."""
        state = self.state()[1] if state is None else state
        folder = state.get("tables", {}).get(name)
        schema = _SMALL[name][1]
        return self._spark.read.schema(schema).parquet(f"{self._root}/{folder}") if folder else self._spark.createDataFrame([], schema)

    def read_runs(self, window_start_ms: int | None = None, state: dict | None = None) -> DataFrame:
        """Runs as last committed, with their ``day``. With a window start only the
        folders of its days are listed and read (runs without a start are in every window)."""
        state = self.state()[1] if state is None else state
        days = state.get("runs", {})
        if window_start_ms is not None:
            first = self._spark.range(1).select(utc_day(F.lit(int(window_start_ms))).cast("string")).first()[0]
            days = {d: part for d, part in days.items() if d == NO_DAY or d >= first}
        out = self._days(days)
        if window_start_ms is not None:
            out = out.where(F.col("start_time").isNull() | (F.col("start_time") >= F.lit(int(window_start_ms))))
        return out

    def _days(self, days: dict[str, str]) -> DataFrame:
        schema = StructType([*S.RUNS.fields]).add("part", "string").add("day", "string")
        if not days:
            return self._spark.createDataFrame([], schema).drop("part")
        paths = [f"{self._root}/runs/part={part}/day={day}" for day, part in sorted(days.items())]
        return self._spark.read.schema(schema).option("basePath", f"{self._root}/runs").parquet(*paths).drop("part")

    def metadata_get(self, key: str) -> str | None:
        row = self.read("metadata").where(F.col("key") == key).select("value").first()
        return None if row is None else row["value"]

    # ------------------------------------------------------------- writing

    def metadata_put(self, entries: DataFrame, attempts: int = 10) -> int:
        """Set ``key``/``value`` rows (last ``_landed`` per key wins); the commit number.
        A writer that loses a race starts over on the other's state, so both stay."""
        return self._retry(lambda n, state: self._commit(n, state, tables={"metadata": self._merged("metadata", entries, state)}), attempts)

    def save_pricing_config(self, entries: DataFrame, order_col: str = "ordinal") -> int:
        """Replace the stored pricing entries by ``entries`` (node_type_id,
        dbus_per_hour, plan, in ``order_col`` order), normalised; an invalid one raises and
        nothing changes. The discovered node types and their refresh time stay."""
        valid = pricing.assert_valid_config(pricing.normalise_config(entries, order_col))

        def put(n: int, state: dict) -> int:
            stored = self.read("metadata", state).where(F.col("key") == pricing.CONFIG_KEY)
            _, discovered = pricing.decode_config(stored)
            at = stored.select(F.get_json_object("value", "$.last_refreshed_at")).first()
            row = pricing.encode_config(valid, discovered, at[0] if at else None)
            return self._commit(n, state, tables={"metadata": self._merged("metadata", row, state)})

        return self._retry(put, 10)

    def sync(self, batch: Batch, synced_at: str, application: str | None = None, epoch: int | None = None, attempts: int = 10) -> dict:
        """Merge a batch and commit it as one unit; the rows offered per table
        (``clusters``: those a run refers to) and the commit number.

        With an ``application`` and its ``epoch`` the merge happens once: an epoch at
        or below the last one committed for the application changes nothing."""

        def merge(n: int, state: dict) -> dict:
            if application is not None and state.get("epochs", {}).get(application, -1) >= epoch:
                return {"commit": n, "replayed": True}
            tables, change, saved = {}, {}, {"jobs": 0, "runs": 0, "clusters": 0}
            if batch.jobs is not None and (offered := batch.jobs.count()):
                tables["jobs"], saved["jobs"] = self._merged("jobs", batch.jobs, state), offered
            if batch.runs is not None and (offered := batch.runs.count()):
                change, saved["runs"] = self._merge_runs(batch.runs, state), offered
            if batch.runs is not None or batch.clusters is not None:
                found, saved["clusters"] = self._merge_clusters(batch, state)
                tables |= found
            stamp = self._spark.createDataFrame([("last_sync_at", synced_at)], _METADATA)
            tables["metadata"] = self._merged("metadata", stamp, state)
            epochs = {application: epoch} if application is not None else {}
            saved = {f"saved_{k}": v for k, v in saved.items()} | {"last_sync_at": synced_at}
            return saved | {"commit": self._commit(n, state, tables, change, epochs, saved), "replayed": False}

        return self._retry(merge, attempts)

    def _retry(self, change: Callable, attempts: int):
        for left in range(attempts - 1, -1, -1):
            try:
                return change(*self.state())
            except CommitConflict:
                if not left:
                    raise

    def _commit(self, n: int, state: dict, tables: dict, change: dict | None = None, epochs: dict | None = None, counts: dict | None = None) -> int:
        content = state | (change or {})
        content |= {"tables": state.get("tables", {}) | tables, "epochs": state.get("epochs", {}) | (epochs or {})}
        if counts is not None:
            content["last_sync"] = counts
        self._log.commit(n + 1, content)
        return n + 1

    def _new_folder(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def _write_small(self, name: str, rows: DataFrame) -> str:
        folder = self._new_folder(name)
        rows.select(*_SMALL[name][1].names).write.parquet(f"{self._root}/{folder}")
        return folder

    def _merged(self, name: str, records: DataFrame, state: dict) -> str:
        """Folder of table ``name`` with ``records`` over what it has now."""
        key = _SMALL[name][0]
        new = last_landed(records, key)
        kept = self.read(name, state).join(_by_merge(new.select(key)), key, "left_anti")
        return self._write_small(name, kept.select(*_SMALL[name][1].names).unionByName(new.select(*_SMALL[name][1].names)))

    def _merge_clusters(self, batch: Batch, state: dict) -> tuple[dict, int]:
        """Clusters a run refers to enter the store; others wait. The count is of
        this batch's records that enter."""
        stored, waiting = self.read("clusters", state), self.read("clusters_waiting", state)
        wanted = stored.select("cluster_id")
        if batch.runs is not None:
            wanted = wanted.union(distinct_cluster_ids(batch.runs))
        wanted = wanted.distinct()
        names, offered = S.CLUSTERS.names, 0
        arrived = self._spark.createDataFrame([], S.CLUSTERS)
        if batch.clusters is not None:
            offered = batch.clusters.join(_by_merge(wanted), "cluster_id", "left_semi").count()
            arrived = last_landed(batch.clusters, "cluster_id").select(*names)
        candidates = arrived.unionByName(waiting.join(_by_merge(arrived.select("cluster_id")), "cluster_id", "left_anti").select(*names))
        entering = candidates.join(_by_merge(wanted), "cluster_id", "left_semi")
        kept = stored.join(_by_merge(entering.select("cluster_id")), "cluster_id", "left_anti")
        out = {
            "clusters": self._write_small("clusters", kept.select(*names).unionByName(entering.select(*names))),
            "clusters_waiting": self._write_small("clusters_waiting", candidates.join(_by_merge(wanted), "cluster_id", "left_anti")),
        }
        return out, offered

    def _merge_runs(self, runs: DataFrame, state: dict) -> dict:
        """Days rewritten with the batch's runs, and their places added to the index."""
        spark = self._spark
        days, parts = dict(state.get("runs", {})), list(state.get("index", []))
        part = uuid.uuid4().hex
        place = F.coalesce(utc_day("start_time").cast("string"), F.lit(NO_DAY))
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(INDEX_BUCKETS)).cast("int")
        staged = f"{self._root}/runs_staged/{part}"
        last_landed(runs, "run_id").select(*S.RUNS.names).withColumns({"day": place, "bucket": bucket}).write.parquet(staged)
        new = spark.read.parquet(staged)
        keys = new.select("run_id", "day", "bucket")
        old = self._places(keys, parts)
        touched = {r[0] for r in old.select("day").union(new.select("day")).distinct().collect()}
        held = self._days({d: days[d] for d in touched if d in days})
        merged = held.join(_by_merge(new.select("run_id")), "run_id", "left_anti").select(*S.RUNS.names, "day").unionByName(new.drop("bucket"))
        # few files a day; a large day is split over several writers
        merged.hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{self._root}/runs/part={part}")
        written = {r[0] for r in spark.read.schema("day string").parquet(f"{self._root}/runs/part={part}").select("day").distinct().collect()}
        days = {d: p for d, p in days.items() if d not in touched} | {d: part for d in written}
        moved = keys.join(_by_merge(old.withColumnRenamed("day", "was")), "run_id", "left").where(F.col("was").isNull() | (F.col("was") != F.col("day")))
        self._write_index(moved.select("run_id", "day", "bucket"), part)
        parts.append(part)
        if len(parts) > INDEX_PARTS:
            part = uuid.uuid4().hex
            self._write_index(self._latest_places(self._index(parts)), part)
            parts = [part]
        self.delete(staged)
        return {"runs": days, "index": parts}

    def _write_index(self, places: DataFrame, part: str) -> None:
        places.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "run_id").write.partitionBy("bucket").parquet(f"{self._root}/runs_index/part={part}")

    def _index(self, parts: list[str]) -> DataFrame:
        """Index rows with ``since``, the place of their part in the order of syncs."""
        top = f"{self._root}/runs_index"
        if not parts:
            return self._spark.createDataFrame([], f"{_INDEX}, since int")
        rows = self._spark.read.schema("run_id long, day string, part string, bucket int").option("basePath", top).parquet(*[f"{top}/part={p}" for p in parts])
        return rows.withColumn("since", F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("part")).cast("int")).drop("part")

    def _latest_places(self, index: DataFrame) -> DataFrame:
        return index.groupBy("run_id", "bucket").agg(F.max_by("day", "since").alias("day")).select("run_id", "day", "bucket")

    def _places(self, keys: DataFrame, parts: list[str]) -> DataFrame:
        """(run_id, day) of those keys that are in the store; only the buckets of the
        keys are read (``INDEX_BUCKETS`` numbers at most reach the driver)."""
        buckets = [r[0] for r in keys.select("bucket").distinct().collect()]
        index = self._index(parts).where(F.col("bucket").isin(buckets))
        return self._latest_places(index.join(_by_merge(keys.select("run_id")), "run_id", "left_semi")).select("run_id", "day")

    def delete(self, path: str) -> None:
        """Delete a folder that no commit names."""
        where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._spark._jsc.sc().hadoopConfiguration()).delete(where, True)

    def remove_unreferenced(self, keep_commits: int = 2) -> int:
        """Delete data folders that none of the last ``keep_commits`` commits names
        (superseded, or left by writers that crashed). Not while others write."""
        n, _ = self.state()
        live: set[str] = set()
        for i in range(max(1, n - keep_commits + 1), n + 1):
            c = self._log.read(i)
            live |= set(c.get("tables", {}).values()) | {f"runs/part={p}" for p in c.get("runs", {}).values()} | {f"runs_index/part={p}" for p in c.get("index", [])}
        jvm = self._spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self._root).getFileSystem(self._spark._jsc.sc().hadoopConfiguration())
        gone = 0
        for name in [*_SMALL, "runs", "runs_index", "runs_staged"]:
            top = jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}")
            for s in fs.listStatus(top) if fs.exists(top) else []:
                if f"{name}/{s.getPath().getName()}" not in live:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone
