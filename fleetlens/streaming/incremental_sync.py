"""Incremental sync as Structured Streaming, each micro-batch merged once.

Raw JSON records (one per line) land in ``landing/jobs``, ``landing/runs`` and
``landing/clusters`` (or folders below them). One file stream reads all three, so one
micro-batch is one sync: it is parsed by the batch ``normalise_*`` jobs, rows without
an id are appended to a quarantine folder, and the rest become one commit of the
workspace store, which also records the stream's id and the batch's epoch. Spark may
run a micro-batch again after a failure; the store then finds its epoch committed and
changes nothing.

Records of a batch are ordered as they landed: by file modification time, path, place of
the split in the file, line. The last one wins its key, as it would had the records
been saved one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources import ingest
from fleetlens.sources.store import LANDED, Batch, WorkspaceStore

PARSERS: dict[str, Callable] = {"jobs": ingest.normalise_jobs, "runs": ingest.normalise_runs, "clusters": ingest.normalise_clusters}
_FILE = ["file_modification_time", "file_path", "file_block_start"]


def landed_order(raw: DataFrame) -> DataFrame:
    """Text rows of a file scan with ``_landed``, their landing order. Lines of a split
    stay in order within a task, where Spark's row ids rise."""
    line = F.monotonically_increasing_id().alias("line")
    return raw.withColumn(LANDED, F.struct(*_FILE, line)).drop("file_modification_time", "file_block_start")


def parse_batch(records: DataFrame) -> tuple[Batch, dict[str, DataFrame]]:
    """Typed tables of a landed batch (``kind``, ``value``, ``_landed``) and, per kind,
    the raw rows without an id."""
    typed, bad = {}, {}
    for kind, parse in PARSERS.items():
        typed[kind], bad[kind] = parse(records.where(F.col("kind") == kind), keep=(LANDED,))
    return Batch(**typed), bad


def merge_epoch(store: WorkspaceStore, batch: DataFrame, application: str, epoch: int, synced_at: str, quarantine_dir: str | None = None) -> dict:
    """Merge one micro-batch (text rows with file columns) as one commit."""
    spark = batch.sparkSession
    if store.state()[1].get("epochs", {}).get(application, -1) >= epoch:
        return {"replayed": True}
    # written once: the merge reads the records several times
    staged = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    kind = F.regexp_extract("file_path", f"^.*/({'|'.join(PARSERS)})/", 1)
    landed_order(batch).select("value", LANDED, kind.alias("kind")).write.partitionBy("kind").parquet(staged)
    records = spark.read.schema(f"value string, {LANDED} struct<file_modification_time: timestamp, file_path: string, file_block_start: bigint, line: bigint>, kind string").parquet(staged)
    typed, bad = parse_batch(records)
    if quarantine_dir is not None:
        for name, rows in bad.items():
            # a folder per epoch, so a repeated batch replaces its own rows
            rows.write.mode("overwrite").text(f"{quarantine_dir.rstrip('/')}/{name}/application={application}/epoch={epoch}")
    out = store.sync(typed, synced_at, application, epoch)
    store.delete(staged)
    return out


def start_sync(
    spark: SparkSession,
    landing_dir: str,
    store_root: str,
    *,
    synced_at: str | None = None,
    checkpoint_location: str | None = None,
    quarantine_dir: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start (and return) the ``availableNow`` sync of everything landed. The store's
    record of epochs goes by the stream's id, which its checkpoint keeps."""
    if checkpoint_location is None:
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sync-checkpoint-{hashlib.md5(f'{landing_dir} {store_root}'.encode()).hexdigest()}"
    store = WorkspaceStore(spark, store_root)
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.load(landing_dir).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in _FILE])

    def merge(batch: DataFrame, epoch: int) -> None:
        application = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        now = synced_at or batch.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).first()[0]
        merge_epoch(store, batch, application, epoch, now, quarantine_dir)

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()


def sync_once(spark: SparkSession, landing_dir: str, store_root: str, **kw) -> None:
    """Drain everything landed so far and wait for it."""
    start_sync(spark, landing_dir, store_root, **kw).awaitTermination()
