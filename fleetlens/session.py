"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "fleetlens") -> SparkSession:
    """A local session configured like the cluster one: AQE on, UTC, no UI.

    On a cluster the session is built by the platform; these settings are the
    ones the library relies on (UTC day bucketing, AQE skew splitting).
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Identity of the running application (keys per-session caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return str(spark.conf.get("spark.app.id", None) or id(spark))


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def is_local(spark: SparkSession) -> bool:
    """Driver and executors in one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_LOCAL_CKPT: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names the folder; only when it is unset under a local master
    (tests) do we create a private one under /tmp. Elsewhere executors would not
    share it, so a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not configured:
        configured = _LOCAL_CKPT.setdefault(app_id(spark), tempfile.mkdtemp(prefix="fleetlens-ckpt-", dir="/tmp"))
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder; what is written there is
    deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetlens-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(where)
    return path
