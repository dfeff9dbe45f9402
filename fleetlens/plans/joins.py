"""Join strategies for fact x dimension joins with a checked broadcast size.

A dimension is broadcast only after a count proves it is below ``max_rows``
(a distributed count, remembered per plan). Beyond that the
join is a salted shuffle join: each fact row gets a deterministic salt in
``[0, buckets)`` and the (unique-keyed) dimension is replicated once per salt,
so a hot key that holds a third of the fact rows is spread over ``buckets``
tasks instead of one. AQE's skew-join splitting stays on as a second line.
A dimension found too large is never broadcast: Spark estimates it by the bytes of
its (compressed) files, without the salt's copies, so such joins ask for a merge join.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import app_id, default_parallelism

# Default bound for broadcasting a dimension: 500k rows of the narrow
# dimensions used here (~100 bytes each) is ~50 MB per executor; beyond it the
# salted shuffle join is used. Tune per call site.
DEFAULT_BROADCAST_ROWS = 500_000
DEFAULT_SALT_BUCKETS = 16
_SALT = "__salt"


# Size checks are remembered per (plan, bound) for a short while, so the many
# views built over one dimension in a session do not recount it each time.
SIZE_CHECK_TTL_SEC = 600.0
_size_checks: dict[tuple[str, int, int], tuple[float, bool]] = {}


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain ``count()``: partial counts per partition, one row each to the
    final sum. (``limit(n + 1).count()`` would gather up to n rows from
    *every* partition into one task before limiting.) One scan of the
    dimension, remembered per plan."""
    key = (app_id(df.sparkSession), df.semanticHash(), int(max_rows))
    now = time.monotonic()
    hit = _size_checks.get(key)
    if hit is not None and now - hit[0] < SIZE_CHECK_TTL_SEC:
        return hit[1]
    ok = df.count() <= max_rows
    _size_checks[key] = (now, ok)
    return ok


_unique_checks: dict[tuple[str, int, str], tuple[float, bool]] = {}


def has_unique_key(df: DataFrame, key: str) -> bool:
    """True when no value of ``key`` (NULL aside) is there twice: one aggregation
    by key, remembered per plan like the size checks."""
    seen = (app_id(df.sparkSession), df.semanticHash(), key)
    now = time.monotonic()
    hit = _unique_checks.get(seen)
    if hit is not None and now - hit[0] < SIZE_CHECK_TTL_SEC:
        return hit[1]
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    ok = not per_key.agg(F.coalesce(F.max("n"), F.lit(0)) > 1).first()[0]
    _unique_checks[seen] = (now, ok)
    return ok


def clear_size_checks() -> None:
    _size_checks.clear()
    _unique_checks.clear()


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    *,
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    salt_by: Column | str | None = None,
    salt_buckets: int = DEFAULT_SALT_BUCKETS,
    known_small: bool = False,
) -> DataFrame:
    """Join ``fact`` to a dimension whose join keys are unique.

    ``known_small`` skips the count for dimensions bounded by construction
    (e.g. a one-row scalar). ``salt_by`` is a deterministic per-row fact column
    used to spread hot keys when the dimension is too big to broadcast.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if known_small or row_count_at_most(dim, max_broadcast_rows):
        return fact.join(F.broadcast(dim), keys, how)
    if salt_by is None or salt_buckets <= 1 or how not in ("left", "inner", "left_outer"):
        return fact.join(dim.hint("merge"), keys, how)
    salt_src = F.col(salt_by) if isinstance(salt_by, str) else salt_by
    # a NULL key matches nothing: such rows get salts beyond the replicated ones,
    # which spreads them instead of sending all to salt_buckets tasks
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    h = F.xxhash64(salt_src)
    salt = F.when(null_key, salt_buckets + F.pmod(h, F.lit(1 << 20))).otherwise(F.pmod(h, F.lit(salt_buckets)))
    salted_fact = fact.withColumn(_SALT, salt.cast("int"))
    salted_dim = dim.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_fact.join(salted_dim.hint("merge"), [*keys, _SALT], how).drop(_SALT)


def spread_small_input(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has
    cores (e.g. one file with one row group), so the per-row work after it
    runs in parallel. Inputs already split at least that finely (any large
    table) are returned unchanged: no shuffle is added at scale."""
    want = min_partitions or default_parallelism(df.sparkSession)
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the scan as it is
        return df
    if have >= want:
        return df
    return df.repartition(want)
