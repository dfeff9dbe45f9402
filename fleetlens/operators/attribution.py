"""Tag attribution (A1-A4): split a run's cost equally over its pipeline / table keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_costs(costed: DataFrame, keys_col: str, *, keep_untagged: bool = False) -> DataFrame:
    """A4: one row per (run, key) with ``share = estimated_cost / number of keys``.

    Runs without keys contribute nothing, unless ``keep_untagged`` is set: then
    they give one row with a NULL key and the full cost, so that a single
    aggregation over the result also yields the grand total (untagged runs
    count in it). The row is first narrowed to the few columns the
    aggregations read, so the explode multiplies only those.
    """
    n = F.size(F.col(keys_col))
    narrow = costed.select("run_id", "start_time", "estimated_cost", "currency", keys_col)
    if not keep_untagged:
        narrow = narrow.where(n > 0)
    exploded = narrow.select(
        "run_id",
        "start_time",
        "estimated_cost",
        "currency",
        F.explode_outer(keys_col).alias("key"),
        F.greatest(n, F.lit(1)).alias("key_count"),
    )
    return exploded.withColumn(
        "share",
        F.when(F.col("key").isNull(), F.col("estimated_cost")).otherwise(F.col("estimated_cost") / F.col("key_count")),
    )
