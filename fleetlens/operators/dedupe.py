"""Latest-by-key: keep one row per key, the greatest by an ordering (last write wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order_by`` tuple.

    Written as a grouped ``max_by`` so that the aggregation is partial
    (map-side): a hot key holding a large share of the rows is reduced to one
    candidate per map task before the shuffle, instead of being sorted whole
    in one task as a ``row_number()`` window would. ``order_by`` must be
    unique within a key (end it with a sequence or ordinal column) for the
    result to be deterministic.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ordering = F.struct(*[F.col(c) for c in order_by])
    packed = F.struct(*[F.col(c) for c in rest])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, ordering).alias("__latest"))
        .select(*keys, *[F.col("__latest")[c].alias(c) for c in rest])
    )
