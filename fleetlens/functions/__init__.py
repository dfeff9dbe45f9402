"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from fleetlens.functions.columns import (
    MS_PER_DAY,
    MS_PER_HOUR,
    MONEY_TYPE,
    blank_to_null,
    from_units,
    money_sum,
    money_text,
    money_units,
    percent_text,
    py_round,
    utc_day,
    worker_count,
    workers_from,
)
from fleetlens.functions.tags import (
    PIPELINE_TAG_KEYS,
    TABLE_TAG_KEYS,
    merge_tag_values,
    split_tag_value,
    tag_lookup,
    tag_values,
)

__all__ = [
    "MS_PER_DAY",
    "MS_PER_HOUR",
    "PIPELINE_TAG_KEYS",
    "TABLE_TAG_KEYS",
    "MONEY_TYPE",
    "blank_to_null",
    "from_units",
    "money_sum",
    "money_units",
    "merge_tag_values",
    "money_text",
    "percent_text",
    "py_round",
    "split_tag_value",
    "tag_lookup",
    "tag_values",
    "utc_day",
    "worker_count",
    "workers_from",
]
