"""Case-insensitive, multi-value tag extraction as higher-order column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag keys probed for attribution, in probe order (lower case).
PIPELINE_TAG_KEYS = (
    "pipeline",
    "pipeline_name",
    "pipeline_id",
    "dlt_pipeline",
    "dlt_pipeline_name",
)
TABLE_TAG_KEYS = (
    "table",
    "tables",
    "table_name",
    "table_names",
    "dataset",
    "datasets",
    "maintained_table",
    "maintained_tables",
    "output_table",
    "output_tables",
)
# Separators of a multi-valued tag (comma, semicolon, newline).
TAG_SEPARATOR_PATTERN = "[,;\n]"
_EDGE_SPACE = r"(?U)^\s+|\s+$"  # Unicode white space, as Python strips


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_lookup(tags: Column | str, key: str) -> Column:
    """Value of ``key`` in ``tags`` compared case-insensitively; the later entry wins.

    Works on the map entries so that keys that collide once lower-cased do not
    raise (``transform_keys`` would).
    """
    matches = F.filter(F.map_entries(_col(tags)), lambda e: F.lower(e["key"]) == F.lit(key))
    return F.try_element_at(matches, F.lit(-1))["value"]


def split_tag_value(value: Column | str) -> Column:
    """Split on , ; newline, strip surrounding whitespace, drop empty parts."""
    parts = F.split(_col(value), TAG_SEPARATOR_PATTERN)
    stripped = F.transform(parts, lambda p: F.regexp_replace(p, _EDGE_SPACE, ""))
    return F.filter(stripped, lambda p: p != F.lit(""))


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tag_values(tags: Column | str, keys: Sequence[str]) -> Column:
    """All values under the candidate keys, in key order, split and stripped.

    One pass over the map entries whatever the number of candidates: each
    entry gets its candidate position ``p`` (0 = not a candidate) and its
    map index ``i``; for keys that collide once lower-cased only the last
    entry is kept; sorting by (p, i) restores the candidate order. A missing
    map or no matching key gives an empty array (never NULL).

    Written as one SQL expression (parsed once in the JVM) when ``tags`` is
    a column name: the same plan as the DataFrame-function form, built with
    one call instead of dozens.
    """
    if isinstance(tags, str):
        cands = "array(" + ", ".join(_sql_str(k) for k in keys) + ")"
        hits = (
            f"filter(transform(map_entries(`{tags}`), (e, i) -> named_struct("
            f"'p', array_position({cands}, lower(e.key)), 'i', i, 'v', e.value)), x -> x.p > 0)"
        )
        sql = (
            "coalesce(flatten(transform("
            f"filter(transform(array_sort(filter({hits}, x -> NOT exists({hits}, y -> y.p = x.p AND y.i > x.i))), "
            "x -> x.v), v -> v IS NOT NULL AND v <> ''), "
            "v -> filter(transform(split(v, '[,;\\n]'), s -> regexp_replace(s, '(?U)^\\\\s+|\\\\s+$', '')), s -> s <> ''))), "
            "cast(array() as array<string>))"
        )
        return F.expr(sql)
    cands_c = F.array(*[F.lit(k) for k in keys])
    tagged = F.transform(
        F.map_entries(tags),
        lambda e, i: F.struct(
            F.array_position(cands_c, F.lower(e["key"])).alias("p"), i.alias("i"), e["value"].alias("v")
        ),
    )
    hits_c = F.filter(tagged, lambda x: x["p"] > 0)
    last = F.filter(hits_c, lambda x: ~F.exists(hits_c, lambda y: (y["p"] == x["p"]) & (y["i"] > x["i"])))
    present = F.filter(
        F.transform(F.array_sort(last), lambda x: x["v"]), lambda v: v.isNotNull() & (v != F.lit(""))
    )
    values = F.flatten(F.transform(present, lambda v: split_tag_value(v)))
    return F.coalesce(values, F.array().cast("array<string>"))


def merge_tag_values(first: Column | str, second: Column | str) -> Column:
    """Order-preserving distinct union: values of ``first`` then of ``second``."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(_col(first), empty), F.coalesce(_col(second), empty)))
