"""Tiny typed inputs for unit tests (dicts -> DataFrames with the domain schemas)."""

from __future__ import annotations

from fleetlens import schemas as S


def _fill(record: dict, schema) -> dict:
    out = {}
    for f in schema.fields:
        v = record.get(f.name)
        if v is not None and hasattr(f.dataType, "fields"):
            v = _fill(v, f.dataType)
        elif v is not None and hasattr(f.dataType, "elementType") and hasattr(f.dataType.elementType, "fields"):
            v = [_fill(x, f.dataType.elementType) for x in v]
        out[f.name] = v
    return out


def df(spark, schema, records):
    return spark.createDataFrame([_fill(r, schema) for r in records], schema)


def runs(spark, records):
    return df(spark, S.RUNS, records)


def jobs(spark, records):
    for r in records:
        r.setdefault("name", f"job{r['job_id']}")
    return df(spark, S.JOBS, records)


def clusters(spark, records):
    return df(spark, S.CLUSTERS, records)


def rates(spark, pairs, currency="USD"):
    """[(node_type_id, dbu_rate_per_hour)] -> rates table (infra 0)."""
    from fleetlens.operators.pricing import static_rates

    raw = spark.createDataFrame([(n, float(r), currency) for n, r in pairs], "node_type_id string, dbu_rate_per_hour double, currency string")
    return static_rates(raw)


def config(spark, entries):
    """[(node_type_id, dbus_per_hour, plan)] -> pricing config entries."""
    return spark.createDataFrame(entries, "node_type_id string, dbus_per_hour double, plan string")
