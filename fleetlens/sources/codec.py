"""Typed rows to JSON documents and back, without loss.

Struct fields that are NULL are left out of a document and read back as NULL; NULL,
empty and present maps and arrays, NULL elements and map values, structs of NULLs, NaN,
infinities, decimals, microseconds and binary all come back as they were. The schema is
given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
    "timeZone": "UTC",
}


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON document per row, column ``value``."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _OPTIONS).alias("value"))


def from_documents(documents: DataFrame, schema: StructType) -> DataFrame:
    """Rows of ``schema`` from documents; a document that does not parse raises."""
    parsed = documents.select(F.inline(F.array(F.from_json("value", schema, _OPTIONS | {"mode": "FAILFAST"}))))
    return parsed


def drop_incomplete_job_clusters(jobs: DataFrame) -> DataFrame:
    """Jobs without the job clusters that have no key or no spec, as on every import."""
    whole = F.filter("job_clusters", lambda c: c["job_cluster_key"].isNotNull() & c["new_cluster"].isNotNull())
    return jobs.withColumn("job_clusters", whole)


def export_json(df: DataFrame, path: str) -> None:
    """Write the documents of ``df`` as text lines."""
    to_documents(df).write.mode("errorifexists").text(path)


def import_json(spark, path: str, schema: StructType) -> DataFrame:
    """Read exported lines; incomplete job clusters are dropped."""
    df = from_documents(spark.read.text(path), schema)
    return drop_incomplete_job_clusters(df) if "job_clusters" in df.columns else df


def _comparable(c: Column, kind: DataType) -> Column:
    """``c`` without maps, which set operations refuse: a map becomes its sorted
    entries."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _comparable(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_comparable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables of one schema holds, counted with repeats:
    one row (only_left, only_right)."""
    plain = [df.select(*[_comparable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]) for df in (a, b)]
    left, right = plain[0].exceptAll(plain[1]), plain[1].exceptAll(plain[0])
    return left.agg(F.count("*").alias("only_left")).select("only_left", right.agg(F.count("*")).scalar().alias("only_right"))
