"""Shards cut from a Hilbert curve over metadata.

Several columns are quantised to ``2 ** BITS`` steps each, which makes every row a
cell of a cube; rows are sorted by the cell's place on the Hilbert curve (ties by
the columns, then the text's checksum) and the order is cut into runs. Neighbours
on the curve are neighbours in the cube, so a run, and the files written from it,
spans a small box, and a filter on any of the columns skips most shards.

Text columns are quantised by rank: a value's code is the share of rows with a
smaller value, so a source holding a third of all rows has one code and the others
share the rest. Integer columns are quantised by equal steps between least and
greatest value. NULLs come first.

The order is made by one range exchange of narrow rows (ids, codes, sizes; no
text) whose last key is a row number of the scan, so no group of equal rows, however
large, has to fit one task; places in the order are partition offsets plus
positions, both from a written table. SQL functions only.

Laws: ``rows`` cuts runs whose row counts differ by one at most; ``bytes`` cuts where
the running size passes a shard's share (sizes differ by one document at most).
The query uses ``rows``, which holds at every size, over language, source and
doc_id; text length is left out there, so that equal counts are about equal bytes.

Edge cases: NULL text has size 1 (no bytes, plus 1) and the checksum of the empty
text; NULLs and repeated ids are rows like others; with fewer rows than shards some
shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import materialize, shuffle_partitions

SHARDS = 16
#: Bits a column is quantised to.
BITS = 5
DIMENSIONS = ("lang", "source", "doc_id")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def places(rows: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before``, how many rows come before each in the given order,
    and ``before_weight``, the sum of their ``weight`` if one is named. ``order`` must
    tell all rows apart.

    Rows are range-partitioned and sorted once; a row's position in its partition is
    the low part of the id Spark numbers it by, the partition the high part."""
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "places")
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(weight or F.lit(0)).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(c) for c in ("_n", "_w")])
    if weight is not None:
        inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    placed = dealt.join(F.broadcast(parts), "_part").withColumn("before", F.col("_n") + F.col("_pos"))
    if weight is not None:
        placed = placed.withColumn("before_weight", F.col("_w") + F.col("_inside")).drop("_inside")
    return placed.drop("_part", "_pos", "_n", "_w")


def _rank_code(rows: DataFrame, column: str, n_rows: int, bits: int) -> Column:
    """Code of a text column: the share of rows with a smaller value, in steps. The
    driver gets the least value of each code, ``2 ** bits`` at most."""
    values = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    code = F.expr(f"cast(before_weight * {1 << bits} div {n_rows} as int)").alias("code")
    least = places(values, ["v"], "n").filter(F.col("v").isNotNull()).groupBy(code).agg(F.min("v").alias("v")).collect()
    out = F.when(F.lit(False), F.lit(0))
    for r in sorted(least, key=lambda r: -r["code"]):
        out = out.when(F.col(column) >= r["v"], F.lit(r["code"]))
    return out.otherwise(F.lit(0))


def _equal_code(rows: DataFrame, column: str, bits: int) -> Column:
    """Code of an integer column: equal steps between its least and greatest value,
    in halves, so that no difference passes 64 bits."""
    half = F.shiftright(F.col(column).cast("long"), 1)
    low, high = rows.agg(F.min(half), F.max(half)).first()
    if low is None:
        return F.lit(0)
    return F.coalesce(F.call_function("div", half - F.lit(low), F.lit((high - low >> bits) + 1)).cast("int"), F.lit(0))


def codes_of(rows: DataFrame, dimensions: tuple[str, ...], n_rows: int, bits: int = BITS) -> list[Column]:
    """A code column in 0 .. ``2 ** bits`` - 1 for each dimension (NULL: 0)."""
    out = []
    for name in dimensions:
        kind = rows.schema[name].dataType
        if isinstance(kind, StringType):
            out.append(_rank_code(rows, name, n_rows, bits))
        elif isinstance(kind, IntegralType):
            out.append(_equal_code(rows, name, bits))
        else:
            raise TypeError(f"{name}: text or integer columns only, not {kind.simpleString()}")
    return out


def _rotations(n: int) -> tuple[list[int], list[int], list[int]]:
    """For words of ``n`` bits: the rank of each word in the Gray code, and the entry
    corner and direction of the sub-cube at each rank of the Hilbert curve."""
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(w) for w in range(1 << n)]
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  ones at the low end
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, 1 << n)]
    direction = [0] + [trailing(i if i % 2 else i - 1) % n for i in range(1, 1 << n)]
    return rank, entry, direction


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve through a cube of ``2 ** bits`` cells a
    side: a fold over the bits, from the highest, that keeps the sub-cube's entry
    corner and direction."""
    n = len(codes)
    mask = (1 << n) - 1
    rank, entry, direction = (F.array(*[F.lit(x) for x in t]) for t in _rotations(n))
    words = F.array(*[_bits_at(codes, b) for b in range(bits - 1, -1, -1)])

    def turn_right(x: Column, by: Column) -> Column:
        return F.call_function("shiftright", x, by).bitwiseOR(F.call_function("shiftleft", x, F.lit(n) - by)).bitwiseAND(F.lit(mask))

    def turn_left(x: Column, by: Column) -> Column:
        return turn_right(x, F.lit(n) - by)

    def step(state: Column, word: Column) -> Column:
        by = (state["d"] + 1) % n
        at = F.get(rank, turn_right(word.bitwiseXOR(state["e"]), by))
        e = state["e"].bitwiseXOR(turn_left(F.get(entry, at), by))
        d = (state["d"] + F.get(direction, at) + 1) % n
        return F.struct(e.alias("e"), d.alias("d"), (state["h"] * (1 << n) + at).alias("h"))

    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(words, zero, step, lambda state: state["h"])


def _bits_at(codes: list[Column], b: int) -> Column:
    word = F.lit(0)
    for i, code in enumerate(codes):
        word = word + F.shiftright(code, b).bitwiseAND(F.lit(1)) * (1 << i)
    return word


def hilbert_shards(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, ties: tuple[str, ...] = (), n_shards: int = SHARDS, law: str = "rows", size: str = "size", bits: int = BITS) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0), ``slot`` (its place in the shard, from
    0) and ``h`` (place on the curve). ``size`` names the column the law ``bytes``
    balances; rows of one cell are ordered by the dimensions, then ``ties``."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be 'rows' or 'bytes', not {law!r}")
    n_rows, total = rows.agg(F.count("*"), F.sum(size)).first()
    h = hilbert_index(codes_of(rows, dimensions, max(n_rows, 1), bits), bits)
    order = ["h", *dimensions, *ties, "_row"]
    cells = rows.withColumns({"h": h, "_row": F.monotonically_increasing_id()})
    if law == "rows":
        placed = places(cells, order).withColumn("shard", F.expr(f"cast(before * {n_shards} div {max(n_rows, 1)} as int)"))
        first = F.expr(f"(shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
        return placed.withColumn("slot", F.col("before") - first).drop("before", "_row")
    # a document belongs to the share that holds the middle of its bytes
    placed = places(cells, order, size).withColumn("shard", F.expr(f"cast((2 * before_weight + {size}) * {n_shards} div {2 * max(total or 1, 1)}L as int)"))
    firsts = placed.groupBy("shard").agg(F.min("before").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("before") - F.col("_first")).drop("before", "before_weight", "_first", "_row")


def documents_sharded(docs: DataFrame, n_shards: int = SHARDS, law: str = "rows", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and
    grown_shard (NULL: neither law keeps rows in place when a shard is added)."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    narrow = docs.select("doc_id", *[c for c in dimensions if c != "doc_id"], size_of(F.col("text")).alias("size"), crc.alias("text_crc32"))
    out = hilbert_shards(materialize(narrow, "narrow"), dimensions, ("text_crc32", "size"), n_shards, law)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, n_shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """Write whole documents below ``path/data``, a folder per shard whose files hold
    runs of slots, and ``path/manifest``: per shard its rows, bytes and the range of
    each dimension (and whether it has NULLs). Returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c).alias(f"_dim{i}") for i, c in enumerate(dimensions)], size_of(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_doc"))
    names = tuple(f"_dim{i}" for i in range(len(dimensions)))
    placed = hilbert_shards(rows, names, ("size",), n_shards, law)
    dealt = placed.repartitionByRange(max(shuffle_partitions(spark), n_shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "size", *names, "_doc").write.partitionBy("shard").parquet(f"{path}/data")
    ranges = [f(n).alias(f"{k}_{c}") for n, c in zip(names, dimensions, strict=True) for k, f in (("min", F.min), ("max", F.max))]
    nulls = [F.bool_or(F.col(n).isNull()).alias(f"null_{c}") for n, c in zip(names, dimensions, strict=True)]
    manifest = spark.read.parquet(f"{path}/data").groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges, *nulls)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, **ranges: tuple) -> DataFrame:
    """The documents whose dimensions lie in all given ranges (both ends included),
    e.g. ``lang=("de", "de")``, in the columns they were written with. Only shards
    whose manifest ranges meet them are read (a partition filter)."""
    wanted = spark.read.parquet(f"{path}/manifest")
    for name, (low, high) in ranges.items():
        wanted = wanted.filter((F.col(f"max_{name}") >= F.lit(low)) & (F.col(f"min_{name}") <= F.lit(high)))
    shards = [r["shard"] for r in wanted.select("shard").collect()]  # n_shards rows at most
    rows = spark.read.parquet(f"{path}/data").filter(F.col("shard").isin(shards)).select("_doc.*")
    for name, (low, high) in ranges.items():
        rows = rows.filter(F.col(name).between(low, high))
    return rows


def op13_sql(n_shards: int = SHARDS, bits: int = BITS) -> str:
    """DuckDB SQL for ``documents_sharded`` with its defaults: codes by window
    counts, the curve level by level, plain row numbers; crc32 by its byte table."""
    rank, entry, direction = _rotations(3)
    n, mask, steps = 3, 7, 1 << bits

    def turn(x: str, by: str) -> str:
        return f"(((({x}) >> ({by})) | (({x}) << ({n} - ({by})))) & {mask})"

    levels, last = [], "coded"
    for b in range(bits - 1, -1, -1):
        word = " + ".join(f"((q{i} >> {b}) & 1) * {1 << i}" for i in range(n))
        levels.append(
            f"a{b} AS (SELECT *, ({rank}::BIGINT[])[{turn(f'xor({word}, e)', '(d + 1) % 3')} + 1] AS w FROM {last}),\n"
            f"l{b} AS (SELECT * REPLACE (xor(e, {turn(f'({entry}::BIGINT[])[w + 1]', '3 - (d + 1) % 3')}) AS e, (d + ({direction}::BIGINT[])[w + 1] + 1) % 3 AS d, h * 8 + w AS h) FROM a{b})"
        )
        last = f"(SELECT * EXCLUDE w FROM l{b})"
    levels_sql = ",\n".join(levels)
    return rf"""
WITH bytes AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::BIGINT] || [0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(coalesce(text, '')))),
           lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), (2 * i + 1)::BIGINT, 2))::BIGINT),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, bytes),
coded AS (
  SELECT *, ((rank() OVER (ORDER BY lang NULLS FIRST) - 1) * {steps}) // count(*) OVER () * (lang IS NOT NULL)::BIGINT AS q0,
         ((rank() OVER (ORDER BY source NULLS FIRST) - 1) * {steps}) // count(*) OVER () * (source IS NOT NULL)::BIGINT AS q1,
         coalesce(((doc_id >> 1) - (min(doc_id >> 1) OVER ())) // (((max(doc_id >> 1) OVER ()) - (min(doc_id >> 1) OVER ())) // {steps} + 1), 0) AS q2,
         0::BIGINT AS e, 0::BIGINT AS d, 0::BIGINT AS h
  FROM d),
{levels_sql},
placed AS (
  SELECT *, row_number() OVER (ORDER BY h, lang NULLS FIRST, source NULLS FIRST, doc_id NULLS FIRST, crc, size) - 1 AS before, count(*) OVER () AS n
  FROM l0)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, ((before * {n_shards}) // n)::INTEGER AS shard,
       (before - ((before * {n_shards}) // n * n + {n_shards - 1}) // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
