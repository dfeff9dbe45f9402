"""Mixing sources to target weights by Pareto order sampling.

Sources get weights and share the total size; a target stops at ``max_copies``
times its source's size and the excess is reshared. Within a source every
document gets the certain whole copies floor(target / size); for the remaining
fraction f of the source, documents are ranked by their random odds divided by
their inclusion odds and taken in that order until the remaining size is
reached. The document at the boundary is cut there, so the sample has a fixed
size, measured in words.

Random numbers are a hash of the id, so reruns agree, and independent of how
rows are partitioned. The running sums within a source are computed in two
levels (totals of about sqrt(n) rank ranges, then rows within one range), so a
source holding a third of all rows is spread over many tasks.

Edge cases: NULL text has size 0 and is never taken; a NULL source is a source
of its own, last in order; NULL ids hash like the empty text; rows with equal
ids are ranked side by side; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words_of

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def random_unit(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) from 52 bits of the key's md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target) from rows of (source, size).

    Filling up proportionally to the weights with caps is settled by one sorted
    pass: sources in order of cap / weight reach their cap as long as the level
    shared by all later ones is not below theirs."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = s.withColumns({"w": w.cast("long"), "cap": F.col("source_size") * max_copies})
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "ratio": F.col("cap") / F.col("w")})
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumns({"level": level, "full": F.col("ratio") <= level})
    open_level = F.min(F.when(~F.col("full"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * open_level)
    return s.select("source", "n_docs", "source_size", target.alias("target"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "", weight_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` has doc_id, source and size (long, not NULL); one row per
    document: doc_id, source, size, source_size, target, ``taken`` (words) and
    ``copies`` (whole copies).

    ``weight_col`` names positive relative inclusion odds within a source
    (default: equal, so inclusion differs between sources only); ``keep`` names
    columns to carry along."""
    relative = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    base = materialize(docs.select("doc_id", "source", "size", relative.alias("g"), *keep), "mix")
    targets = source_targets(base, weights, max_copies)
    u = random_unit(F.col("doc_id"), seed)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    d = base.withColumnRenamed("source", "src").join(targets, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    # odds of the random number over relative odds: within a source the order
    # of odds(u) / odds(inclusion), as the source's own odds f / (1 - f) are shared
    d = d.withColumns({"whole": whole, "odds": u / (1 - u) / F.col("g")})
    d = d.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ranges = F.ceil(F.sqrt("n_docs"))
    d = d.withColumn("range", F.floor(F.col("odds") / (1 + F.col("odds")) * ranges).cast("long"))
    totals = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("src"), F.col("range").alias("rng"), F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("range_before"))
    d = d.join(totals, F.col("source").eqNullSafe(F.col("src")) & (F.col("range") == F.col("rng"))).drop("src", "rng")
    within = Window.partitionBy("source", "range").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("range_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.least(F.greatest(F.floor(room + 0.5), F.lit(0)), F.col("size")).cast("long")
    return d.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).alias("taken"),
        F.col("whole").alias("copies"),
        *keep,
    )


def op3_mixing(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    return pareto_mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Pipeline form: the documents of the mix in the columns of ``docs``, a row
    for each time one is taken. The document at a source's boundary has its last
    time cut after the words that are taken (``n_chars`` follows).

    Decisions are made on narrow rows; texts are shuffled once, by a hash of the
    row. Rows that are equal in all columns share their decisions."""
    columns = docs.columns
    # maps cannot be hashed; their text can
    key = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])
    narrow = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), key.alias("_key"))
    mixed = pareto_mix(narrow, keep=("_key",)).filter("taken > 0")
    mixed = mixed.groupBy("_key").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"))
    rows = docs.select(key.alias("_key"), F.struct(*columns).alias("_row")).groupBy("_key").agg(F.first("_row").alias("_row"))
    rows = rows.join(mixed, "_key")
    whole, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.array_repeat(part, (part > 0).cast("int")))
    out = rows.select("_row", F.explode(times).alias("_words"))
    space = r"[\x20\x09-\x0D]"
    pieces = F.split(F.col("_row.text"), f"(?<={space})(?={WORD})")  # words with the white space after them
    leading = F.col("_row.text").rlike(f"^{space}").cast("int")
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("_words") + leading), ""), f"{space}+$", "")
    out = out.withColumn("_text", F.when(F.col("_words") > 0, cut).otherwise(F.col("_row.text")))
    fields = {c: F.col("_row").getField(c).alias(c) for c in columns}
    fields["text"] = F.col("_text").alias("text")
    if "n_chars" in columns:
        fields["n_chars"] = F.when(F.col("_words") > 0, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[fields[c] for c in columns])


#: DuckDB SQL for ``op3_mixing``: the same rule with plain running sums.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT)::DOUBLE
            / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN cap::DOUBLE
              ELSE w * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) END AS target
  FROM l),
u AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u), doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM u)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(floor(target - whole * source_size - before + 0.5), 0), size))::BIGINT AS taken
FROM c
"""
