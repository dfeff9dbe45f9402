"""Pricing: config entries -> hourly rates per node type.

All tables here are at node-type grain (bounded by the number of instance
types), so they are the broadcast side of the costing joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.dedupe import latest_by_key

# Price per usage unit (dollars per DBU) by plan.
JOBS_RATE_PREMIUM = 0.15
JOBS_RATE_OTHER = 0.20
ALL_PURPOSE_RATE_PREMIUM = 0.55
ALL_PURPOSE_RATE_OTHER = 0.65
PLANS = ("premium", "enterprise")
DEFAULT_CURRENCY = "USD"

# Entries are read as raw JSON text first and parsed one by one, so a
# non-object entry drops alone instead of nulling the whole map.
CONFIG_JSON_SCHEMA = (
    "cluster_node_types array<string>, entries map<string, string>, last_refreshed_at string"
)
ENTRY_JSON_SCHEMA = "dbus_per_hour double, plan string"


def _plan(col: str = "plan"):
    return F.lower(F.coalesce(F.col(col), F.lit("premium")))


def jobs_rate(plan, dbus):
    return dbus * F.when(plan == F.lit("premium"), F.lit(JOBS_RATE_PREMIUM)).otherwise(F.lit(JOBS_RATE_OTHER))


def all_purpose_rate(plan, dbus):
    return dbus * F.when(plan == F.lit("premium"), F.lit(ALL_PURPOSE_RATE_PREMIUM)).otherwise(F.lit(ALL_PURPOSE_RATE_OTHER))


def effective_rates(config: DataFrame, *, order_by: list[str] | None = None) -> DataFrame:
    """P1 (+P7, P8): config entries -> (node_type_id, dbu_rate_per_hour, currency,
    infrastructure_rate_per_hour, total_rate_per_hour).

    Entries with ``dbus_per_hour <= 0`` are unpriced. A plan outside the known
    set prices at the non-premium rate (as the source does). Duplicate node
    types keep the last entry by ``order_by`` when given.
    """
    if order_by:
        config = latest_by_key(config, ["node_type_id"], order_by)
    dbus = F.coalesce(F.col("dbus_per_hour"), F.lit(0.0))
    return (
        config.where(dbus > 0)
        .select(
            F.col("node_type_id"),
            jobs_rate(_plan(), dbus).alias("dbu_rate_per_hour"),
            F.lit(DEFAULT_CURRENCY).alias("currency"),
            F.lit(0.0).alias("infrastructure_rate_per_hour"),
        )
        .withColumn("total_rate_per_hour", F.col("dbu_rate_per_hour") + F.col("infrastructure_rate_per_hour"))
    )


def static_rates(rates: DataFrame) -> DataFrame:
    """Alternative pricing input: a rates table (node_type_id, dbu_rate_per_hour
    [, currency][, infrastructure_rate_per_hour]) used as is."""
    cols = set(rates.columns)
    return rates.select(
        "node_type_id",
        F.col("dbu_rate_per_hour").cast("double").alias("dbu_rate_per_hour"),
        (F.coalesce(F.col("currency"), F.lit(DEFAULT_CURRENCY)) if "currency" in cols else F.lit(DEFAULT_CURRENCY)).alias("currency"),
        (F.coalesce(F.col("infrastructure_rate_per_hour").cast("double"), F.lit(0.0)) if "infrastructure_rate_per_hour" in cols else F.lit(0.0)).alias(
            "infrastructure_rate_per_hour"
        ),
    ).withColumn("total_rate_per_hour", F.col("dbu_rate_per_hour") + F.col("infrastructure_rate_per_hour"))


def reference_rates(config: DataFrame) -> DataFrame:
    """The rate view shown per entry. A plan outside the known set is shown
    (and priced) as premium; rates are rounded to 4 decimals like the source."""
    from fleetlens.functions import py_round

    plan = _plan()
    shown = F.when(plan.isin(*PLANS), plan).otherwise(F.lit("premium"))
    dbus = F.coalesce(F.col("dbus_per_hour"), F.lit(0.0))
    return config.select(
        F.col("node_type_id"),
        dbus.alias("dbus_per_hour"),
        shown.alias("plan"),
        py_round(jobs_rate(shown, dbus), 4).alias("jobs_rate_per_hour"),
        py_round(all_purpose_rate(shown, dbus), 4).alias("all_purpose_rate_per_hour"),
    )


def config_view(discovered: DataFrame, config: DataFrame) -> DataFrame:
    """Discovered node types in their stored order (unconfigured ones show
    0 DBU, premium), then configured-but-undiscovered types sorted by id.

    ``discovered`` has (node_type_id, ordinal). Output adds ``position``
    (0-based) and ``discovered``. Node-type grain: the window is over a
    bounded table.
    """
    d = discovered.select("node_type_id", F.col("ordinal").cast("long").alias("ordinal"))
    joined = d.join(config, "node_type_id", "full_outer")
    is_disc = F.col("ordinal").isNotNull()
    ordered = joined.select(
        "node_type_id",
        F.when(is_disc, F.coalesce(F.col("dbus_per_hour"), F.lit(0.0))).otherwise(F.col("dbus_per_hour")).alias("dbus_per_hour"),
        F.col("plan"),
        is_disc.alias("discovered"),
        F.when(is_disc, F.lit(0)).otherwise(F.lit(1)).alias("_section"),
        F.col("ordinal"),
    )
    pos = F.row_number().over(Window.orderBy("_section", "ordinal", "node_type_id")) - 1
    view = reference_rates(ordered.select("node_type_id", "dbus_per_hour", "plan"))
    keyed = ordered.select("node_type_id", "discovered", "_section", "ordinal")
    return (
        view.join(keyed, "node_type_id")
        .withColumn("position", pos.cast("long"))
        .drop("_section", "ordinal")
        .orderBy("position")
    )


def normalise_config(raw: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """Trim ids (blank skipped), default 0 DBU, trim+lower plans (default
    premium); duplicates keep the last entry. Adds ``violation``: NULL when all
    entries of the node type are valid, else the first violation among them, so
    that a bad entry is not hidden by a later duplicate."""
    node = F.trim(F.col("node_type_id").cast("string"))
    plan = F.lower(F.trim(F.coalesce(F.col("plan").cast("string"), F.lit("premium"))))
    dbus = F.coalesce(F.col("dbus_per_hour").cast("double"), F.lit(0.0))
    cleaned = raw.select(
        node.alias("node_type_id"),
        dbus.alias("dbus_per_hour"),
        plan.alias("plan"),
        F.col(order_col).alias(order_col),
    ).where(F.col("node_type_id").isNotNull() & (F.col("node_type_id") != ""))
    violation = (
        F.when(F.col("dbus_per_hour") < 0, F.lit("negative_dbus"))
        .when(~F.col("plan").isin(*PLANS), F.lit("unsupported_plan"))
    )
    cleaned = cleaned.withColumn("violation", violation)
    latest = latest_by_key(cleaned.drop("violation"), ["node_type_id"], [order_col])
    bad = cleaned.groupBy("node_type_id").agg(F.min("violation").alias("violation"))
    return latest.join(bad, "node_type_id").select("node_type_id", "dbus_per_hour", "plan", "violation")


def assert_valid_config(normalised: DataFrame) -> DataFrame:
    """Raise when any normalised entry violates the rules (one-row aggregate)."""
    row = normalised.agg(F.count_if(F.col("violation").isNotNull()).alias("bad")).first()
    if row and row["bad"]:
        raise ValueError(f"pricing config has {row['bad']} invalid entries")
    return normalised.drop("violation")


def decode_config(kv: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """P5: stored JSON config -> (entries, discovered node types).

    Missing value -> no rows; entries that are not objects decode to NULL and
    are dropped; blank node types are dropped.
    """
    text = F.trim(F.col(value_col))
    checked = F.when(text.isNull() | text.startswith("{"), F.col(value_col)).otherwise(
        F.raise_error(F.lit("the stored pricing config is not a JSON object")).cast("string")
    )
    parsed = kv.select(F.from_json(checked, CONFIG_JSON_SCHEMA).alias("c"))
    entries = (
        parsed.select(F.explode(F.coalesce(F.col("c.entries"), F.create_map().cast("map<string,string>"))).alias("node_type_id", "j"))
        .where(F.trim(F.col("j")).startswith("{") & (F.trim(F.col("node_type_id")) != ""))
        .select("node_type_id", F.from_json("j", ENTRY_JSON_SCHEMA).alias("e"))
        .select("node_type_id", F.col("e.dbus_per_hour").alias("dbus_per_hour"), F.col("e.plan").alias("plan"))
    )
    discovered = (
        parsed.select(F.posexplode(F.coalesce(F.col("c.cluster_node_types"), F.array().cast("array<string>"))).alias("ordinal", "node_type_id"))
        .where(F.col("node_type_id").isNotNull() & (F.trim(F.col("node_type_id")) != ""))
    )
    return entries, discovered


def config_counts(discovered: DataFrame, config: DataFrame) -> DataFrame:
    """Number of discovered types and of configured (dbus > 0) entries."""
    n_conf = config.agg(F.count_if(F.col("dbus_per_hour") > 0).alias("configured_count"))
    return discovered.agg(F.count("*").alias("discovered_count")).select(
        "discovered_count", n_conf.scalar().alias("configured_count")
    )


CONFIG_KEY = "cluster_pricing_config"


def encode_config(entries: DataFrame, discovered: DataFrame | None, refreshed_at: str | None) -> DataFrame:
    """Persisted shape of the pricing config as one (key, value) row: the
    discovered node types (sorted), the entries map and the refresh time.
    Both inputs are node-type grain, so the single JSON document is bounded."""
    ent = entries.agg(
        F.map_from_entries(
            F.collect_list(F.struct("node_type_id", F.struct("dbus_per_hour", "plan")))
        ).alias("entries")
    )
    if discovered is None:
        types = ent.select(F.array().cast("array<string>").alias("cluster_node_types"))
    else:
        types = discovered.agg(F.sort_array(F.collect_list("node_type_id")).alias("cluster_node_types"))
    doc = F.struct(
        F.col("cluster_node_types"),
        ent.scalar().alias("entries"),
        F.lit(refreshed_at).cast("string").alias("last_refreshed_at"),
    )
    return types.select(F.lit(CONFIG_KEY).alias("key"), F.to_json(doc).alias("value"))


def refresh_discovered(kv: DataFrame, node_types: DataFrame, refreshed_at: str) -> DataFrame:
    """Replace the discovered node types with ``node_types`` (I12 output,
    column ``node_type``), stamp the refresh time, keep the entries (entries
    that do not decode are dropped, as on every read of the stored config)."""
    entries, _ = decode_config(kv)
    return encode_config(entries, node_types.select(F.col("node_type").alias("node_type_id")), refreshed_at)
