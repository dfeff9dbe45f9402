"""Property tests: column helpers vs plain-Python references on random inputs.

Each property draws a whole batch of examples and checks them in one Spark
job (one DataFrame), so the suite stays fast."""

import math
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import PIPELINE_TAG_KEYS, TABLE_TAG_KEYS, merge_tag_values, money_sum, py_round, tag_values
from fleetlens.operators.dedupe import latest_by_key

KEY_POOL = ["table", "Tables", "TABLE_NAME", "dataset", "Pipeline", "pipeline_id", "owner", "team", "TABLES"]
VALUE_CHARS = "ab.,; \n\t"


def py_tag_values(tags, keys):
    """Reference rule: lower-case keys (later wins), probe in order, split on , ; newline, strip, drop empties."""
    if not tags:
        return []
    normal = {}
    for k, v in tags:
        normal[k.lower()] = v
    out = []
    for key in keys:
        raw = normal.get(key)
        if not raw:
            continue
        parts = [raw]
        for sep in (",", ";", "\n"):
            parts = [p for item in parts for p in item.split(sep)]
        out.extend(p.strip() for p in parts if p.strip())
    return out


def py_unique(values):
    seen, out = set(), []
    for v in values:
        if v not in seen:
            seen.add(v)
            out.append(v)
    return out


tag_lists = st.lists(
    st.lists(st.tuples(st.sampled_from(KEY_POOL), st.text(alphabet=VALUE_CHARS, max_size=12)), max_size=6),
    min_size=1, max_size=40,
)


@settings(max_examples=5, deadline=None)
@given(batch=tag_lists)
def test_tag_values_match_reference(spark, batch):
    # exact duplicate keys keep their last value (a dict); the entry ORDER must
    # survive into the map (map_from_arrays keeps it; a Python dict passed to
    # createDataFrame does not), because it decides which case variant wins
    rows = [(i, list({k: v for k, v in t}.keys()), list({k: v for k, v in t}.values())) for i, t in enumerate(batch)]
    df = spark.createDataFrame(rows, "i int, ks array<string>, vs array<string>").select(
        "i", F.map_from_arrays("ks", "vs").alias("tags")
    )
    got = {
        r.i: (r.p, r.t, r.m)
        for r in df.select(
            "i",
            tag_values("tags", PIPELINE_TAG_KEYS).alias("p"),
            tag_values("tags", TABLE_TAG_KEYS).alias("t"),
            merge_tag_values(tag_values("tags", TABLE_TAG_KEYS), tag_values("tags", PIPELINE_TAG_KEYS)).alias("m"),
        ).collect()
    }
    for i, t in enumerate(batch):
        d = list({k: v for k, v in t}.items())
        p, tb = py_tag_values(d, PIPELINE_TAG_KEYS), py_tag_values(d, TABLE_TAG_KEYS)
        assert got[i] == (p, tb, py_unique(tb + p))


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_py_round_matches_python(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.randint(0, 10**8) / 10 ** rnd.randint(0, 9) for _ in range(3000)]
    vals += [rnd.random() * 10 ** rnd.randint(-7, 7) for _ in range(3000)]
    vals += [5 * 10.0 ** -k for k in range(1, 9)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", py_round("x", 2).alias("a"), py_round("x", 4).alias("b")).collect():
        assert r.a == round(r.x, 2) and r.b == round(r.x, 4), r.x


@settings(max_examples=5, deadline=None)
@given(amounts=st.lists(st.integers(0, 10**9), min_size=1, max_size=300), parts=st.integers(1, 16))
def test_money_sum_is_exact_and_order_free(spark, amounts, parts):
    vals = [a / 240000.0 for a in amounts]  # rational costs like the fixture's
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(parts).agg(money_sum("x").alias("s")).first().s
    b = df.coalesce(1).agg(money_sum("x").alias("s")).first().s
    # the true sum of the amounts, to 18 decimal places each
    assert a == b and abs(a - math.fsum(vals)) <= 1e-12 * max(math.fsum(vals), 1.0)


def test_small_costs_and_any_currency_survive(spark):
    """Many costs far below a cent add up, a three-way split adds up to the whole,
    and the report currency may be any text."""
    from fleetlens.operators import summaries as S
    from fleetlens.functions import utc_day

    small = spark.range(100_000).selectExpr("4e-7D AS x")
    assert abs(small.agg(money_sum("x").alias("s")).first().s - 0.04) < 1e-12
    thirds = spark.range(3_000).selectExpr("1.0D / 3 AS x")
    assert round(thirds.agg(money_sum("x").alias("s")).first().s, 9) == 1000.0
    costed = spark.createDataFrame([(1, 10, 1.0, "a currency of 30 characters .."), (2, 5, 2.0, "")], "job_id long, start_time long, estimated_cost double, currency string")
    assert S.total_cost(costed).first()["currency"] == "a currency of 30 characters .."
    assert S.total_cost(costed.filter("job_id = 2")).first()["currency"] == ""
    for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        days = spark.sql("SELECT * FROM VALUES (0L), (-1L), (86400000L) AS t(ms)").select(utc_day("ms").alias("d")).collect()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.d for r in days] == ["1970-01-01", "1969-12-31", "1970-01-02"]


def test_day_without_rows_is_a_volume_drop(spark):
    from fleetlens.operators.freshness import daily_volume, volume_anomalies

    rows = [("t", f"2024-01-{d:02d}", 100) for d in range(1, 11) if d != 9]
    log = spark.createDataFrame(rows, "table_name string, d string, row_count long").selectExpr("table_name", "CAST(d AS timestamp) AS updated_at", "row_count")
    assert [str(r.day) for r in volume_anomalies(daily_volume(log)).collect()] == ["2024-01-09"]


def test_bad_pricing_entries_are_not_hidden(spark):
    from fleetlens.operators.pricing import decode_config, normalise_config

    raw = spark.createDataFrame([("n", -1.0, "premium", 1), ("n", 2.0, "premium", 2)], "node_type_id string, dbus_per_hour double, plan string, ordinal long")
    assert [r.violation for r in normalise_config(raw).collect()] == ["negative_dbus"]
    with pytest.raises(Exception, match="not a JSON object"):
        decode_config(spark.createDataFrame([("[1]",)], "value string"))[0].collect()


def test_no_private_folder_off_a_local_master():
    from fleetlens import session

    class Context:
        master = "spark://host:7077"
        applicationId = "a"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 8), st.integers(0, 10**6), st.text(max_size=3)), min_size=1, max_size=200,
                     unique_by=lambda r: (r[0], r[1])))
def test_latest_by_key_matches_dict(spark, rows):
    df = spark.createDataFrame(rows, "k int, seq long, v string").repartition(4)
    got = {r.k: (r.seq, r.v) for r in latest_by_key(df, ["k"], ["seq"]).collect()}
    want = {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        want[k] = (seq, v)
    assert got == want
