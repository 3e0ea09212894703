"""The paths meant for large tables, forced on small ones and compared with brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import charts, outliers, repair
from plumbline.plans import lookup, ordering
from plumbline.plans.quantiles import exact_quantiles, group_quantiles
from plumbline.sources.tables import hash_sample, row_cap


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows, a third of them under one key, long gaps in the value."""
    rng = np.random.default_rng(7)
    n = 4_000
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "key": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
            "at": rng.integers(0, 900, n),
            "value": np.where(rng.random(n) < 0.05, rng.normal(size=n).round(3), np.nan),
        }
    )
    frame.loc[frame["at"].between(200, 600), "value"] = np.nan
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return spark.createDataFrame(rows, "id bigint, key bigint, at bigint, value double").repartition(6), frame


def _filled(df):
    return dict(df.select("id", "value").collect())


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("buckets", [None, 7, 64])
def test_fill_matches_brute_force(hot, keys, backward, buckets):
    df, frame = hot
    ordered = frame.sort_values(["at", "id"])
    column = ordered.groupby("key")["value"] if keys else ordered["value"]
    want = dict(zip(ordered["id"], column.bfill() if backward else column.ffill()))
    fill = repair.backward_fill if backward else repair.forward_fill
    got = _filled(fill(df, "value", ["at", "id"], keys, buckets))
    assert len(got) == len(want)
    for key, value in want.items():
        assert got[key] is None if np.isnan(value) else got[key] == value


def test_fill_with_null_keys_and_null_order(spark):
    rows = [(1, None, None, 5.0), (2, None, 1, None), (3, "a", 2, None), (4, "a", None, 7.0), (5, None, 3, None)]
    df = spark.createDataFrame(rows, "id int, key string, at int, value double")
    got = _filled(repair.forward_fill(df, "value", ["at", "id"], ["key"], buckets=3))
    assert got == {1: 5.0, 2: 5.0, 3: 7.0, 4: 7.0, 5: 5.0}


def test_hot_key_is_spread_over_buckets(hot):
    df, _ = hot
    rows = ordering.with_bucket(df, ["at", "id"], 16)
    sizes = [r["count"] for r in rows.where("key = 0").groupBy(ordering.BUCKET).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400


def test_buckets_follow_the_order(hot):
    df, _ = hot
    rows = ordering.with_bucket(df, ["at", "id"], 16).orderBy("at", "id").select(ordering.BUCKET).collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


@pytest.mark.parametrize("buckets", [None, 9])
def test_running_totals(hot, buckets):
    df, frame = hot
    got = dict(ordering.running_totals(df, ["at", "id"], {"upto": F.col("key")}, buckets).select("id", "upto").collect())
    ordered = frame.sort_values(["at", "id"])
    assert got == dict(zip(ordered["id"], ordered["key"].cumsum()))


@pytest.mark.parametrize("span, sample", [(50_000, 4_000), (100, 50), (1, 4), (0, 1)])
def test_first_rows(hot, monkeypatch, span, sample):
    monkeypatch.setattr(ordering, "SPAN_ROWS", span)
    monkeypatch.setattr(ordering, "SPAN_SAMPLE", sample)
    df, frame = hot
    for n in (1, 777):
        got = [r["id"] for r in ordering.first_rows(df, ["at", "id"], n).collect()]
        assert sorted(got) == sorted(frame.sort_values(["at", "id"])["id"].head(n))


def test_first_rows_of_one_hot_value(spark):
    df = spark.range(500).select("id", F.lit(1).alias("at"))
    got = ordering.first_rows(df, ["at"], 60)
    assert got.count() == 60 and got.select("id").distinct().count() == 60


@pytest.mark.parametrize("span", [50_000, 2])
def test_first_rows_of_every_type_with_nulls_and_copies(spark, monkeypatch, span):
    monkeypatch.setattr(ordering, "SPAN_ROWS", span)
    monkeypatch.setattr(ordering, "SPAN_SAMPLE", 9)
    df = spark.range(300).repartition(2).selectExpr(
        "CASE WHEN id % 5 > 0 THEN id % 7 / 3D END AS x", "CASE WHEN id % 9 = 0 THEN double('NaN') ELSE id % 4 END AS y",
        "concat('k', id % 11) AS s", "date_add(date'2024-01-01', int(id % 3)) AS d", "timestamp_ntz'2024-01-01 00:00:00' AS t",
        "cast(id % 2 AS decimal(9,2)) AS c", "id % 2 = 0 AS b", "map('a', 1) AS m", "array(id % 2) AS a",
    )
    both = df.unionByName(df).cache()  # every row twice
    for order in (["x", "y", "s"], ["s", "d"], ["d", "t", "b", "c"]):
        for n in (59, 121, 599):
            got = ordering.first_rows(both, order, n).select(*order).collect()
            expected = both.orderBy(*(F.asc_nulls_first(c) for c in order)).limit(n).select(*order).collect()
            assert sorted(map(str, got)) == sorted(map(str, expected)), (order, n)


def test_row_cap_reaches_the_scan(spark, folder):
    table = spark.read.parquet(f"{folder}/lineitem.parquet")
    capped = row_cap(table, 1000, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey")
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan and "EqualTo(l_orderkey" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert capped.count() == 1000


def test_row_cap_without_an_order_does_not_depend_on_partitions(spark, folder):
    table = spark.read.parquet(f"{folder}/orders.parquet")
    first, second = (row_cap(t, 50).select("o_orderkey").collect() for t in (table, table.repartition(5)))
    assert sorted(first) == sorted(second) and len(first) == 50


def test_first_rows_of_few_and_no_rows(spark):
    df = spark.range(30)
    assert ordering.first_rows(df, ["id"], 100).count() == 30
    assert ordering.first_rows(df.where("id < 0"), ["id"], 5).count() == 0


def test_plan_does_not_grow_with_buckets(hot):
    df, _ = hot
    sizes = [
        len(ordering.with_bucket(df, ["at", "id"], n).where(F.col(ordering.BUCKET) < 3)._jdf.queryExecution().executedPlan().toString())
        for n in (16, 800)
    ]
    assert sizes[1] < 60 * sizes[0] and sizes[1] < 200_000


def test_row_cap_keeps_all_for_zero_or_none(spark):
    df = spark.range(20)
    assert row_cap(df, 0).count() == row_cap(df, None).count() == 20
    assert row_cap(df, 7).count() == 7


PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


@settings(max_examples=8, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.5, 1e300, -1e300])), min_size=1, max_size=300),
    st.sampled_from([12, 50, 10_000]),
)
def test_quantiles_match_numpy(spark, values, small_rows):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, ["x"], PROBS, small_rows=small_rows, sample_rows=120)["x"]
    assert np.allclose(got, np.quantile(np.array(values), PROBS), rtol=1e-9, atol=1e-9)


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(30_000) < 0.34, 5.0, rng.lognormal(1, 2, 30_000))
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": -values})).repartition(5)
    got = exact_quantiles(df, ["x", "y"], PROBS, small_rows=100, sample_rows=5_000)
    assert np.allclose(got["x"], np.quantile(values, PROBS))
    assert np.allclose(got["y"], np.quantile(-values, PROBS))


def test_quantiles_ignore_null_and_nan_and_survive_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": None}


def test_group_quantiles(hot):
    df, frame = hot
    got = group_quantiles(df, "key", "at", [0.25, 0.5], small_rows=20, sample_rows=500)
    for key, rows in frame.groupby("key"):
        assert np.allclose(got[key], np.quantile(rows["at"], [0.25, 0.5]))


def test_attach_gives_the_rows_of_a_plain_join(spark, monkeypatch):
    hot = F.when(F.rand(2) < 0.34, F.lit(7)).when(F.rand(3) < 0.3, None).otherwise(F.col("id") % 80)
    df = spark.range(4_000).select("id", hot.alias("key")).cache()
    table = spark.range(60).select(F.col("id").alias(lookup.VALUE), (F.col("id") * 2).alias("twice"))
    small = df.join(table, df["key"] == F.col(lookup.VALUE), "left").drop(lookup.VALUE)
    monkeypatch.setattr(lookup, "HOT_VALUES", 4)
    large = lookup.attach(df, "key", table, "twice", F.abs(F.col(lookup.VALUE) - 7).asc())
    assert small.columns == large.columns == ["id", "key", "twice"]
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.count() == 4_000 and large.where("twice IS NULL AND key IS NULL").count() > 0
    assert large.where("twice IS NULL AND key < 60").count() == 0


def test_salted_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_VALUES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.range(8_000).select("id", F.when(F.col("id") % 2 == 0, 1).alias("key"))
        table = spark.range(5).select(F.col("id").alias(lookup.VALUE), F.col("id").alias("x"))
        done = lookup.attach(df, "key", table, "x", F.abs(F.col(lookup.VALUE) - 1).asc())
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2_000


def test_results_do_not_depend_on_partitioning(spark, hot):
    df, _ = hot
    one, many = df.repartition(1), df.repartition(11, "at")
    for run in (
        lambda t: hash_sample(t, ["id"], 0.2),
        lambda t: outliers.detect(t, "at", "percentile"),
        lambda t: charts.histogram(t, "value"),
    ):
        assert sorted(map(str, run(one).collect())) == sorted(map(str, run(many).collect()))


def test_quantile_bounds_reach_the_scan(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    found = outliers.detect(lineitem, "l_extendedprice", "percentile").select("l_orderkey", "l_extendedprice")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "LessThan(l_extendedprice" in pushed and "GreaterThan(l_extendedprice" in pushed
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_global_fill_is_no_single_partition_window(hot):
    df, _ = hot
    plan = repair.forward_fill(df, "value", ["at", "id"], buckets=16)._jdf.queryExecution().executedPlan().toString()
    # The wide rows are hashed by bucket; only the one-row-per-bucket window may gather.
    windows = [x for x in plan.splitlines() if "Exchange SinglePartition" in x]
    assert len(windows) <= 1 and "hashpartitioning(__bucket" in plan


def test_binned_density_curve_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 3_000), rng.normal(6, 0.5, 2_000)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    curve = charts.kde(df, "v").orderBy("grid_point").toPandas()
    width = values.std(ddof=1) * len(values) ** -0.2
    z = (curve["x"].to_numpy()[:, None] - values[None, :]) / width
    exact = np.exp(-0.5 * z**2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert np.abs(curve["density"] - exact).max() < 1e-4 * exact.max()
    assert abs(np.trapezoid(curve["density"], curve["x"]) - 1) < 1e-3


def test_few_order_values_still_give_even_buckets(spark):
    df = spark.range(100_000).select((F.col("id") % 10).alias("day"), F.col("id").alias("event"))
    sizes = [r["count"] for r in ordering.with_bucket(df, ["day"], 16).groupBy(ordering.BUCKET).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 100_000 / 16
    days = ordering.with_bucket(df, ["day"], 16).groupBy(ordering.BUCKET).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spans = [(r["a"], r["b"]) for r in days.orderBy(ordering.BUCKET).collect()]
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))
