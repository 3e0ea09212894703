"""Small literal tables for the behaviours that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns
from plumbline.operators import charts, duplicates, features, inspect, missing, outliers, repair, summaries
from plumbline.sources.tables import read_csv, read_csv_checked


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a string, v double")


def test_type_classes(spark):
    df = spark.sql(
        "SELECT 1Y AS tiny, 2S AS small, 1.5BD AS dec, 'x' AS s, true AS b, date'2024-01-01' AS d, array(1) AS arr,"
        " map('k', 1) AS m, struct(1 AS x) AS st, interval '1' day AS i"
    )
    assert columns.numeric_columns(df) == ["tiny", "small", "dec"]
    assert columns.categorical_columns(df) == ["s"]
    kinds = {r["column_name"]: r["column_class"] for r in inspect.schema_listing(df).collect()}
    assert kinds["b"] == "boolean" and kinds["d"] == "temporal"
    assert {kinds[c] for c in ("arr", "m", "st", "i")} == {"nested"}


def test_candidate_features_keep_order_and_drop_the_target(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 2.0)], "n int, s string, s_indexed double, y double")
    assert columns.candidate_features(df, "y") == ["n", "s_indexed"]
    assert columns.date_like_columns(spark.createDataFrame([("x", 1)], "Order_Date string, date_id int")) == ["Order_Date"]


def test_missing_profile_counts_every_kind(spark):
    df = spark.createDataFrame(
        [(None, None, 1), ("  ", float("nan"), 2), (" N/A", 1.0, 3), ("Null", 2.0, 4), ("nan", 3.0, None), ("ok", 4.0, 6)],
        "`my col` string, v double, count int",
    )
    assert rows(missing.missing_profile(df)) == [
        ("my col", 4, pytest.approx(4 / 6 * 100)),
        ("v", 2, pytest.approx(2 / 6 * 100)),
        ("count", 1, pytest.approx(1 / 6 * 100)),
    ]
    assert [r[0] for r in rows(missing.missing_columns(df.select("count")))] == ["count"]


def test_missing_profile_of_empty_and_nested(spark, empty):
    assert rows(missing.missing_profile(empty)) == [("a", 0, 0.0), ("v", 0, 0.0)]
    nested = spark.sql("SELECT array(1) AS arr, CAST(NULL AS map<string,int>) AS m, struct(1 AS x) AS st")
    assert {r[0]: r[1] for r in rows(missing.missing_profile(nested))} == {"arr": 0, "m": 1, "st": 0}


def test_normalised_cells_can_be_treated(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("x", 2.0), ("x", None)], "s string, v double")
    assert missing.drop_missing(missing.normalize_missing(df)).count() == 1
    done = missing.treat_missing(missing.normalize_missing(df), {"s": "mode", "v": "mean"})
    assert sorted(rows(done)) == [("x", 2.0), ("x", 2.0), ("x", 2.0)]


def test_mean_promotes_integers_and_skips_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 3.0)], "i int, v double")
    done = missing.impute_mean(df, ["i", "v"])
    assert rows(done) == [(1.0, 1.0), (2.0, 2.0), (1.5, 3.0)]


def test_all_null_columns_stay(spark):
    df = spark.createDataFrame([(None, None)], "v double, s string")
    for done in (missing.impute_mean(df, ["v"]), missing.impute_median(df, ["v"]), missing.impute_mode(df, ["v", "s"])):
        assert rows(done) == [(None, None)]


def test_mode_ignores_null_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "s string")
    assert rows(missing.impute_mode(df, ["s"])).count(("a",)) == 4


def test_constant_must_fit_the_column(spark):
    df = spark.createDataFrame([(None, None, "x")], "i int, v double, s string")
    assert rows(missing.fill_constant(df, {"i": "7", "v": "1.5"})) == [(7, 1.5, "x")]
    with pytest.raises(ValueError, match="does not fit"):
        missing.fill_constant(df, {"i": "seven"})
    with pytest.raises(ValueError, match="numeric"):
        missing.impute_mean(df, ["s"])
    with pytest.raises(ValueError, match="unknown strategy"):
        missing.treat_missing(df, {"i": "guess"})


def test_duplicates(spark, empty):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "count int, s string")
    assert rows(duplicates.duplicate_summary(df)) == [(6, 3, 3, 50.0)]
    assert rows(duplicates.duplicate_summary(df, ["count"])) == [(6, 3, 3, 50.0)]
    assert sorted(rows(duplicates.duplicate_groups(df)), key=str) == [(1, "a", 3), (2, None, 2)]
    assert duplicates.drop_duplicates(df).count() == 3
    assert rows(duplicates.duplicate_summary(empty)) == [(0, 0, 0, 0.0)]
    maps = spark.sql("SELECT map('a', 1) AS m UNION ALL SELECT map('a', 1)")
    assert rows(duplicates.duplicate_summary(maps)) == [(2, 1, 1, 50.0)]


def test_outliers_without_spread_or_values(spark):
    constant = spark.createDataFrame([(0.1,)] * 7 + [(None,)], "v double")
    for method in outliers.METHODS:
        assert outliers.detect(constant, "v", method).count() == 0
        assert outliers.remove(constant, "v", method).count() == 8
    nothing = spark.createDataFrame([(None,)], "v double")
    assert {r["outlier_count"] for r in outliers.summary(nothing, "v").collect()} == {0}
    with pytest.raises(ValueError, match="unknown method"):
        outliers.detect(constant, "v", "magic")


def test_outlier_treatment_keeps_null_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in rows(outliers.detect(df, "v"))] == [1000.0]
    assert outliers.remove(df, "v").count() == 22
    middle = rows(outliers.replace_with_median(df, "v").where("v > 500"))
    assert middle == [] or all(math.isnan(v) for (v,) in middle)
    mean = (sum(range(20)) + 1000) / 21
    assert outliers.replace_with_mean(df, "v").where(F.abs(F.col("v") - mean) < 1e-9).count() == 1


def test_log_and_invalid_minimum(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-5.0,), (None,), (math.e - 1,)], "v double")
    assert [r[0] for r in rows(outliers.log_transform(df, "v"))] == pytest.approx([0.0, None, None, None, 1.0])
    assert rows(outliers.invalid_min(df, "v", 0)) == [(3, 1, 1)]
    assert outliers.invalid_rows(df, "v", 0).count() == 3 and outliers.valid_rows(df, "v", 0).count() == 1


def test_text_repair(spark):
    df = spark.createDataFrame([(" -$1,234.5 ", "2024-02-30"), ("x", "2024-02-29")], "n string, d string")
    assert [r[0] for r in rows(repair.clean_numeric_text(df, "n").select("n"))] == ["1234.5", ""]
    assert [r[0] for r in rows(repair.clean_numeric_text(df, "n", strict=True).select("n"))] == [-1234.5, None]
    assert [str(r[0]) for r in rows(repair.standardize_date(df, "d").select("d"))] == ["None", "2024-02-29"]
    typos = spark.createDataFrame([(" A",)] * 6 + [("a",), ("b ",)], "s string")
    assert rows(repair.value_frequency(typos, "s")) == [("b", 1), ("a", 7)]
    assert rows(repair.suspicious_values(typos, "s")) == [("b", 1)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    assert rows(summaries.pearson(df, "a", "b")) == [(3, pytest.approx(1.0))]
    assert rows(summaries.pearson(df, "a", "c")) == [(4, None)]
    matrix = {(x, y): r for x, y, r in rows(charts.correlation_matrix(df))}
    assert matrix["a", "b"] == matrix["b", "a"] == pytest.approx(1.0)
    assert matrix["a", "c"] is None and matrix["c", "c"] is None and len(matrix) == 9


def test_task_type_ignores_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "y string")
    assert rows(summaries.task_type(df, "y")) == [(2, "binary")]
    assert rows(summaries.class_balance(df, "y")) == [("a", 1), ("b", 1)]
    assert rows(summaries.unique_count(df, "y")) == [(3,)]


def test_chart_data_of_constant_and_empty(spark, empty):
    constant = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    counts = [r["n_rows"] for r in charts.histogram(constant, "v").orderBy("bin").collect()]
    assert counts == [2] + [0] * 39
    assert sum(r["n_rows"] for r in charts.histogram(empty, "v").collect()) == 0
    assert charts.kde(constant, "v").count() == 0
    box = charts.box_stats(constant, "v").first()
    assert (box["q1"], box["whisker_low"], box["n_outliers"]) == (2.0, 2.0, 0)
    assert charts.box_stats(empty, "v").first()["n_values"] == 0
    assert rows(inspect.shape(empty)) == [(0, 2)]


def test_split_is_whole_and_disjoint(spark):
    df = spark.range(5_000)
    train, test = features.train_test_split(df, ["id"], 0.3, seed=1)
    assert train.count() + test.count() == 5_000 and train.join(test, "id", "left_semi").count() == 0
    assert 1_350 < test.count() < 1_650
    other = features.train_test_split(df, ["id"], 0.3, seed=2)[1]
    assert other.join(test, "id", "left_anti").count() > 0
    a, b = features.random_split(df)
    assert a.count() + b.count() == 5_000


@pytest.fixture(scope="module")
def categories(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("new",), (None,), ("c",)], "c string")
    return train, test


def test_label_encoding_matches_the_ml_indexer(spark, categories):
    from pyspark.ml.feature import StringIndexer

    train, test = categories
    _, encoded = features.label_encoding(train, test, "c")
    indexer = StringIndexer(inputCol="c", outputCol="c_indexed", handleInvalid="keep").fit(train)
    assert sorted(rows(encoded), key=str) == sorted(rows(indexer.transform(test)), key=str)


def test_frequency_encoding_keeps_the_feature(categories):
    train, test = categories
    a, b = features.frequency_encoding(train, test, ["c"])
    assert sorted(r[0] for r in rows(a)) == pytest.approx([0.0, 1 / 6, 1 / 3, 1 / 3, 1 / 3, 1 / 3])
    assert sorted(r[0] for r in rows(b)) == pytest.approx([0.0, 0.0, 1 / 6, 1 / 3])
    assert features.frequency_encoding(train, test, []) == (train, test)


def test_onehot_of_unseen_is_all_zero(categories):
    train, test = categories
    _, encoded = features.onehot_encoding(train, test, "c")
    vectors = {r["c"]: r["c_ohe"].toArray().tolist() for r in encoded.collect()}
    assert vectors["new"] == vectors[None] == [0.0, 0.0, 0.0] and vectors["a"] == [1.0, 0.0, 0.0]


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0)], "k double, v double")
    standard, _ = features.scaling(df, df, ["k", "v"])
    assert [r["scaled_features"][0] for r in standard.collect()] == [0.0, 0.0]
    minmax, _ = features.scaling(df, df, ["k", "v"], "minmax")
    assert [tuple(r["scaled_features"]) for r in minmax.collect()] == [(0.5, 0.0), (0.5, 1.0)]


def test_selection(spark):
    df = spark.range(2_000).select(
        (F.col("id") % 2).cast("double").alias("y"),
        (F.col("id") % 2 * 3 + F.col("id") % 5).alias("good"),
        (F.col("id") % 7).alias("noise"),
        (F.col("id") * 1.5).alias("many"),
        (-F.col("id")).alias("negative"),
        F.lit(None).cast("double").alias("blank"),
    )
    found = features.select_chisq(df.drop("blank"), "y", k=1, max_categories=100, bins={"many": 10})
    assert [r["feature"] for r in found.collect()] == ["good"]
    assert [r["feature"] for r in features.select_chisq(df.select("y", "good", "negative", "blank"), "y").collect()] == ["good"]
    assert "blank" not in [r["column_name"] for r in features.select_variance(df).collect()]


def test_csv_roundtrip(spark, tmp_path):
    spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "a int, b double, c string").coalesce(1).write.option(
        "header", True
    ).csv(f"{tmp_path}/t.csv")
    inferred = read_csv(spark, str(tmp_path), "t.csv")
    assert dict(inferred.dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert rows(read_csv(spark, f"{tmp_path}/t.csv", schema="a int, b double, c string", nrows=1, order_by=["a"])) == [
        (1, 2.5, "x")
    ]


def test_violin_keeps_categories_without_a_curve(spark):
    rows = [("a", float(i)) for i in range(9)] + [("b", 4.0)] * 3 + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = charts.violin_data(df, "k", "v", grid=5)
    flat = {r["category"]: r for r in found.where("density IS NULL").collect()}
    assert found.where("category = 'a'").count() == 5
    assert {k: (r["n_values"], r["median"], r["x"]) for k, r in flat.items()} == {
        "b": (3, 4.0, None), "c": (1, 1.0, None), "d": (0, None, None)
    }
    assert charts.violin_data(df.limit(0), "k", "v").collect() == []


def test_missing_matrix_has_a_slice_of_rows_without_order(spark):
    df = spark.createDataFrame([(0, "x"), (10, None), (None, "y"), (None, None)], "at int, v string")
    found = {(r["slice"], r["column_name"]): r["missing_count"] for r in charts.missing_matrix(df, "at", 2).collect()}
    assert found == {
        (0, "at"): 0, (0, "v"): 0, (1, "at"): 0, (1, "v"): 1, (None, "at"): 2, (None, "v"): 1
    }


def test_pair_data_takes_every_numeric_column(spark):
    df = spark.createDataFrame([tuple(range(i, i + 6)) for i in range(9)], [f"c{i}" for i in range(6)])
    found = charts.pair_data(df, bins=3, grid=4)
    assert found.where("x != y").agg({"value": "sum"}).first()[0] == 15 * 9
    assert found.where("x = y").select("x").distinct().count() == 6


def test_pair_data_curves_are_those_of_each_column(spark):
    df = spark.range(200).selectExpr("id", "if(id % 7 = 0, null, sin(id)) AS s", "if(id % 5 = 0, double('nan'), id * id) AS q", "1 AS flat")
    found = charts.pair_data(df, grid=9).where("x = y").collect()
    for c in df.columns:
        want = {r["grid_point"]: r["density"] for r in charts.kde(df, c, 9).collect()}
        got = {r["x_bin"]: r["value"] for r in found if r["x"] == c}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert charts.pair_data(df.limit(0)).count() == 0


def test_large_whole_numbers_keep_their_ends(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,), (None,)], "n bigint")
    row = inspect.describe(df).first()
    assert (row["min_text"], row["max_text"]) == ("9007199254740992", "9007199254740993")
    assert outliers.invalid_min(df, "n", 9007199254740992).first()[:] == (1, 1, 1)


def test_zscore_finds_what_it_removes(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(50), 900, -700]] + [(float("nan"),), (None,)], "x double")
    found, left = outliers.detect(df, "x", "zscore"), outliers.remove(df, "x", "zscore")
    assert found.count() > 0 and found.count() + left.count() == df.count()


def test_csv_rejects_add_up(spark, tmp_path):
    lines = ["1,2.5,x,2024-01-01", "2,bad,y,2024-01-02", "3,1.0", "4,1.0,z,2024-01-01,9", '5,,"q,r",', '6,1,"u,v",2024-99-01',
             '7,"a,b,c,d"', '8,1,"m,n",2024-01-01,']
    (tmp_path / "t.csv").write_text("a,b,c,d\n" + "\n".join(lines) + "\n")
    good, bad = read_csv_checked(spark, str(tmp_path), "a int, b double, c string, d date", "t.csv")
    assert sorted(r["a"] for r in good.collect()) == [1, 5] and good.count() == 2 and bad.count() == 6
    found = {r["line"]: r["reason"] for r in bad.collect()}
    assert found == dict(zip([lines[i] for i in (1, 2, 3, 5, 6, 7)], ["type", "short", "long", "type", "short", "long"]))
    assert bad.select("file").distinct().count() == 1


def test_duplicates_of_maps_stay_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), (1, map('a', 1)), (1, null) AS t(k, m)")
    (group,) = duplicates.duplicate_groups(df).collect()
    assert group["m"] == {"a": 1, "b": 2} and group["n_copies"] == 2
    left = duplicates.drop_duplicates(df)
    assert left.columns == ["k", "m"] and left.count() == 3


def test_correlation_of_many_columns_with_gaps(spark):
    df = spark.range(500).repartition(7).select(*(
        F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9)) > 0, F.rand(i) * 1e6 + F.col("id") * (i % 3) * 1e4 + 1e9).alias(f"c{i}")
        for i in range(12)
    ), F.lit(3.0).alias("flat"), F.lit(float("nan")).alias("none")).cache()
    got = {(r["x"], r["y"]): r["pearson_r"] for r in charts.correlation_matrix(df).collect()}
    assert len(got) == 14 * 14
    names = df.columns[:12]
    pairs = [(a, b) for a in names for b in names]
    expected = df.agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    for a, b in pairs:
        assert abs(got[a, b] - expected[f"{a}_{b}"]) < 1e-9
    assert got["flat", "flat"] is None and got["c1", "flat"] is None and got["none", "c1"] is None
    assert {r["pearson_r"] for r in charts.correlation_matrix(df.limit(0)).collect()} == {None}
