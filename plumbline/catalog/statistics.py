"""Summaries, frequencies, correlation, quantiles and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.operators import outliers, summaries
from plumbline.plans.quantiles import approx_quantiles
from plumbline.plans.stats import one_row_per
from plumbline.sources.tables import read_table

MOMENTS = """round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS stddev,
           min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum"""


@query(f"SELECT {MOMENTS} FROM lineitem")
def numeric_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.numeric_summary(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(found, ["mean", "stddev"])


@query(f"""
    SELECT {MOMENTS}, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
           round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem""")
def seven_number_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.seven_number_summary(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(found, ["mean", "stddev", "q1", "median", "q3"])


PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)
QUANTILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(
    f"""
    SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability,
           round(quantile_cont({c}, {p}), 6) AS value, count({c}) AS n_values FROM lineitem"""
    for c in QUANTILE_COLUMNS for p in PROBS
))
def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.quantile_table(read_table(spark, folder, "lineitem"), QUANTILE_COLUMNS, PROBS), ["value"])


@query("SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id ORDER BY n_rows DESC, user_id LIMIT 20")
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.top_values(read_table(spark, folder, "events"), "user_id", 20)


@query("""
    SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS stddev,
           count(l_extendedprice) AS n_values
    FROM lineitem GROUP BY l_suppkey ORDER BY n_values DESC, l_suppkey LIMIT 10""")
def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.group_stats(read_table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice")
    return rounded(found, ["mean", "stddev"])


@query("""
    SELECT l_suppkey, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_quantity), 6) AS l_quantity,
           round(avg(l_tax), 6) AS l_tax
    FROM lineitem GROUP BY l_suppkey ORDER BY avg(l_extendedprice) DESC, l_suppkey LIMIT 10""")
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    values = ["l_extendedprice", "l_quantity", "l_tax"]
    return rounded(summaries.group_means(read_table(spark, folder, "lineitem"), "l_suppkey", values), values)


@query("""
    SELECT count(*) AS n_pairs, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem
    WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def pearson_pair(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        summaries.pearson(read_table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), ["pearson_r"]
    )


@query(with_view("dirty_events", "SELECT DISTINCT event_type FROM dirty_events"))
def unique_values(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.unique_values(view(spark, folder, "dirty_events"), "event_type")


@query(with_view("ml_lineitem", """
    SELECT count(DISTINCT label) AS n_classes,
           CASE WHEN count(DISTINCT label) = 2 THEN 'binary' ELSE 'multiclass' END AS task_type FROM ml_lineitem"""))
def task_type(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.task_type(view(spark, folder, "ml_lineitem"), "label")


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.class_balance(read_table(spark, folder, "lineitem"), "l_returnflag")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN var_samp({c}) > 1000000 THEN round(var_samp({c}), 1)
               ELSE round(var_samp({c}), 6) END AS variance FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax")
))
def variances(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.variances(read_table(spark, folder, "lineitem"))
    variance = F.col("variance")
    places = F.when(variance > 1_000_000, F.round(variance, 1)).otherwise(F.round(variance, 6))
    return found.withColumn("variance", places)


QUARTERS = [0.01, 0.25, 0.5, 0.75, 0.99]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax"]


# A sketch may name any value whose rank is within 1 % of the rows from the wanted one: the ranks are counted.
@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, count({c}) AS n_values, true AS within_error FROM lineitem"
    for c in LINE_NUMBERS for p in QUARTERS
))
def quantiles_approx(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    found = approx_quantiles(lineitem, LINE_NUMBERS, QUARTERS, 0.01)
    entries = []
    for c in LINE_NUMBERS:
        for p, value in zip(QUARTERS, found[c]):
            n, x = F.count(c), F.col(c)
            reached = (F.count_if(x < value) <= (p + 0.01) * n + 1) & (F.count_if(x <= value) >= (p - 0.01) * n - 1)
            entries.append([
                F.lit(c).alias("column_name"), F.lit(p).alias("probability"), n.alias("n_values"), reached.alias("within_error")
            ])
    return one_row_per(lineitem, entries)


@query("SELECT count(DISTINCT l_shipdate) AS n_unique FROM lineitem")
def unique_count(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.unique_count(read_table(spark, folder, "lineitem"), "l_shipdate")


@query(with_view("dirty_events", " SELECT event_id, user_id, value FROM dirty_events WHERE value <= 20"))
def invalid_min_invalid_rows(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.invalid_rows(view(spark, folder, "dirty_events"), "value", 20).select("event_id", "user_id", "value")


# Limits of each method, as SQL over the view.
LIMITS = """
    , s AS (
      SELECT avg(value) AS mean, stddev_samp(value) AS stddev, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.01) AS p01,
             quantile_cont(value, 0.99) AS p99 FROM dirty_events)
    , limits AS (
      SELECT 'iqr' AS method, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
             CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev FROM s
      UNION ALL SELECT 'zscore', mean - 3 * stddev, mean + 3 * stddev, mean, stddev FROM s
      UNION ALL SELECT 'percentile', p01, p99, NULL, NULL FROM s)"""
SUMMARY = LIMITS + """
    SELECT method, round(any_value(lower_bound), 6) AS lower_bound, round(any_value(upper_bound), 6) AS upper_bound,
      round(any_value(l.mean), 6) AS mean, round(any_value(l.stddev), 6) AS stddev,
      count(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 END) AS outlier_count,
      round(count(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 END) * CAST(100 AS DOUBLE)
            / count(*), 6) AS outlier_percentage
    FROM dirty_events, limits l"""
FLOATS = ["lower_bound", "upper_bound", "mean", "stddev", "outlier_percentage"]


def _found(method: str) -> str:
    return with_view("dirty_events", LIMITS + f"""
    SELECT event_id, user_id, value FROM dirty_events, limits
    WHERE method = '{method}' AND (value < lower_bound OR value > upper_bound)""")


@query(_found("iqr"))
def outliers_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.detect(view(spark, folder, "dirty_events"), "value", "iqr").select("event_id", "user_id", "value")


@query(_found("zscore"))
def outliers_zscore(spark: SparkSession, folder: str) -> DataFrame:
    found = outliers.detect(view(spark, folder, "dirty_events"), "value", "zscore", threshold=3)
    return found.select("event_id", "user_id", "value")


@query(_found("percentile"))
def outliers_percentile(spark: SparkSession, folder: str) -> DataFrame:
    found = outliers.detect(view(spark, folder, "dirty_events"), "value", "percentile")
    return found.select("event_id", "user_id", "value")


@query(with_view("dirty_events", SUMMARY + " WHERE method = 'iqr' GROUP BY method"))
def outlier_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.bounds(view(spark, folder, "dirty_events"), "value", "iqr"), FLOATS)


@query(with_view("dirty_events", SUMMARY + " GROUP BY method"))
def outlier_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(outliers.summary(view(spark, folder, "dirty_events"), "value"), FLOATS)


@query(with_view("dirty_events", LIMITS + """
    SELECT event_id, value FROM dirty_events, limits
    WHERE method = 'iqr' AND (value IS NULL OR value BETWEEN lower_bound AND upper_bound)"""))
def outliers_remove(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.remove(view(spark, folder, "dirty_events"), "value", "iqr").select("event_id", "value")


def _replaced(method: str, by: str) -> str:
    return with_view("dirty_events", LIMITS + f"""
    SELECT event_id, round(CASE WHEN value < lower_bound OR value > upper_bound
                           THEN (SELECT {by} FROM dirty_events) ELSE value END, 6) AS value
    FROM dirty_events, limits WHERE method = '{method}'""")


@query(_replaced("zscore", "avg(value)"))
def outliers_to_mean(spark: SparkSession, folder: str) -> DataFrame:
    done = outliers.replace_with_mean(view(spark, folder, "dirty_events"), "value", "zscore")
    return rounded(done.select("event_id", "value"), ["value"])


@query(_replaced("percentile", "quantile_cont(value, 0.5)"))
def outliers_to_median(spark: SparkSession, folder: str) -> DataFrame:
    done = outliers.replace_with_median(view(spark, folder, "dirty_events"), "value", "percentile")
    return rounded(done.select("event_id", "value"), ["value"])


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END AS c_acctbal FROM customer""")
def log_transform(spark: SparkSession, folder: str) -> DataFrame:
    done = outliers.log_transform(read_table(spark, folder, "customer"), "c_acctbal")
    return rounded(done.select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("""
    SELECT count(CASE WHEN c_acctbal <= 0 THEN 1 END) AS invalid_count,
           count(CASE WHEN c_acctbal > 0 THEN 1 END) AS valid_count,
           count(*) - count(c_acctbal) AS null_count FROM customer""")
def invalid_min(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.invalid_min(read_table(spark, folder, "customer"), "c_acctbal", 0)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def invalid_min_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer")
    return outliers.valid_rows(customer, "c_acctbal", 0).select("c_custkey", "c_acctbal")
