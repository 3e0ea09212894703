"""Chart data over whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.operators import charts as ops
from plumbline.sources.tables import read_table


def bin_sql(value: str, low: str, high: str, bins: int) -> str:
    return (
        f"CAST(least(coalesce(CASE WHEN {high} > {low} THEN floor(({value} - {low}) / (({high} - {low}) / "
        f"CAST({bins} AS DOUBLE))) END, 0), {bins - 1}) AS INTEGER)"
    )


@query(with_view("dirty_events", f"""
    , s AS (SELECT min(value) AS lo, max(value) AS hi FROM dirty_events)
    , counts AS (
      SELECT {bin_sql("value", "lo", "hi", 40)} AS bin, count(*) AS n
      FROM dirty_events, s WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 40, 6) AS bin_start,
           round(lo + (b + 1) * (hi - lo) / 40, 6) AS bin_end, coalesce(n, 0) AS n_rows
    FROM range(40) r(b) CROSS JOIN s LEFT JOIN counts ON counts.bin = b"""))
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.histogram(view(spark, folder, "dirty_events"), "value"), ["bin_start", "bin_end"])


def _curve_sql(rows: str, by: str, grid: int, bins: int) -> str:
    """CTE ``curve``: Gaussian kernels at bin means of the rows ``(g, v)``."""
    return f"""
    s AS (SELECT g, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, count(*) AS n FROM {rows} GROUP BY g)
    , points AS (
      SELECT g, lo, hi, n, sd * pow(n, -0.2) AS bw, count(*) AS w, avg(v) AS centre
      FROM {rows} JOIN s USING (g) GROUP BY g, lo, hi, n, sd, {bin_sql("v", "lo", "hi", bins)})
    , grid AS (
      SELECT *, CAST(i AS INTEGER) AS grid_point,
             lo - 3 * bw + i * (hi + 3 * bw - (lo - 3 * bw)) / CAST({grid - 1} AS DOUBLE) AS x
      FROM points CROSS JOIN range({grid}) r(i))
    , curve AS (
      SELECT g AS {by}, n AS n_values, grid_point, round(x, 6) AS x,
             round(sum(w * exp(-0.5 * pow((x - centre) / bw, 2)) / (n * bw * sqrt(2 * pi()))), 6) AS density
      FROM grid GROUP BY g, n, grid_point, x)"""


@query("WITH rows AS (SELECT 0 AS g, l_extendedprice AS v FROM lineitem), "
       + _curve_sql("rows", "one", 200, 1000).replace("round(sum(w", "round(1000 * sum(w")
       + " SELECT grid_point, x, density FROM curve")
def kde(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.kde(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(found.selectExpr("grid_point", "x", "1000 * density AS density"), ["x", "density"])


@query(with_view("dirty_events", """
    , q AS (
      SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM dirty_events)
    SELECT count(value) AS n_values, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3,
      min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low,
      max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
      count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
    FROM dirty_events, q"""))
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.box_stats(view(spark, folder, "dirty_events"), "value"), ["q1", "median", "q3"])


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS pearson_r FROM lineitem"
    for a in LINE_NUMBERS for b in LINE_NUMBERS
))
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.correlation_matrix(read_table(spark, folder, "lineitem")), ["pearson_r"])


@query("""
    SELECT event_id, user_id, value FROM events
    WHERE CAST(concat('0x', substr(md5(concat(event_id, '|42')), 1, 8)) AS BIGINT)
          / CAST(4294967296 AS DOUBLE) < CAST(0.1 AS DOUBLE)""")
def scatter_sample(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scatter_sample(read_table(spark, folder, "events"), "user_id", "value", ["event_id"])


@query(f"""
    WITH s AS (
      SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1
      FROM lineitem)
    SELECT {bin_sql("l_quantity", "a0", "a1", 50)} AS x_bin, {bin_sql("l_extendedprice", "b0", "b1", 50)} AS y_bin,
           count(*) AS n_rows FROM lineitem, s GROUP BY ALL""")
def scatter_density(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scatter_density(read_table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


def _pair_sql() -> str:
    reach = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_NUMBERS)
    cells = [
        f"""
      SELECT '{a}' AS x, '{b}' AS y, {bin_sql(a, f"lo_{a}", f"hi_{a}", 20)} AS x_bin,
             {bin_sql(b, f"lo_{b}", f"hi_{b}", 20)} AS y_bin, CAST(count(*) AS DOUBLE) AS value
      FROM lineitem, reach GROUP BY ALL"""
        for a, b in combinations(LINE_NUMBERS, 2)
    ]
    values = " UNION ALL ".join(f"SELECT '{c}' AS g, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in LINE_NUMBERS)
    diagonal = """
      SELECT col AS x, col AS y, grid_point AS x_bin, CAST(NULL AS INTEGER) AS y_bin, density AS value FROM curve"""
    return (
        f"WITH reach AS (SELECT {reach} FROM lineitem), rows AS ({values}), "
        + _curve_sql("rows", "col", 50, 1000)
        + " UNION ALL ".join([*cells, diagonal])
    )


@query(_pair_sql())
def pair_data(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.pair_data(read_table(spark, folder, "lineitem")), ["value"])


@query(with_view("dirty_events", f"""
    , s AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM dirty_events)
    , sliced AS (SELECT *, {bin_sql("event_id", "lo", "hi", 50)} AS slice FROM dirty_events, s)
    SELECT slice, column_name, count(CASE WHEN gone THEN 1 END) AS missing_count,
           round(count(CASE WHEN gone THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS missing_rate
    FROM (
      SELECT slice, 'event_id' AS column_name, event_id IS NULL AS gone FROM sliced
      UNION ALL SELECT slice, 'user_id', user_id IS NULL FROM sliced
      UNION ALL SELECT slice, 'ts', ts IS NULL FROM sliced
      UNION ALL SELECT slice, 'event_type',
        event_type IS NULL OR lower(trim(event_type)) IN ('', 'na', 'null', 'n/a') FROM sliced
      UNION ALL SELECT slice, 'value', value IS NULL FROM sliced)
    GROUP BY slice, column_name"""))
def missing_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.missing_matrix(view(spark, folder, "dirty_events"), "event_id"), ["missing_rate"])


TOP_SUPPLIERS = """
    top AS (
      SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL
      GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 20)"""


@query("WITH " + TOP_SUPPLIERS + """
    , rows AS (SELECT l_suppkey AS g, l_quantity AS v FROM lineitem SEMI JOIN top USING (l_suppkey)
               WHERE l_quantity IS NOT NULL)
    , """ + _curve_sql("rows", "category", 50, 200) + """
    , q AS (
      SELECT g AS category, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
             round(quantile_cont(v, 0.75), 6) AS q3 FROM rows GROUP BY g)
    SELECT category, n_values, q1, median, q3, grid_point, x, density FROM curve JOIN q USING (category)""")
def violin_data(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.violin_data(read_table(spark, folder, "lineitem"), "l_suppkey", "l_quantity")
    return rounded(found, ["q1", "median", "q3", "x", "density"])


@query("WITH " + TOP_SUPPLIERS + """
    SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
           round(avg(l_tax), 6) AS l_tax FROM lineitem SEMI JOIN top USING (l_suppkey) GROUP BY l_suppkey""")
def stacked_bar_data(spark: SparkSession, folder: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice", "l_tax"]
    return rounded(ops.stacked_bar_data(read_table(spark, folder, "lineitem"), "l_suppkey", values), values)
