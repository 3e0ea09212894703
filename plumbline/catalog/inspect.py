"""Sources, shape, schema, previews and overview."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.functions.columns import date_like_columns as date_named
from plumbline.operators import inspect as ops
from plumbline.plans.stats import one_row_per
from plumbline.session import shared_dir
from plumbline.sources.tables import hash_sample as keyed_sample
from plumbline.sources.tables import read_csv, read_csv_checked, read_table, row_cap


ORDERS = """o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
           o_orderpriority"""


def _written(spark: SparkSession, folder: str) -> str:
    path = f"{shared_dir(spark)}/scan_csv-{uuid.uuid4().hex}"
    read_table(spark, folder, "orders").write.option("header", True).csv(f"{path}/orders.csv")
    return path


def _with_date_text(df: DataFrame) -> DataFrame:
    """The date as text without a zone."""
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz").cast("string"))


@query(f"SELECT {ORDERS} FROM orders")
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    found = read_csv(spark, _written(spark, folder), "orders.csv")
    whole = {c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")}
    return _with_date_text(found.withColumns(whole))


@query(f"SELECT {ORDERS} FROM orders")
def scan_csv_schema(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "orders").schema
    return _with_date_text(read_csv(spark, _written(spark, folder), "orders.csv", schema=schema))


# One line in ten is too short, one too long, and one has a key that is no number.
LINES = """
    SELECT CASE o_orderkey % 10 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'type' ELSE 'fits' END AS reason,
      concat(CASE WHEN o_orderkey % 10 = 2 THEN 'x' ELSE '' END, o_orderkey, ',', o_custkey,
        CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN concat(',', o_orderstatus, ',more')
                             ELSE concat(',', o_orderstatus) END) AS line FROM {orders}"""


@query(LINES.format(orders="orders"))
def scan_csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/scan_csv-{uuid.uuid4().hex}"
    spark.sql(LINES, orders=read_table(spark, folder, "orders")).select("line").write.text(f"{path}/orders.csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    rows, rejects = read_csv_checked(spark, path, schema, "orders.csv", header=False)
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("line")
    return rows.select(F.lit("fits").alias("reason"), line).unionByName(rejects.select("reason", "line"))


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20000""")
def scan_row_cap(spark: SparkSession, folder: str) -> DataFrame:
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return row_cap(read_table(spark, folder, "lineitem"), 20_000, order).select(*order)


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE CAST(concat('0x', substr(md5(concat(o_orderkey, '|42')), 1, 8)) AS BIGINT)
          / CAST(4294967296 AS DOUBLE) < CAST(0.1 AS DOUBLE)""")
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return keyed_sample(orders, ["o_orderkey"], 0.1, 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT {ORDERS} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return _with_date_text(ops.preview(read_table(spark, folder, "orders"), ["o_totalprice", "o_orderkey"], 100))


@query("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark: SparkSession, folder: str) -> DataFrame:
    return ops.shape(read_table(spark, folder, "lineitem"))


@query("""
    SELECT 1 AS position, 'o_orderkey' AS column_name, 'bigint' AS data_type, 'numeric' AS column_class,
           count(o_orderkey) AS filled FROM orders
    UNION ALL SELECT 2, 'o_custkey', 'bigint', 'numeric', count(o_custkey) FROM orders
    UNION ALL SELECT 3, 'o_orderstatus', 'string', 'categorical', count(o_orderstatus) FROM orders
    UNION ALL SELECT 4, 'o_totalprice', 'double', 'numeric', count(o_totalprice) FROM orders
    UNION ALL SELECT 5, 'o_orderdate', 'timestamp_ntz', 'temporal', count(o_orderdate) FROM orders
    UNION ALL SELECT 6, 'o_orderpriority', 'string', 'categorical', count(o_orderpriority) FROM orders""")
def schema_listing(spark: SparkSession, folder: str) -> DataFrame:
    return ops.schema_listing(read_table(spark, folder, "orders"))


@query(with_view("dirty_events", """
    , cells AS (
      SELECT count(*) AS n,
        count(CASE WHEN event_type IS NULL OR lower(trim(event_type)) IN ('', 'na', 'null', 'n/a') THEN 1 END) AS texts,
        count(*) - count(value) AS numbers
      FROM dirty_events)
    SELECT 'numeric' AS column_class, 'event_id, user_id, value' AS columns, 3 AS n_columns,
           3 * n - numbers AS filled, numbers AS missing FROM cells
    UNION ALL SELECT 'temporal', 'ts', 1, n, CAST(0 AS BIGINT) FROM cells
    UNION ALL SELECT 'categorical', 'event_type', 1, n - texts, texts FROM cells"""))
def column_classes(spark: SparkSession, folder: str) -> DataFrame:
    return ops.column_classes(view(spark, folder, "dirty_events"))


@query("""
    SELECT 1 AS position, 'l_quantity' AS feature, count(l_quantity) AS usable_rows FROM lineitem
    UNION ALL SELECT 2, 'l_extendedprice', count(l_extendedprice) FROM lineitem
    UNION ALL SELECT 3, 'l_discount', count(l_discount) FROM lineitem
    UNION ALL SELECT 4, 'l_tax', count(l_tax) FROM lineitem
    UNION ALL SELECT 5, 'l_linenumber', count(l_linenumber) FROM lineitem""")
def candidate_features(spark: SparkSession, folder: str) -> DataFrame:
    return ops.feature_listing(view(spark, folder, "ml_lineitem"), "label")


def _described(column: str, is_number: bool) -> str:
    value = f"CAST({column} AS DOUBLE)" if is_number else "CAST(NULL AS DOUBLE)"
    text = "CAST(NULL AS VARCHAR)" if is_number and not column.endswith(("key", "number")) else column
    return f"""
    SELECT '{column}' AS column_name, count({column}) AS filled,
           round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS stddev,
           min({value}) AS min_number, max({value}) AS max_number,
           CAST(min({text}) AS VARCHAR) AS min_text, CAST(max({text}) AS VARCHAR) AS max_text FROM lineitem"""


@query(" UNION ALL ".join(
    _described(c, c not in ("l_returnflag", "l_linestatus"))
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus")
))
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.describe(read_table(spark, folder, "lineitem")), ["mean", "stddev"])


@query(with_view("dirty_events", """
    SELECT count(*) AS n_rows, 5 AS n_columns, 3 AS n_numeric, 1 AS n_categorical,
      count(CASE WHEN event_type IS NULL OR lower(trim(event_type)) IN ('', 'na', 'null', 'n/a') THEN 1 END)
        + count(*) - count(value) AS missing_cells,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS duplicate_rows
    FROM dirty_events"""))
def overview(spark: SparkSession, folder: str) -> DataFrame:
    return ops.overview(view(spark, folder, "dirty_events"))


@query("""
    SELECT 'order_date_text' AS column_name, count(*) AS filled FROM orders""")
def date_like_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = _with_date_text(read_table(spark, folder, "orders")).withColumnRenamed("o_orderdate", "order_date_text")
    entries = [[F.lit(c).alias("column_name"), F.count(c).alias("filled")] for c in date_named(orders)]
    return one_row_per(orders, entries)
