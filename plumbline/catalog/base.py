"""Registry of runnable queries, and the derived input views they share.

A view is one SQL text over the given tables that means the same to Spark and to
the SQL that checks the results; ``{events}`` stands for the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import named
from plumbline.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

VIEWS = {
    # Missing cells of every kind: NULL, blank, token, padded and upper-case text.
    "dirty_events": """
        SELECT event_id, user_id, ts,
          CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  '
               WHEN event_id % 17 = 0 THEN ' N/A'
               WHEN event_id % 5 = 0 THEN concat(' ', upper(event_type), ' ') ELSE event_type END AS event_type,
          CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
        FROM {events}""",
    # Exact duplicate rows.
    "dup_orders": """
        SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders}
        UNION ALL
        SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders} WHERE o_orderkey % 10 = 0""",
    # Decorated numbers and dates that do not parse.
    "text_customer": """
        SELECT c_custkey,
          concat('USD ', cast(c_custkey AS varchar(20)), ',', cast(c_nationkey AS varchar(20)), '.50') AS amount_text,
          CASE WHEN c_custkey % 9 = 0 THEN 'unknown' ELSE '2024-01-15' END AS signup_date
        FROM {customer}""",
    # Rare misspelt values.
    "typo_part": """
        SELECT p_partkey,
          CASE WHEN p_partkey % 401 = 0 THEN concat(' ', p_type, 'x')
               WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END AS p_type
        FROM {part}""",
    # Training table with a unique key and a 0/1 label.
    "ml_lineitem": """
        SELECT concat(cast(l_orderkey AS varchar(20)), '|', cast(l_partkey AS varchar(20)), '|',
                      cast(l_suppkey AS varchar(20)), '|', cast(l_linenumber AS varchar(20))) AS split_key,
          l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus,
          CAST(CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END AS double) AS label
        FROM {lineitem}""",
    # Targets without noise, so that SQL can state what a learner must find among the features.
    "step_lineitem": """
        SELECT concat(cast(l_orderkey AS varchar(20)), '|', cast(l_partkey AS varchar(20)), '|',
                      cast(l_suppkey AS varchar(20)), '|', cast(l_linenumber AS varchar(20))) AS split_key,
          l_quantity, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus,
          concat('class ', l_returnflag) AS flag_class,
          CAST(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS double) AS step,
          CAST(CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS double) AS grade,
          CAST(l_linenumber * l_linenumber AS double) AS amount
        FROM {lineitem}""",
}
TABLES = ("events", "orders", "customer", "part", "lineitem")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    used = {t: read_table(spark, folder, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_view(name: str, sql: str) -> str:
    """Checking SQL over a view: ``sql`` goes on after the view's CTE."""
    return f"WITH {name} AS ({VIEWS[name].format(**{t: t for t in TABLES})}\n)" + sql


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            CHECKS[run.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(named(c), places) + F.lit(0.0) for c in columns})
