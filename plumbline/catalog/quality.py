"""Missing values, duplicates, text repair and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.operators import duplicates, missing, repair

# SQL text for the missing test on the text column.
BLANK = "(event_type IS NULL OR lower(trim(event_type)) IN ('', 'na', 'null', 'n/a'))"

PROFILE = f"""
    , profile AS (
      SELECT 'event_id' AS column_name, CAST(0 AS BIGINT) AS missing_count, count(*) AS n FROM dirty_events
      UNION ALL SELECT 'user_id', 0, count(*) FROM dirty_events
      UNION ALL SELECT 'ts', 0, count(*) FROM dirty_events
      UNION ALL SELECT 'event_type', count(CASE WHEN {BLANK} THEN 1 END), count(*) FROM dirty_events
      UNION ALL SELECT 'value', count(*) - count(value), count(*) FROM dirty_events)
    SELECT column_name, missing_count,
           round(missing_count * CAST(100 AS DOUBLE) / n, 6) AS missing_percentage FROM profile"""


def _with_time_text(df: DataFrame) -> DataFrame:
    """The time as text without a zone."""
    return df.withColumn("ts", F.col("ts").cast("string"))


@query(with_view("dirty_events", PROFILE))
def missing_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(missing.missing_profile(view(spark, folder, "dirty_events")), ["missing_percentage"])


@query(with_view("dirty_events", PROFILE + " WHERE missing_count > 0"))
def missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(missing.missing_columns(view(spark, folder, "dirty_events")), ["missing_percentage"])


@query(with_view("dirty_events", f"""
    SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts, CASE WHEN NOT {BLANK} THEN event_type END AS event_type, value
    FROM dirty_events"""))
def normalize_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _with_time_text(missing.normalize_missing(view(spark, folder, "dirty_events")))


@query(with_view("dirty_events", """
    SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts, event_type, value FROM dirty_events
    WHERE ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL"""))
def drop_missing_any(spark: SparkSession, folder: str) -> DataFrame:
    return _with_time_text(missing.drop_missing(view(spark, folder, "dirty_events")))


@query(with_view("dirty_events", """
    SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts, event_type, value FROM dirty_events WHERE value IS NOT NULL"""))
def drop_missing_cols(spark: SparkSession, folder: str) -> DataFrame:
    return _with_time_text(missing.drop_missing(view(spark, folder, "dirty_events"), ["value"]))


@query(with_view("dirty_events", """
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM dirty_events)), 6) AS value FROM dirty_events"""))
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    filled = missing.impute_mean(view(spark, folder, "dirty_events"), ["value"])
    return rounded(filled.select("event_id", "value"), ["value"])


@query(with_view("dirty_events", """
    SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty_events)), 6) AS value
    FROM dirty_events"""))
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    filled = missing.impute_median(view(spark, folder, "dirty_events"), ["value"])
    return rounded(filled.select("event_id", "value"), ["value"])


@query(with_view("dirty_events", f"""
    , known AS (SELECT event_id, CASE WHEN NOT {BLANK} THEN event_type END AS event_type FROM dirty_events)
    , ranked AS (
      SELECT event_type AS common FROM known WHERE event_type IS NOT NULL
      GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, coalesce(event_type, (SELECT common FROM ranked)) AS event_type FROM known"""))
def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    known = missing.normalize_missing(view(spark, folder, "dirty_events"))
    return missing.impute_mode(known, ["event_type"]).select("event_id", "event_type")


@query(with_view("dirty_events", """
    SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, CAST(-1 AS DOUBLE)) AS value
    FROM dirty_events"""))
def fill_constant(spark: SparkSession, folder: str) -> DataFrame:
    filled = missing.fill_constant(view(spark, folder, "dirty_events"), {"event_type": "unknown", "value": "-1"})
    return filled.select("event_id", "event_type", "value")


# A column for each of the five strategies.
@query(with_view("dirty_events", f"""
    , known AS (
      SELECT event_id, user_id, CASE WHEN NOT {BLANK} THEN event_type END AS event_type, value,
        CASE WHEN event_id % 4 > 0 THEN value END AS second,
        CASE WHEN event_id % 3 > 0 THEN 'k' || CAST(event_id % 5 AS VARCHAR) END AS code,
        CASE WHEN event_id % 6 > 0 THEN CAST(user_id AS INTEGER) END AS owner FROM dirty_events)
    , common AS (
      SELECT code FROM known WHERE code IS NOT NULL GROUP BY code ORDER BY count(*) DESC, code LIMIT 1)
    SELECT event_id, user_id, event_type,
      round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM known)), 6) AS value,
      round(coalesce(second, (SELECT avg(second) FROM known)), 6) AS second,
      coalesce(code, (SELECT code FROM common)) AS code, coalesce(owner, -1) AS owner
    FROM known WHERE event_type IS NOT NULL"""))
def treat_missing(spark: SparkSession, folder: str) -> DataFrame:
    known = missing.normalize_missing(view(spark, folder, "dirty_events")).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "CASE WHEN event_id % 4 > 0 THEN value END AS second",
        "CASE WHEN event_id % 3 > 0 THEN concat('k', event_id % 5) END AS code",
        "CASE WHEN event_id % 6 > 0 THEN int(user_id) END AS owner",
    )
    strategies = {"value": "median", "event_type": "drop", "second": "mean", "code": "mode", "owner": ("constant", -1)}
    return rounded(missing.treat_missing(known, strategies), ["value", "second"])


def _duplicates(keys: str) -> str:
    return with_view("dup_orders", f"""
    , grouped AS (SELECT count(*) AS n FROM dup_orders GROUP BY {keys})
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
           round(CAST(sum(n - 1) AS DOUBLE) * 100 / CAST(sum(n) AS DOUBLE), 6) AS duplicate_percentage
    FROM grouped""")


@query(_duplicates("o_custkey, o_orderstatus, o_orderpriority"))
def duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(duplicates.duplicate_summary(view(spark, folder, "dup_orders")), ["duplicate_percentage"])


@query(_duplicates("o_custkey, o_orderstatus"))
def duplicate_summary_subset(spark: SparkSession, folder: str) -> DataFrame:
    found = duplicates.duplicate_summary(view(spark, folder, "dup_orders"), ["o_custkey", "o_orderstatus"])
    return rounded(found, ["duplicate_percentage"])


@query(with_view("dup_orders", """
    SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n_copies FROM dup_orders
    GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicate_groups(view(spark, folder, "dup_orders"))


@query(with_view("dup_orders", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM dup_orders"))
def dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.drop_duplicates(view(spark, folder, "dup_orders"))


@query(with_view("dirty_events", "SELECT event_id, lower(trim(event_type)) AS event_type FROM dirty_events"))
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return repair.clean_text(view(spark, folder, "dirty_events"), ["event_type"]).select("event_id", "event_type")


FREQUENCY = """
    , cleaned AS (SELECT lower(trim(p_type)) AS p_type FROM typo_part)
    SELECT p_type, count(*) AS n_rows FROM cleaned GROUP BY p_type"""


@query(with_view("typo_part", FREQUENCY))
def typo_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return repair.value_frequency(view(spark, folder, "typo_part"), "p_type")


@query(with_view("typo_part", FREQUENCY + " HAVING count(*) <= 5"))
def typo_suspicious(spark: SparkSession, folder: str) -> DataFrame:
    return repair.suspicious_values(view(spark, folder, "typo_part"), "p_type", 5)


@query(with_view("text_customer", """
    SELECT c_custkey, CAST(try_strptime(signup_date, '%Y-%m-%d') AS DATE) AS signup_date FROM text_customer"""))
def standardize_date(spark: SparkSession, folder: str) -> DataFrame:
    return repair.standardize_date(view(spark, folder, "text_customer"), "signup_date").drop("amount_text")


@query(with_view("text_customer", """
    SELECT c_custkey, regexp_replace(amount_text, '[^0-9.]', '', 'g') AS amount_text FROM text_customer"""))
def clean_numeric_text(spark: SparkSession, folder: str) -> DataFrame:
    return repair.clean_numeric_text(view(spark, folder, "text_customer"), "amount_text").drop("signup_date")


@query(with_view("text_customer", """
    SELECT c_custkey, TRY_CAST(regexp_replace(amount_text, '[^0-9.+-]', '', 'g') AS DOUBLE) AS amount_text
    FROM text_customer"""))
def clean_numeric_strict(spark: SparkSession, folder: str) -> DataFrame:
    texts = view(spark, folder, "text_customer").drop("signup_date")
    return repair.clean_numeric_text(texts, "amount_text", strict=True)


def _fill(function: str, frame: str, keys: str) -> str:
    return with_view("dirty_events", f"""
    SELECT event_id, user_id, {function}(value IGNORE NULLS) OVER (
      {keys} ORDER BY ts, event_id ROWS BETWEEN {frame}) AS value FROM dirty_events""")


BEFORE, AFTER = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
ORDER = ["ts", "event_id"]


@query(_fill("last_value", BEFORE, "PARTITION BY user_id"))
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = repair.forward_fill(view(spark, folder, "dirty_events"), "value", ORDER, ["user_id"])
    return filled.select("event_id", "user_id", "value")


@query(_fill("last_value", BEFORE, ""))
def forward_fill_global(spark: SparkSession, folder: str) -> DataFrame:
    filled = repair.forward_fill(view(spark, folder, "dirty_events"), "value", ORDER)
    return filled.select("event_id", "user_id", "value")


@query(_fill("first_value", AFTER, "PARTITION BY user_id"))
def backward_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = repair.backward_fill(view(spark, folder, "dirty_events"), "value", ORDER, ["user_id"])
    return filled.select("event_id", "user_id", "value")


@query(_fill("first_value", AFTER, ""))
def backward_fill_global(spark: SparkSession, folder: str) -> DataFrame:
    filled = repair.backward_fill(view(spark, folder, "dirty_events"), "value", ORDER)
    return filled.select("event_id", "user_id", "value")
