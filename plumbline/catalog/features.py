"""Split, encoding, scaling, selection and assembly."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.operators import features as ops

NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def marked(name: str, key: str) -> str:
    """Checking SQL for a view with a ``split`` column, as the CTE ``m``."""
    return f"""
    , m AS (
      SELECT *, CASE WHEN CAST(concat('0x', substr(md5(concat({key}, '|42')), 1, 8)) AS BIGINT)
                          / CAST(4294967296 AS DOUBLE) < CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS split
      FROM {name})"""


def parts(spark: SparkSession, folder: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The view with its ``split`` column, and its training rows."""
    rows = ops.with_split(view(spark, folder, name), [key])
    return rows, rows.where(F.col("split") == "train")


@query(with_view("ml_lineitem", marked("ml_lineitem", "split_key") + " SELECT split_key, split FROM m"))
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = ops.train_test_split(view(spark, folder, "ml_lineitem"), ["split_key"])
    return train.select("split_key", F.lit("train").alias("split")).unionByName(
        test.select("split_key", F.lit("test").alias("split"))
    )


LABEL_INDEX = """
    , ranked AS (
      SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS idx
      FROM m WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})
    , n AS (SELECT count(*) AS n FROM ranked)"""


@query(with_view("dirty_events", marked("dirty_events", "event_id") + LABEL_INDEX.format(c="event_type") + """
    SELECT m.event_id, m.event_type, CAST(coalesce(idx, n) AS DOUBLE) AS event_type_indexed
    FROM m LEFT JOIN ranked USING (event_type) CROSS JOIN n"""))
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows, train = parts(spark, folder, "dirty_events", "event_id")
    encoded = ops.label_encode(rows, "event_type", ops.label_index(train, "event_type"))
    return encoded.select("event_id", "event_type", "event_type_indexed")


@query(with_view("dirty_events", marked("dirty_events", "event_id") + """
    , f AS (
      SELECT event_type, count(*) / CAST((SELECT count(*) FROM m WHERE split = 'train') AS DOUBLE) AS share
      FROM m WHERE split = 'train' AND event_type IS NOT NULL GROUP BY event_type)
    SELECT event_id, round(coalesce(share, 0), 6) AS event_type FROM m LEFT JOIN f USING (event_type)"""))
def freq_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows, train = parts(spark, folder, "dirty_events", "event_id")
    encoded = ops.frequency_encode(rows, "event_type", ops.frequency_table(train, "event_type"))
    return rounded(encoded.select("event_id", "event_type"), ["event_type"])


@query(with_view("dirty_events", marked("dirty_events", "event_id") + LABEL_INDEX.format(c="event_type") + """
    SELECT event_id, array_to_string(
      [CASE WHEN i = idx THEN '1' ELSE '0' END FOR i IN range(n)], '') AS event_type_ohe
    FROM m LEFT JOIN ranked USING (event_type) CROSS JOIN n"""))
def onehot_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows, train = parts(spark, folder, "dirty_events", "event_id")
    encoded = ops.onehot_encoder(train, "event_type").transform(rows)
    bits = F.transform(vector_to_array("event_type_ohe"), lambda x: x.cast("int").cast("string"))
    return encoded.select("event_id", F.array_join(bits, "").alias("event_type_ohe"))


def _scaled_sql(formula: str) -> str:
    aggregates = ", ".join(
        f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC
    )
    columns = ", ".join(f"round({formula.format(c=c)}, 6) + 0.0 AS {c}" for c in NUMERIC)
    return with_view("ml_lineitem", marked("ml_lineitem", "split_key") + f"""
    , s AS (SELECT {aggregates} FROM m WHERE split = 'train')
    SELECT split_key, {columns} FROM m CROSS JOIN s""")


def _scaled(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    rows, train = parts(spark, folder, "ml_lineitem", "split_key")
    done = ops.scaler(train, NUMERIC, kind).transform(rows)
    values = vector_to_array("scaled_features")
    return rounded(done.select("split_key", *(values[i].alias(c) for i, c in enumerate(NUMERIC))), NUMERIC)


@query(_scaled_sql("({c} - a_{c}) / s_{c}"))
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "standard")


@query(_scaled_sql("({c} - lo_{c}) / CAST(hi_{c} - lo_{c} AS DOUBLE)"))
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "minmax")


@query(with_view("ml_lineitem", marked("ml_lineitem", "split_key") + """
    , v AS (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, var_samp({c}) AS v FROM m WHERE split = 'train'"
        for c in [*NUMERIC, "label"]
    ) + ") SELECT column_name, round(v, 6) AS variance FROM v WHERE v > 0.01"))
def select_variance(spark: SparkSession, folder: str) -> DataFrame:
    _, train = parts(spark, folder, "ml_lineitem", "split_key")
    return rounded(ops.select_variance(train, 0.01, [*NUMERIC, "label"]), ["variance"])


# l_extendedprice has many values and is cut at its deciles; the others are categories.
CHISQ_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
CHISQ_BINS = {"l_extendedprice": 10}
CHISQ = with_view("ml_lineitem", marked("ml_lineitem", "split_key") + """
    , t AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS y FROM m WHERE split = 'train')
    , cuts AS (SELECT list_distinct(quantile_cont(l_extendedprice,
               [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM t)
    , cells AS (""" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, y, "
        + ("len([e FOR e IN q IF e <= l_extendedprice])" if c == "l_extendedprice" else f"CAST({c} AS DOUBLE)")
        + " AS x, count(*) AS n FROM t, cuts GROUP BY ALL"
        for i, c in enumerate(CHISQ_FEATURES)
    ) + """)
    , margins AS (
      SELECT *, sum(n) OVER (PARTITION BY feature, x) * sum(n) OVER (PARTITION BY feature, y)
                / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS expected FROM cells)
    , tests AS (
      SELECT feature, position,
             sum((n - expected) * (n - expected) / expected) + max(total) - sum(expected) AS statistic,
             (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS degrees_of_freedom
      FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM margins) GROUP BY feature, position)""")


def _chisq_input(spark: SparkSession, folder: str) -> DataFrame:
    _, train = parts(spark, folder, "ml_lineitem", "split_key")
    flag = F.when(F.col("l_returnflag") == "A", 0.0).otherwise(1.0)
    return train.select(*CHISQ_FEATURES, flag.alias("y"))


@query(CHISQ + """
    SELECT feature, CAST(position AS INTEGER) AS position, round(statistic, 4) AS statistic,
           degrees_of_freedom FROM tests""")
def chisq_statistic(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.chisq_statistics(_chisq_input(spark, folder), "y", CHISQ_FEATURES, bins=CHISQ_BINS)
    return rounded(found.drop("p_value"), ["statistic"], 4)


# The p-value falls as the cube-root-normalised statistic rises (Wilson-Hilferty).
@query(CHISQ + """
    SELECT feature, CAST(position AS INTEGER) AS position FROM tests
    ORDER BY (pow(statistic / degrees_of_freedom, 1.0 / 3) - (1 - 2.0 / (9 * degrees_of_freedom)))
             / sqrt(2.0 / (9 * degrees_of_freedom)) DESC, position LIMIT 3""")
def select_chisq(spark: SparkSession, folder: str) -> DataFrame:
    return ops.select_chisq(_chisq_input(spark, folder), "y", k=3, bins=CHISQ_BINS)


@query(with_view("dirty_events", """
    SELECT event_id, CAST(user_id AS DOUBLE) AS f0, value AS f1 FROM dirty_events WHERE value IS NOT NULL"""))
def assemble_features(spark: SparkSession, folder: str) -> DataFrame:
    done = ops.assemble(view(spark, folder, "dirty_events"), ["user_id", "value"])
    vector = vector_to_array("features")
    return done.select("event_id", vector[0].alias("f0"), vector[1].alias("f1"))


@query(with_view("ml_lineitem", marked("ml_lineitem", "split_key") + LABEL_INDEX.format(c="l_returnflag") + """
    SELECT split_key, CAST(idx AS DOUBLE) AS l_returnflag_idx FROM m JOIN ranked USING (l_returnflag)"""))
def index_target(spark: SparkSession, folder: str) -> DataFrame:
    rows, train = parts(spark, folder, "ml_lineitem", "split_key")
    model = ops.target_index(train, "l_returnflag")
    return model.transform(rows).select("split_key", "l_returnflag_idx")
