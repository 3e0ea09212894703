"""Reading tables, capping rows and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.columns import NESTED, named, type_class
from plumbline.functions.text import unit_hash
from plumbline.plans.ordering import first_rows

REJECT = "_rejected_line"


def read_csv(
    spark: SparkSession,
    path: str,
    filename: str | None = None,
    *,
    schema: StructType | str | None = None,
    nrows: int | None = None,
    order_by: Sequence[str] = (),
    sampling_ratio: float | None = None,
) -> DataFrame:
    """CSV with a header, from a path or a folder plus a file name.

    Without ``schema`` the types are inferred, which costs a pass over the text;
    ``sampling_ratio`` shortens that pass. ``nrows`` of 0 or None keeps all rows.
    """
    if filename:
        path = path.strip().rstrip("/") + "/" + filename.strip()
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
    return row_cap(reader.csv(path), nrows, order_by)


def read_csv_checked(
    spark: SparkSession, path: str, schema: StructType | str, filename: str | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The lines of a CSV that fit a schema as rows, and the others as rejects: file, line, reason.

    The reasons are ``short`` and ``long`` (too few and too many fields) and ``type`` (a field that is no
    value of its column). Each line of the file that holds data is in one of the two tables.
    """
    if filename:
        path = path.strip().rstrip("/") + "/" + filename.strip()
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*wanted.fields, StructField(REJECT, StringType())])
    found = spark.read.schema(whole).option("header", header).option("columnNameOfCorruptRecord", REJECT).csv(path)
    # Which lines fit is known once all fields are read, also for a count: a condition that always holds asks for them.
    found = found.where(F.pmod(F.xxhash64(*(named(f.name) for f in wanted.fields)), F.lit(2)) < 2)
    rejected = F.col(REJECT).isNotNull()
    rows = found.where(~rejected).select(*(named(f.name) for f in wanted.fields))
    # The line as text fields, and with one field to spare, shows whether its length or a value is wrong.
    width = len(wanted.fields)

    def as_text(n: int) -> Column:
        names = ", ".join([*(f"`f{i}` string" for i in range(n)), f"`{REJECT}` string"])
        return F.from_csv(F.col(REJECT), names, {"columnNameOfCorruptRecord": REJECT, "mode": "PERMISSIVE"})

    exact, wider = as_text(width), as_text(width + 1)
    longer = wider[REJECT].isNull() | wider[f"f{width}"].isNotNull() | wider[f"f{width - 1}"].isNotNull()
    reason = F.when(exact[REJECT].isNull(), "type").when(longer, "long").otherwise("short")
    lines = found.select(F.col("_metadata.file_path").alias("file"), *(named(c) for c in found.columns)).where(rejected)
    return rows, lines.select("file", F.col(REJECT).alias("line"), reason.alias("reason"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def row_cap(df: DataFrame, nrows: int | None, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``nrows`` rows in the given order, else in that of the columns from left to right.

    So the same rows come back whatever the partitions. 0 or None keeps all rows.
    """
    if not nrows or nrows < 0:
        return df
    simple = [f.name for f in df.schema.fields if type_class(f.dataType) != NESTED]
    return first_rows(df, list(order_by) or simple, nrows)


def random_sample(df: DataFrame, fraction: float = 0.1, seed: int | None = None) -> DataFrame:
    """Bernoulli sample without replacement; depends on how the table is partitioned."""
    return df.sample(False, fraction, seed)


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float = 0.1, seed: int | str = 42) -> DataFrame:
    """Sample that depends on the key values only, so that reruns agree."""
    return df.where(unit_hash(*(named(k) for k in keys), seed=seed) < fraction)
