"""The numbers behind each chart, computed over the full table."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import is_missing, named, number, numeric_columns
from plumbline.operators.summaries import top_values
from plumbline.plans.quantiles import group_quantiles, quantiles
from plumbline.plans.stats import one_row_per, table_stats
from plumbline.sources.tables import hash_sample

KDE_BINS = 1_000
KDE_CUT = 3.0  # how many bandwidths the curve runs past the data
#: Sums that one task merges at a level of the tree.
MERGED_PARTS = 8


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number; the highest value falls in the last bin, NULL in none."""
    place = F.floor(F.try_divide(value - low, (high - low) / F.lit(float(bins))))
    return F.when(value.isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Count and edges of each bin, empty bins included; NULL and NaN left out."""
    x = number(df, column)
    reach = table_stats(df, low=F.min(x), high=F.max(x))
    counts = (
        df.select(x.alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy(bin_of(F.col("x"), reach["low"], reach["high"], bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (reach["high"] - reach["low"]) / F.lit(float(bins))
    # Never more rows than bins: safe to broadcast.
    return (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            (reach["low"] + F.col("bin") * width).alias("bin_start"),
            (reach["low"] + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n_rows"),
        )
    )


def _curve(points: DataFrame, by: Sequence[str], grid: int) -> DataFrame:
    """Gaussian kernel curve from weighted points that carry their group's statistics.

    ``points`` has at most ``KDE_BINS`` rows per group, whatever the table size.
    """
    bandwidth = F.col("spread") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    start, end = F.col("low") - KDE_CUT * bandwidth, F.col("high") + KDE_CUT * bandwidth
    x = start + F.col("grid_point") * (end - start) / F.lit(float(grid - 1))
    z = (F.col("x") - F.col("at")) / F.col("bandwidth")
    scale = F.col("total") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    return (
        points.where(F.col("spread") > 0)
        .withColumn("grid_point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumns({"bandwidth": bandwidth, "x": x})
        .groupBy(*by, "grid_point", "x")
        .agg(F.sum(F.col("weight") * F.exp(-0.5 * z * z) / scale).alias("density"))
    )


def _shape(value: Column) -> dict[str, Column]:
    return {
        "low": F.min(value),
        "high": F.max(value),
        "spread": F.stddev(value),
        "total": F.count(value),
    }


def kde(df: DataFrame, column: str, grid: int = 200, bins: int = KDE_BINS) -> DataFrame:
    """Density curve with Scott's bandwidth; values are merged into fine bins at their mean."""
    x = number(df, column)
    shape = table_stats(df, **_shape(x))
    points = (
        df.select(x.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(bin_of(F.col("v"), shape["low"], shape["high"], bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("weight"), F.avg("v").alias("at"))
        .select("weight", "at", *(shape[n].alias(n) for n in ("low", "high", "spread", "total")))
    )
    return _curve(points, [], grid)


def _shapes(values: DataFrame) -> Column:
    """Statistics that the curves of columns v0, v1, ... need, from one scan."""
    return table_stats(values, **{f"{n}{c[1:]}": e for c in values.columns for n, e in _shape(F.col(c)).items()})


def _curves(values: DataFrame, names: Sequence[str], shape: Column, grid: int, bins: int = KDE_BINS) -> DataFrame:
    """The ``kde`` of each of the columns v0, v1, ...: one more scan for all of them."""
    fine = F.array(
        *(
            F.struct(
                F.lit(i).alias("place"),
                bin_of(F.col(f"v{i}"), shape[f"low{i}"], shape[f"high{i}"], bins).alias("bin"),
                F.col(f"v{i}").alias("v"),
            )
            for i in range(len(names))
        )
    )
    shapes = F.array(
        *(
            F.struct(F.lit(name).alias("column_name"), *(shape[f"{n}{i}"].alias(n) for n in ("low", "high", "spread", "total")))
            for i, name in enumerate(names)
        )
    )
    points = (
        values.select(F.inline(fine))
        .where(F.col("bin").isNotNull())
        .groupBy("place", "bin")
        .agg(F.count(F.lit(1)).alias("weight"), F.avg("v").alias("at"))
        .withColumn("shape", F.get(shapes, F.col("place")))
        .select("weight", "at", "shape.*")
    )
    return _curve(points, ["column_name"], grid)


def box_stats(df: DataFrame, column: str, relative_error: float = 0.0) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and the number of points beyond."""
    found = quantiles(df, [column], [0.25, 0.5, 0.75], relative_error)[column]
    q1, median, q3 = (F.lit(q).cast("double") for q in found or [None] * 3)
    x = number(df, column)
    reach = (q3 - q1) * 1.5
    inside = (x >= q1 - reach) & (x <= q3 + reach)
    return df.agg(
        F.count(x).alias("n_values"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    ).select(
        "n_values", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "whisker_low", "whisker_high", "n_outliers"
    )


def _merged_moments(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Moments of two parts of a table: count, mean, squared deviations and co-deviations, each for all pairs."""
    if a is None:
        return b
    n = a[0] + b[0]
    share = np.divide(a[0] * b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    mean = a[1] + np.divide(apart * b[0], n, out=np.zeros_like(n), where=n > 0)
    return np.stack([n, mean, a[2] + b[2] + apart**2 * share, a[3] + b[3] + apart * apart.T * share])


def _moments(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moments of every column over the rows where every other one is filled, as products with the mask."""
    mask = (~np.isnan(x)).astype(float)
    y = np.where(mask > 0, x - shift, 0.0)
    n, total = mask.T @ mask, y.T @ mask
    mean = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
    return np.stack([n, shift[:, None] + mean, (y * y).T @ mask - total * mean, y.T @ y - total * mean.T])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation of all numeric columns, in long form; NULL where one is constant.

    One scan for any number of columns: each task sums products of its rows and of their masks, and the sums
    merge in a tree whose last task writes the result.
    """
    columns = list(columns or numeric_columns(df))
    width = len(columns)
    values = F.array(*(number(df, c) for c in columns)).alias("v")

    def row(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        data = b"" if total is None else total.tobytes()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = None, None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(flat):
                if shift is None:  # near the mean, so that squares lose nothing
                    shift = np.nan_to_num(flat[0], posinf=0.0, neginf=0.0)
                total = _merged_moments(total, _moments(flat.astype(float), shift))
        return row(total)

    def gathered(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for data in batch.column(1).to_pylist():
                if data:
                    total = _merged_moments(total, np.frombuffer(data).reshape(4, width, width))
        return total

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = gathered(batches)
        found = np.full((width, width), np.nan)
        if total is not None:
            spread = np.sqrt(total[2]) * np.sqrt(total[2].T)
            found = np.divide(total[3], spread, out=found, where=spread > 0)
            np.fill_diagonal(found, np.where(np.diag(spread) > 0, 1.0, np.nan))
        for i in range(width):
            line = [[columns[i]] * width, columns, pa.array(found[i], mask=np.isnan(found[i]))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, line[:2]), line[2]], ["x", "y", "pearson_r"])

    schema = "part int, data binary"
    parts = df.select(values).mapInArrow(leaves, schema)
    # One empty part, so that a table without rows has a result too.
    parts = parts.unionByName(df.sparkSession.sql("SELECT -1 AS part, binary('') AS data"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while (tasks := -(-tasks // MERGED_PARTS)) > 1:
        parts = parts.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lambda b: row(gathered(b)), schema)
    return parts.repartition(1).sortWithinPartitions("part").mapInArrow(last, "x string, y string, pearson_r double")


def scatter_sample(
    df: DataFrame, x: str, y: str, keys: Sequence[str], fraction: float = 0.1, seed: int | str = 42
) -> DataFrame:
    """Reproducible sample of points."""
    return hash_sample(df, keys, fraction, seed).select(*(named(k) for k in keys), named(x), named(y))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """All points, as counts on a grid; empty cells are left out."""
    a, b = number(df, x), number(df, y)
    full = df.select(a.alias("a"), b.alias("b")).dropna()
    reach = table_stats(full, a0=F.min("a"), a1=F.max("a"), b0=F.min("b"), b1=F.max("b"))
    return full.groupBy(
        bin_of(F.col("a"), reach["a0"], reach["a1"], bins).alias("x_bin"),
        bin_of(F.col("b"), reach["b0"], reach["b1"], bins).alias("y_bin"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def pair_data(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20, grid: int = 50) -> DataFrame:
    """Point density of each column pair and the density curve of each column.

    Takes all numeric columns unless told otherwise. ``value`` is a row
    count off the diagonal and a density on it, where ``y_bin`` is NULL.
    """
    columns = list(columns or numeric_columns(df))
    values = df.select(*(number(df, c).alias(f"v{i}") for i, c in enumerate(columns)))
    shape = _shapes(values)
    binned = values.select(
        *(
            bin_of(F.col(f"v{i}"), shape[f"low{i}"], shape[f"high{i}"], bins).alias(f"b{i}")
            for i in range(len(columns))
        )
    )
    cells = F.array(
        *(
            F.struct(
                F.lit(columns[i]).alias("x"),
                F.lit(columns[j]).alias("y"),
                F.col(f"b{i}").alias("x_bin"),
                F.col(f"b{j}").alias("y_bin"),
            )
            for i, j in combinations(range(len(columns)), 2)
        )
    )
    # Each task merges to at most bins x bins rows for each pair before the shuffle.
    density = (
        binned.select(F.inline(cells))
        .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x", "y", "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    diagonal = _curves(values, columns, shape, grid).select(
        F.col("column_name").alias("x"),
        F.col("column_name").alias("y"),
        F.col("grid_point").alias("x_bin"),
        F.lit(None).cast("int").alias("y_bin"),
        F.col("density").alias("value"),
    )
    return density.unionByName(diagonal)


def missing_matrix(df: DataFrame, order_column: str, buckets: int = 50) -> DataFrame:
    """Share of missing cells per column and slice of the table, slices along a numeric column.

    Rows without a value in that column are slice NULL.
    """
    place = number(df, order_column)
    reach = table_stats(df, low=F.min(place), high=F.max(place))
    fields = df.schema.fields
    rates = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.count_if(is_missing(f)).alias("missing_count"),
                (F.count_if(is_missing(f)) / F.count(F.lit(1))).alias("missing_rate"),
            )
            for f in fields
        )
    )
    return (
        df.groupBy(bin_of(place, reach["low"], reach["high"], buckets).alias("slice"))
        .agg(rates.alias("rates"))
        .select("slice", F.inline("rates"))
    )


def _top_categories(df: DataFrame, category: str, n: int) -> list[object]:
    """The most frequent categories, at most ``n`` values; NULL is no category."""
    return [r[0] for r in top_values(df.where(named(category).isNotNull()), category, n).collect()]


def violin_data(
    df: DataFrame, category: str, value: str, top_n: int = 20, grid: int = 50, bins: int = 200
) -> DataFrame:
    """Density curve and quartiles of a value for each of the top categories.

    A category whose values are all equal, or has one or none, is one row with a NULL curve.
    """
    top = _top_categories(df, category, top_n)
    every = df.where(named(category).isin(*top)).select(named(category).alias("category"), number(df, value).alias("v"))
    rows = every.where(F.col("v").isNotNull())
    quartiles = group_quantiles(rows, "category", "v", [0.25, 0.5, 0.75])
    # One row for each of at most top_n categories: safe to broadcast.
    shapes = every.groupBy("category").agg(*(e.alias(n) for n, e in _shape(F.col("v")).items()))
    points = (
        rows.join(F.broadcast(shapes), "category")
        .groupBy("category", "low", "high", "spread", "total", bin_of(F.col("v"), F.col("low"), F.col("high"), bins))
        .agg(F.count(F.lit(1)).alias("weight"), F.avg("v").alias("at"))
    )
    curve = shapes.select("category", "total").join(_curve(points, ["category"], grid), "category", "left")

    # The quartiles of at most top_n categories travel as a small constant map.
    by_category = F.create_map(
        *(x for t, q in quartiles.items() for x in (F.lit(t), F.array(*(F.lit(v) for v in q))))
    )
    quartile = F.try_element_at(by_category, F.col("category")) if quartiles else F.lit(None).cast("array<double>")
    return curve.select(
        "category",
        F.col("total").alias("n_values"),
        quartile[0].alias("q1"),
        quartile[1].alias("median"),
        quartile[2].alias("q3"),
        "grid_point",
        "x",
        "density",
    )


def stacked_bar_data(df: DataFrame, category: str, values: Sequence[str], top_n: int = 20) -> DataFrame:
    """Mean of each value column for the most frequent categories."""
    top = _top_categories(df, category, top_n)
    return (
        df.where(named(category).isin(*top))
        .groupBy(named(category).alias(category))
        .agg(*(F.avg(number(df, v)).alias(v) for v in values))
    )
