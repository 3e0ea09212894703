"""Exact quantiles whose memory need does not grow with the table.

The built-in exact ``percentile`` keeps every distinct value in one task. Here a
rank is read off the value counts of a bracket known to hold it, once few enough
rows lie strictly inside that bracket. Until then it is narrowed: an approximate
sketch of a sample proposes two values, exact counts over the whole table verify
that the rank lies between them, and the next round looks only inside. A wrong
proposal costs a round, never a result; a hot value is one row of value counts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import named, number

#: Rows strictly inside a bracket when its value counts are read off; wider ones are narrowed first.
SMALL_ROWS = 20_000
SAMPLE_ROWS = 4_000_000
SKETCH_ACCURACY = 10_000

SERIES, VALUE = "series", "value"


@dataclass
class _Rank:
    """One wanted rank of a series and the bracket ``[low, high]`` known to hold it."""

    series: object
    position: float
    rows: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    between: int = 0

    def __post_init__(self) -> None:
        self.inside = self.between = self.rows

    @property
    def first(self) -> int:
        return math.floor(self.position)

    @property
    def last(self) -> int:
        return math.ceil(self.position)

    @property
    def pinned(self) -> bool:
        return self.low is not None and self.low == self.high

    def limits(self) -> tuple[float, float]:
        """The bracket with open ends as infinities; NaN, which is above them, is left out of all series."""
        return -math.inf if self.low is None else self.low, math.inf if self.high is None else self.high

    def settle(self, low: float, high: float, less: int, upto: int, between: int) -> None:
        """Take over a proposed bracket as far as counts of the rows inside the present one prove it."""
        end = self.below + self.inside
        below, upto = self.below + less, self.below + upto
        low_ok, high_ok = below <= self.first, self.last < upto
        if low_ok:
            self.low, self.below = low, below
        if high_ok:
            self.high, end = high, upto
        self.inside = end - self.below
        self.between = between if low_ok and high_ok else self.inside


class _Columns:
    """Series that are columns of one table: each rank looks at its own column, all in one scan."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.rows = df.select(*(number(df, c).alias(f"v{i}") for i, c in enumerate(columns)))
        self.names = range(len(columns))

    def sizes(self) -> dict[object, int]:
        row = self.rows.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in self.names)).first()
        return {i: row[f"n{i}"] for i in self.names if row[f"n{i}"]}

    @staticmethod
    def _holds(rank: _Rank) -> Column:
        """The row lies in the rank's bracket; plain comparisons, which reach a columnar source."""
        value = F.col(f"v{rank.series}")
        tests = [value.isNotNull()] if rank.low is None and rank.high is None else []
        tests += [value >= F.lit(rank.low)] if rank.low is not None else []
        tests += [value <= F.lit(rank.high)] if rank.high is not None else []
        return reduce(Column.__and__, tests)

    def _inside(self, ranks: list[_Rank]) -> DataFrame:
        return self.rows.where(reduce(Column.__or__, map(self._holds, ranks)))

    def propose(self, ranks: list[_Rank], probs: list[list[float]], fraction: float, seed: int) -> list[list[float] | None]:
        rows = self._inside(ranks)
        sample = rows if fraction == 1.0 else rows.sample(False, fraction, seed)
        inside = (F.when(self._holds(r), F.col(f"v{r.series}")) for r in ranks)
        found = sample.agg(*(F.percentile_approx(v, p, SKETCH_ACCURACY).alias(f"p{i}") for i, (v, p) in enumerate(zip(inside, probs))))
        return list(found.first())

    def count(self, ranks: list[_Rank], ends: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
        counts = []
        for i, (rank, (low, high)) in enumerate(zip(ranks, ends)):
            value, held = F.col(f"v{rank.series}"), self._holds(rank)
            counts += [
                F.count_if(held & (value < F.lit(low))).alias(f"less{i}"),
                F.count_if(held & (value <= F.lit(high))).alias(f"upto{i}"),
                F.count_if(held & (value > F.lit(low)) & (value < F.lit(high))).alias(f"between{i}"),
            ]
        row = self._inside(ranks).agg(*counts).first()
        return [(row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i in range(len(ranks))]

    def values(self, brackets: list[_Rank]) -> DataFrame:
        cells = [
            F.struct(F.when(self._holds(r), F.lit(i)).alias("bracket"), F.col(f"v{r.series}").alias(VALUE))
            for i, r in enumerate(brackets)
        ]
        return self._inside(brackets).select(F.inline(F.array(*cells))).where(F.col("bracket").isNotNull())


class _Groups:
    """Series that are groups of one column: a row meets the ranks of its own group by a join.

    There are a few groups, and a rank is two numbers: the ranks are broadcast.
    """

    def __init__(self, df: DataFrame, group: str, column: str):
        self.rows = df.select(named(group).alias(SERIES), number(df, column).alias(VALUE)).dropna()
        self.kind = self.rows.schema[SERIES].dataType

    def sizes(self) -> dict[object, int]:
        return dict(self.rows.groupBy(SERIES).agg(F.count(F.lit(1))).collect())

    def _joined(self, ranks: list[_Rank], ends: list[tuple[float, float]] | None = None) -> DataFrame:
        fields = [(SERIES, self.kind), ("bracket", T.IntegerType())]
        fields += [(n, T.DoubleType()) for n in ("bottom", "top", "low", "high")]
        lines = [(r.series, i, *r.limits(), *(ends[i] if ends else r.limits())) for i, r in enumerate(ranks)]
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        table = F.broadcast(self.rows.sparkSession.createDataFrame(lines, schema))
        return self.rows.join(table, SERIES).where((F.col(VALUE) >= F.col("bottom")) & (F.col(VALUE) <= F.col("top")))

    def propose(self, ranks: list[_Rank], probs: list[list[float]], fraction: float, seed: int) -> list[list[float] | None]:
        # Every rank reads its own two places off one sketch of its bracket.
        places = sorted({p for own in probs for p in own})
        rows = self._joined(ranks)
        sample = rows if fraction == 1.0 else rows.sample(False, fraction, seed)
        found = sample.groupBy("bracket").agg(F.percentile_approx(VALUE, places, SKETCH_ACCURACY)).collect()
        sketches = {bracket: dict(zip(places, values)) for bracket, values in found}
        return [[sketches[i][p] for p in own] if i in sketches else None for i, own in enumerate(probs)]

    def count(self, ranks: list[_Rank], ends: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
        value, low, high = F.col(VALUE), F.col("low"), F.col("high")
        counted = self._joined(ranks, ends).groupBy("bracket").agg(
            F.count_if(value < low), F.count_if(value <= high), F.count_if((value > low) & (value < high))
        )
        found = {r[0]: (r[1], r[2], r[3]) for r in counted.collect()}
        return [found.get(i, (0, 0, 0)) for i in range(len(ranks))]

    def values(self, brackets: list[_Rank]) -> DataFrame:
        return self._joined(brackets).select("bracket", VALUE)


def _narrow(series: _Columns | _Groups, ranks: list[_Rank], sample_rows: int, seed: int) -> None:
    fraction = min(1.0, sample_rows / min(r.inside for r in ranks))
    probs = []
    for rank in ranks:
        seen = max(fraction * rank.inside, 1.0)
        margin = 2.0 / SKETCH_ACCURACY + 2.0 / seen + (2.0 / math.sqrt(seen) if fraction < 1.0 else 0.0)
        span = max(rank.inside - 1, 1)
        low, high = ((place - rank.below) / span for place in (rank.first, rank.last))
        probs.append([max(0.0, low - margin), min(1.0, high + margin)])
    proposed = series.propose(ranks, probs, fraction, seed)
    ends = [tuple(p) if p else r.limits() for r, p in zip(ranks, proposed)]
    for rank, pair, counts in zip(ranks, ends, series.count(ranks, ends)):
        rank.settle(*pair, *counts)


def _read_off(series: _Columns | _Groups, ranks: list[_Rank]) -> list[tuple[float, float]]:
    """Values at the two whole ranks around each position, from value counts.

    Only bracketed values reach the window, so it sees a bounded number of rows.
    """
    brackets = {(r.series, r.low, r.high): r for r in ranks}
    number_of = {key: i for i, key in enumerate(brackets)}
    counted = series.values(list(brackets.values())).groupBy("bracket", VALUE).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("bracket").orderBy(VALUE))
    places = {
        (number_of[r.series, r.low, r.high], place - r.below) for r in ranks for place in (r.first, r.last)
    }
    # As many rows as wanted places: safe to broadcast and to collect.
    wanted = F.broadcast(counted.sparkSession.createDataFrame(sorted(places), "bracket int, place bigint"))
    hits = (
        counted.withColumn("upto", upto)
        .join(wanted, "bracket")
        .where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("rows")))
        .select("bracket", "place", VALUE)
    )
    found = {(b, p): v for b, p, v in hits.collect()}
    return [
        tuple(found[number_of[r.series, r.low, r.high], place - r.below] for place in (r.first, r.last)) for r in ranks
    ]


def _by_narrowing(
    series: _Columns | _Groups, probs: Sequence[float], small_rows: int, sample_rows: int
) -> dict[object, list[float]]:
    """Quantiles of each series that has values."""
    sizes = series.sizes()
    ranks = [_Rank(s, p * (n - 1), n) for s, n in sizes.items() for p in probs]
    for seed in itertools.count():
        wide = [r for r in ranks if r.between > small_rows and not r.pinned]
        if not wide:
            break
        _narrow(series, wide, sample_rows, seed)
    loose = [r for r in ranks if not r.pinned]
    ends = dict(zip(map(id, loose), _read_off(series, loose))) if loose else {}
    found: dict[object, list[float]] = {s: [] for s in sizes}
    for rank in ranks:
        a, b = (rank.low, rank.low) if rank.pinned else ends[id(rank)]
        found[rank.series].append(a + (b - a) * (rank.position - rank.first))
    return found


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    small_rows: int = SMALL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, list[float] | None]:
    """Interpolated quantiles of each column, NULL and NaN left out.

    Runs its small jobs at once, as ``approxQuantile`` does, and returns plain
    numbers: used as filter bounds they reach the Parquet scan. A pass reads all
    columns once, and its work grows with their number.
    """
    found = _by_narrowing(_Columns(df, columns), probs, small_rows, sample_rows) if columns else {}
    return {c: found.get(i) for i, c in enumerate(columns)}


def group_quantiles(
    df: DataFrame,
    group: str,
    column: str,
    probs: Sequence[float],
    *,
    small_rows: int = SMALL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[object, list[float]]:
    """Interpolated quantiles of a column within each of a few groups; any group may be hot."""
    return _by_narrowing(_Groups(df, group, column), probs, small_rows, sample_rows)


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], relative_error: float = 0.01
) -> dict[str, list[float] | None]:
    """Quantiles within ``relative_error`` of the rank, all columns in one job."""
    found = df.select(*(number(df, c).alias(f"v{i}") for i, c in enumerate(columns))).approxQuantile(
        [f"v{i}" for i in range(len(columns))], list(probs), relative_error
    )
    return {c: (f or None) for c, f in zip(columns, found)}


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], relative_error: float = 0.0
) -> dict[str, list[float] | None]:
    """Exact by default; a positive ``relative_error`` asks for one sketch pass."""
    if relative_error > 0:
        return approx_quantiles(df, columns, probs, relative_error)
    return exact_quantiles(df, columns, probs)
