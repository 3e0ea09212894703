"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers floor(scale * c) + shift. The leading components of their
covariance V are found without forming V: a pass over the table sums centred XᵀXQ for a
block Q of ``BLOCK`` columns, one small matrix a task, merged in a second level of tasks
before the driver adds the few that are left. Per round, Rayleigh-Ritz in the block gives
values, vectors and residuals; then a Chebyshev polynomial of V, built by its recurrence
from such passes, damps the spectrum between a lower bound (from a few Lanczos passes) and
the smallest value of the block; QR makes the block orthonormal again. Rounds end when
the residuals of the wanted components reach double precision. A filtered block of fresh
random columns, orthogonal to these, must then hold no larger value, else it joins the
block and the rounds go on.

Sums are exact integers, and x - S/n is formed from the exact integer part, so centring
loses nothing. The driver holds matrices of dimension times block only.

Results in the odd cases: vectors that are null, empty, or hold null or non-finite
entries (or ones beyond 2**61 when scaled) are dropped, as are those whose length is
not the most frequent one (of equally frequent ones the longest); repeated rows and null
ids are kept; an empty table gives an empty result. Components are at most as many as
dimensions; one without variance has null in ``whitened``; ``explained`` is null when
all vectors are equal, and ``identity_error`` then too; ``deviation`` is null where it is
no 64-bit integer. Only id and vector are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, shuffle_partitions

COMPONENTS, BLOCK = 8, 32
#: Passes that bound the spectrum from below, and the highest degree of a filter.
LANCZOS, DEGREE = 8, 24
#: Residual, relative to the largest value, that counts as double precision.
TOLERANCE = 1e-13
#: Bytes of vectors in one row of the stored table.
ROW_BYTES = 2**21
_LOW = np.int64(2**32)


def _integers(column: pa.Array, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer matrix of the usable vectors of a batch, for each length they have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(math.nan))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        good = np.abs(scaled) <= 2.0**61  # false for NaN too
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(row[~good], minlength=len(sizes)) > 0
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[(sizes > 0) & ~bad]).tolist():
        rows = np.flatnonzero((sizes == size) & ~bad)
        yield rows, scaled[begins[rows][:, None] + np.arange(size)].astype(np.int64) + shift


def stored(rows: DataFrame, id_column: str, vector_column: str, scale: float, shift: int) -> DataFrame:
    """The usable vectors as integers, many to a row: ids, width, count, x (32-bit integers where they fit)."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _integers(batch.column(1), scale, shift):
                step = max(1, ROW_BYTES // (8 * x.shape[1]))
                for a in range(0, len(at), step):
                    part = x[a : a + step]
                    small = part.min() >= -(2**31) and part.max() < 2**31
                    data = part.astype("<i4" if small else "<i8").tobytes()
                    ids = batch.column(0).take(pa.array(at[a : a + step]))
                    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    cells = [ids, pa.array([x.shape[1]], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["ids", "width", "n", "x"])

    vector = F.col(f"`{vector_column}`").cast("array<double>")
    table = rows.select(rows[id_column].alias("id"), vector.alias("v")).where("v is not null")
    return checkpointed(table.mapInArrow(run, f"ids array<{kind}>, width int, n int, x binary"))


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * rows * width else "<i8"
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Integer matrices of a stored table of the columns width, n, x."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield _matrix(batch.column(2)[r].as_py(), batch.column(1)[r].as_py(), batch.column(0)[r].as_py())


def _carried(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums kept as two integers, the lower one below 2**32."""
    return np.stack([high + low // _LOW, low % _LOW])


def _summed(table: DataFrame, task: Callable[[Iterator[np.ndarray]], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The arrays that ``task`` makes of the matrices of each task, added in a tree; none for an empty table."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = task(_matrices(batches))
        if found is not None:
            part = TaskContext.get().partitionId()
            cells = [pa.array([part], pa.int32()), pa.array([str(found.dtype)]), pa.array([list(found.shape)], pa.list_(pa.int32())), pa.array([found.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["part", "kind", "shape", "data"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first = None, None
        for frame in batches:
            for part, kind, shape, data in frame.itertuples(index=False):
                found = np.frombuffer(data, kind).reshape(shape)
                total, first = (found, part) if total is None else (add(total, found), first)
        if total is not None:
            yield pd.DataFrame({"part": [first], "kind": [str(total.dtype)], "shape": [list(total.shape)], "data": [total.tobytes()]})

    schema = "part int, kind string, shape array<int>, data binary"
    sums = table.select("width", "n", "x").mapInArrow(leaves, schema)
    middle = max(1, math.isqrt(shuffle_partitions(table)))
    sums = sums.repartition(middle, "part").sortWithinPartitions("part").mapInPandas(merged, schema)
    total = None
    for r in sorted(sums.collect(), key=lambda r: r["part"]):  # at most ``middle`` arrays
        found = np.frombuffer(r["data"], r["kind"]).reshape(r["shape"])
        total = found if total is None else add(total, found)
    return total


@dataclass
class Centre:
    """Exact mean of integer vectors: whole + rest / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x - mean."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact; none where it is no 64-bit integer."""
        apart = x - self.whole
        largest = (np.abs(apart).max(initial=0).item() + 1) * self.n
        if largest**2 * x.shape[1] < 2**63:
            return ((apart * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in apart]
        return [v if v < 2**63 else None for v in exact]


def centre(table: DataFrame) -> Centre | None:
    def task(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        n, total = 0, None
        for x in matrices:
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & (2**32 - 1)).sum(axis=0)
            total = _carried(high, low) if total is None else _carried(total[0] + high, total[1] + low)
        return None if total is None else np.c_[total, [[0], [n]]]

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a + b
        return np.c_[_carried(both[0, :-1], both[1, :-1]), both[:, -1:]]

    found = _summed(table, task, add)
    if found is None:
        return None
    n = int(found[1, -1])
    sums = [int(h) * 2**32 + int(low) for h, low in found[:, :-1].T]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


class Spectrum:
    """Products of the covariance of a stored table with blocks of columns, one pass each."""

    def __init__(self, table: DataFrame, middle: Centre):
        self.table, self.centre, self.size = table, middle, len(middle.whole)

    def _pass(self, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        middle = self.centre

        def task(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in matrices:
                part = made(middle.apart(x))
                total = part if total is None else total + part
            return total

        return _summed(self.table, task, np.add) / middle.n

    def times(self, block: np.ndarray) -> np.ndarray:
        return self._pass(lambda y: y.T @ (y @ block))

    def trace(self) -> float:
        return float(self._pass(lambda y: (y * y).sum(axis=0)).sum())

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the projected rows, centred by their own mean."""

        def made(y: np.ndarray) -> np.ndarray:
            w = y @ projection
            return np.r_[w.T @ w, w.sum(axis=0)[None]]

        found = self._pass(made)
        return found[:-1] - np.outer(found[-1], found[-1])

    def lower_bound(self, rng: np.random.Generator) -> float:
        """A number that few or no eigenvalues lie below, from Lanczos steps; 0 bounds every covariance."""
        basis, alpha, beta = [], [], []
        v = rng.standard_normal(self.size)
        for _ in range(min(LANCZOS, self.size)):
            basis.append(v / np.linalg.norm(v))
            v = self.times(basis[-1][:, None])[:, 0]
            alpha.append(float(basis[-1] @ v))
            for _ in range(2):
                v = v - np.stack(basis, axis=1) @ (np.stack(basis) @ v)
            beta.append(float(np.linalg.norm(v)))
            if beta[-1] <= 1e-10 * max(map(abs, alpha)):
                break
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
        return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))

    def filtered(self, block: np.ndarray, product: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
        """A polynomial of the covariance times the block: small on [low, high], near 1 at ``top``.

        ``product`` is the covariance times the block, known already.
        """
        mid, half = (high + low) / 2, max((high - low) / 2, 1e-9 * top)
        first = sigma = half / (top - mid)
        last, now = block, (product - mid * block) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            last, now = now, (self.times(now) - mid * now) * (2 * following / half) - last * (sigma * following)
            sigma = following
        return now


def _degree(values: np.ndarray, wanted: int, low: float) -> int:
    """Degree that amplifies the last wanted value well, and keeps it above rounding beside the first."""
    high, top = values[-1], values[0]
    mid, half = (high + low) / 2, max((high - low) / 2, 1e-9 * top)
    most, least = (math.acosh(max(1 + 1e-9, (values[k] - mid) / half)) for k in (0, wanted - 1))
    enough = math.log(2e8) / least
    safe = math.log(1e9) / max(most - least, 1e-9)
    return int(max(2, min(DEGREE, enough, safe)))


def leading(spectrum: Spectrum, wanted: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns, certified."""
    rng, size = np.random.default_rng(seed), spectrum.size
    wanted, block = min(wanted, size), min(block, size)
    low = spectrum.lower_bound(rng) if block < size else 0.0
    basis = np.linalg.qr(rng.standard_normal((size, block)))[0] if block < size else np.eye(size)
    best, checked = math.inf, False
    while True:
        product = spectrum.times(basis)
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, product = basis @ turn, product @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(wanted), basis[:, :wanted]
        apart = product[:, :wanted] - basis[:, :wanted] * values[:wanted]
        residual = float(np.linalg.norm(apart, axis=0).max()) / top
        exact = residual <= TOLERANCE or (residual <= 1e-10 and residual > best / 2)  # or as far as rounding lets it come
        if exact and (checked or block == size):
            return values[:wanted], basis[:, :wanted]
        best = min(best, residual)
        high = max(float(values[-1]), low)
        degree = _degree(np.maximum(values, high), wanted, low)
        if not exact:
            basis = np.linalg.qr(spectrum.filtered(basis, product, low, high, top, degree))[0]
            continue
        # A fresh block, orthogonal to what was found, must hold nothing larger.
        found = basis[:, :wanted]
        fresh = rng.standard_normal((size, min(COMPONENTS, size - wanted)))
        fresh = np.linalg.qr(fresh - found @ (found.T @ fresh))[0]
        fresh = spectrum.filtered(fresh, spectrum.times(fresh), low, high, top, degree)
        fresh = np.linalg.qr(fresh - found @ (found.T @ fresh))[0]
        largest = float(np.linalg.eigvalsh(fresh.T @ spectrum.times(fresh))[-1])
        checked = True
        if largest > values[wanted - 1] * (1 + 1e-9):
            basis = np.linalg.qr(np.c_[found, fresh, basis[:, wanted:]])[0][:, : basis.shape[1]]
            best, checked = math.inf, False
        else:
            return values[:wanted], found


def whiten(
    rows: DataFrame,
    components: int = COMPONENTS,
    scale: float = 1024.0,
    shift: int = 100_000,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """One row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = stored(rows, id_column, vector_column, scale, shift)
    widths = table.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    table = table.where(F.col("width") == widths[0]["width"])
    middle = centre(table)
    spectrum = Spectrum(table, middle)
    values, vectors = leading(spectrum, components, block, seed)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    trace = spectrum.trace()
    varies = values > 64 * np.finfo(float).eps * trace
    projection = vectors / np.sqrt(np.where(varies, values, 1))
    explained = [float(v) / trace for v in values] if trace > 0 else [None] * len(values)
    error = None
    if varies.any():
        seen = spectrum.covariance_of(projection[:, varies])
        error = float(np.abs(seen - np.eye(int(varies.sum()))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            for r in range(batch.num_rows):
                width, count, data = (batch.column(c)[r].as_py() for c in (1, 2, 3))
                x = _matrix(data, count, width)
                ids = batch.column(0).slice(r, 1).flatten()
                white = middle.apart(x) @ projection
                each = np.repeat(np.arange(count), k)
                cells = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, middle.n)),
                    pa.array(middle.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(white.reshape(-1), mask=np.tile(~varies, count)),
                    pa.array(explained * count, pa.float64()),
                    pa.array([error] * (count * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cells, [f.split(" ")[0] for f in schema.split(", ")])

    return table.select("ids", "width", "n", "x").mapInArrow(run, schema).withColumnRenamed("id", id_column)
