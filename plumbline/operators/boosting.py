"""Second-order boosting of trees whose leaves hold one value for each class.

Features are cut into bins once. A level of a tree is one pass: each task sums first and
second derivatives of the loss by node, feature and bin, with numpy over blocks of binned
rows, and the sums meet by node and feature. One tree a round serves all classes, so there
is no loop over classes. Margins of the rows are kept between rounds and written to the
shared folder every few rounds, which cuts the lineage.

Two classes have one margin and the logistic loss; more classes have one margin each and
the softmax loss. A split must gain more than ``LEAST_GAIN`` and leave a sum of second
derivatives of ``LEAST_WEIGHT`` (mean over classes) on either side; of equal gains the
first feature and the lowest cut win. A missing (NaN) value goes right.

``lossType`` "newton" is the above. "logistic" (two classes) and "squared" (numbers) are
first-order boosting as Spark ML's gradient-boosted trees define it: a tree of least squares
follows the labels (-1 and 1 for classes) in the first round, with weight one, and in each
later round the residuals 4y / (1 + exp(2ym)) or 2(y - m) of the margins m, with weight
``stepSize``. Its sums are those of residuals and of rows; a leaf holds the mean residual.
Features of at most ``maxBins`` values are cut halfway between them, others at quantiles.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.keep import kept
from plumbline.plans.quantiles import approx_quantiles
from plumbline.session import ensure_checkpoint_dir

NEWTON, LOGISTIC, SQUARED = "newton", "logistic", "squared"
LEAST_GAIN, LEAST_WEIGHT, PENALTY = 1e-6, 1.0, 1.0
#: First-order boosting has no penalty (this keeps 0 / 0 at 0), and a gain counts above the rounding of its terms and labels.
NO_PENALTY, LEAST_SHARE, ROUNDING = 1e-300, 1e-11, 1e-13
BLOCK_ROWS = 16_384
#: Sums of a level that go to the driver at once; larger ones meet in tasks, one for each node and feature.
DRIVER_BYTES = 2**26
#: Rows of a task, unless there are cores for more tasks: tasks follow the rows, not the shuffle setting.
TASK_ROWS = 2**20
#: Rounds between two writes of the margins.
ROUNDS_PER_CHECKPOINT = 10


def derivatives(margins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """First derivatives of the loss by margin, the second ones below them; rows of the table are columns here."""
    if len(margins) == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([p - labels, np.maximum(p * (1 - p), 1e-16)])
    p = np.exp(margins - margins.max(axis=0))
    p /= p.sum(axis=0)
    both = np.concatenate([p, np.maximum(2 * p * (1 - p), 1e-16)])
    both[labels, np.arange(len(labels))] -= 1
    return both


def residuals(margins: np.ndarray, labels: np.ndarray, loss: str, first: bool) -> np.ndarray:
    """What a first-order tree follows, with a minus as first derivatives have, and ones below that count rows."""
    m = margins[0]
    if loss == SQUARED:
        wanted = (1 if first else 2) * (labels - m)
    else:
        y = 2.0 * labels - 1
        wanted = y if first else 4 * y / (1 + np.exp(np.minimum(2 * y * m, 700)))
    return np.stack([-wanted, np.ones(len(wanted))])


class Tree:
    """Nodes as in a heap: those below node i are 2i+1 and 2i+2. Feature -1 marks a leaf."""

    def __init__(self, depth: int, outputs: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1)
        self.cut = np.zeros(size, np.int64)
        self.threshold = np.zeros(size)
        self.value = np.zeros((size, outputs))

    def leaf(self, columns: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Node where each row ends, of features by rows; it goes left where its feature is at most the node's limit."""
        node = np.zeros(columns.shape[1], np.intp)
        waiting = [(0, np.arange(columns.shape[1]))]
        while waiting:
            at, rows = waiting.pop()
            f = self.feature[at]
            if f < 0:
                node[rows] = at
            elif len(rows):
                # The root has all rows, in their order.
                left = (columns[f] if at == 0 else columns[f][rows]) <= limits[at]
                waiting += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        return node


def _sums(bins: np.ndarray, node: np.ndarray, open_nodes: list[int], both: np.ndarray, n_bins: int) -> np.ndarray:
    """Derivatives by open node, feature, bin and output; the second ones behind the first ones."""
    place = np.full(max(int(node.max(initial=0)), *open_nodes) + 1, -1)
    place[open_nodes] = np.arange(len(open_nodes))
    at = place[node]
    rows = np.flatnonzero(at >= 0)
    if len(rows) < len(at):
        at, bins, both = at[rows], bins[:, rows], both[:, rows]
    base, size = at * n_bins, len(open_nodes) * n_bins
    out = np.empty((len(open_nodes), len(bins), n_bins, len(both)))
    for f, column in enumerate(bins):
        key = base + column
        for c, weights in enumerate(both):
            out[:, f, :, c] = np.bincount(key, weights, size).reshape(-1, n_bins)
    return out


def best_cuts(sums: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sums by bin and output: gain of the best cut, its bin (values up to it go left), and the sums left of it."""
    k = sums.shape[-1] // 2
    left = np.cumsum(sums, axis=-2)
    whole = left[..., -1:, :]
    right = whole - left

    def merit(part: np.ndarray) -> np.ndarray:
        return (part[..., :k] ** 2 / (part[..., k:] + penalty)).sum(axis=-1)

    gain = (merit(left) + merit(right) - merit(whole)) / 2
    heavy = np.minimum(left[..., k:].mean(axis=-1), right[..., k:].mean(axis=-1)) >= LEAST_WEIGHT
    gain = np.where(heavy, gain, -np.inf)
    top = gain.max(axis=-1, keepdims=True)
    first = np.argmax(gain >= top - 1e-9 * np.abs(np.where(np.isfinite(top), top, 0)), axis=-1)  # equal up to rounding
    best = np.take_along_axis(left, first[..., None, None], axis=-2)[..., 0, :]
    return top[..., 0], first, best


class _Rows:
    """Binned training rows as blocks: bins by feature, labels, and margins by output, as bytes."""

    def __init__(
        self,
        data: DataFrame,
        cuts: list[np.ndarray],
        outputs: int,
        count: int,
        loss: str = NEWTON,
        base: float = 0.0,
        largest: float = 1.0,
    ):
        self.loss, self.penalty, self.largest = loss, PENALTY if loss == NEWTON else NO_PENALTY, largest
        self.label_kind = "<f8" if loss == SQUARED else "<i4"
        self.width, self.outputs, self.n_bins = len(cuts), outputs, max([len(c) for c in cuts], default=0) + 1
        self.kind = "u1" if self.n_bins <= 256 else "u2"
        kind, width, label_kind = self.kind, self.width, self.label_kind

        def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                labels = batch.column(1).to_numpy().astype(label_kind)
                bins = np.stack([np.searchsorted(c, flat[:, f]).astype(kind) for f, c in enumerate(cuts)])
                blocks = [(bins[:, a : a + BLOCK_ROWS], labels[a : a + BLOCK_ROWS]) for a in range(0, len(labels), BLOCK_ROWS)]
                cells = [
                    pa.array([b.tobytes() for b, _ in blocks], pa.binary()),
                    pa.array([y.tobytes() for _, y in blocks], pa.binary()),
                    pa.array([np.full((len(y), outputs), base).tobytes() for _, y in blocks], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["bins", "labels", "margins"])

        cores = data.sparkSession.sparkContext.defaultParallelism
        self.parts = max(-(-count // TASK_ROWS), min(-(-count // BLOCK_ROWS), cores))
        table = data.mapInArrow(binned, "bins binary, labels binary, margins binary").repartition(self.parts)
        self.round = 0
        self.table = self.held = self._kept(table)
        self.before: DataFrame | None = None
        self.last, self.known, self.same = None, {}, set()

    def _kept(self, table: DataFrame) -> DataFrame:
        if self.round % ROUNDS_PER_CHECKPOINT == 0:
            return table.checkpoint(eager=True)
        return table.persist(StorageLevel.MEMORY_AND_DISK)

    def _blocks(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for cells in zip(*batch.columns):
                bins, labels, margins = (c.as_buffer() for c in cells)
                found = np.frombuffer(labels, self.label_kind)
                yield (
                    np.frombuffer(bins, self.kind).reshape(self.width, len(found)),
                    found,
                    np.frombuffer(margins).reshape(self.outputs, len(found)),
                )

    def _own(self) -> _Rows:
        """A copy for tasks, without the tables."""
        copy = object.__new__(_Rows)
        copy.width, copy.outputs, copy.n_bins, copy.kind = self.width, self.outputs, self.n_bins, self.kind
        copy.loss, copy.label_kind = self.loss, self.label_kind
        return copy

    def _wanted(self, margins: np.ndarray, labels: np.ndarray, first: bool) -> np.ndarray:
        """What the next tree sums over the rows."""
        return derivatives(margins, labels) if self.loss == NEWTON else residuals(margins, labels, self.loss, first)

    def add(self, tree: Tree) -> None:
        """Move the margins on by a tree. Where they are small, the same pass sums the new derivatives by its leaves.

        A next tree that begins with the same cuts then needs no pass of its own for these nodes.
        """
        own, values = self._own(), np.ascontiguousarray(tree.value.T)
        inner = [int(n) for n in np.flatnonzero(tree.feature >= 0)]
        leaves = [n for n in (0, *(2 * i + side for i in inner for side in (1, 2))) if tree.feature[n] < 0]
        shape = (len(leaves), self.width, self.n_bins, 2 * self.outputs)
        fused = self.parts * 8 * int(np.prod(shape)) <= DRIVER_BYTES

        def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, names = None, ["bins", "labels", "margins", "part", "sums"]
            for batch in batches:
                new = []
                for bins, labels, margins in own._blocks([batch]):
                    node = tree.leaf(bins, tree.cut)
                    margins = margins + values[:, node]
                    new.append(margins.tobytes())
                    if fused:
                        part = _sums(bins, node, leaves, own._wanted(margins, labels, False), own.n_bins)
                        total = part if total is None else np.add(total, part, out=total)
                none = [pa.nulls(len(new), pa.int32()), pa.nulls(len(new), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.binary()), *none], names)
            if total is not None:
                none = [pa.nulls(1, pa.binary())] * 3
                cells = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *cells], names)

        self.round += 1
        self.free()
        self.before = self.held
        table = self.table.mapInArrow(moved, "bins binary, labels binary, margins binary, part int, sums binary")
        self.held = self._kept(table)
        self.table = self.held.where("sums IS NULL").select("bins", "labels", "margins")
        self.last, self.known, self.same = tree, {}, {0}
        if fused:
            found = sorted(self.held.where("sums IS NOT NULL").select("part", "sums").collect())
            whole = sum(np.frombuffer(r["sums"]).reshape(shape) for r in found)
            self.known = dict(zip(leaves, whole))
            for n in reversed(inner):
                self.known[n] = self.known[2 * n + 1] + self.known[2 * n + 2]
            self.free()

    def _known(self, tree: Tree, node: int) -> bool:
        """Whether the last tree led the same rows to a node, so that their sums are known."""
        above, last = (node - 1) // 2, self.last
        if node and above in self.same and (tree.feature[above], tree.cut[above]) == (last.feature[above], last.cut[above]):
            self.same.add(node)
        return node in self.same and node in self.known

    def free(self) -> None:
        """Let go of the table of the round before, which the present one no longer needs."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def cuts(self, tree: Tree, open_nodes: list[int]) -> dict[tuple[int, int], tuple[float, int, np.ndarray, np.ndarray]]:
        """Best cut of each open node and feature: gain, bin, sums left of it, sums of the node."""
        done = {n: self.known[n] for n in open_nodes if self._known(tree, n)}
        open_nodes = [n for n in open_nodes if n not in done]
        found = self._searched(tree, open_nodes) if open_nodes else {}
        for n, sums in done.items():
            found.update({(n, f): cut for f, cut in enumerate(zip(*best_cuts(sums, self.penalty), sums.sum(axis=1)))})
        return found

    def _searched(self, tree: Tree, open_nodes: list[int]) -> dict[tuple[int, int], tuple[float, int, np.ndarray, np.ndarray]]:
        """The same by a pass over the rows."""
        own, shape = self._own(), (len(open_nodes), self.width, self.n_bins, 2 * self.outputs)
        first, penalty = self.round == 0, self.penalty

        def summed(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for bins, labels, margins in own._blocks(batches):
                part = _sums(bins, tree.leaf(bins, tree.cut), open_nodes, own._wanted(margins, labels, first), own.n_bins)
                total = part if total is None else np.add(total, part, out=total)
            return total

        if self.parts * 8 * int(np.prod(shape)) <= DRIVER_BYTES:

            def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = summed(batches)
                if total is not None:
                    cells = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["part", "data"])

            found = sorted(self.table.mapInArrow(leaves, "part int, data binary").collect())
            whole = sum(np.frombuffer(r["data"]).reshape(shape) for r in found)
            return {
                (node, f): (gain, at, left, total)
                for i, node in enumerate(open_nodes)
                for f, (gain, at, left, total) in enumerate(zip(*best_cuts(whole[i], penalty), whole[i].sum(axis=1)))
            }

        def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = summed(batches)
            if total is not None:
                part = TaskContext.get().partitionId()
                for i, node in enumerate(open_nodes):
                    cells = [
                        pa.array(np.full(shape[1], node, np.int32)),
                        pa.array(np.arange(shape[1], dtype=np.int32)),
                        pa.array(np.full(shape[1], part, np.int32)),
                        pa.array([total[i, f].tobytes() for f in range(shape[1])], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cells, ["node", "feature", "part", "data"])

        def met(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, key = None, None

            def out() -> pd.DataFrame:
                gain, at, left = best_cuts(held, penalty)
                cells = [(*key, float(gain), int(at), left.tobytes(), held.sum(axis=0).tobytes())]
                return pd.DataFrame(cells, columns=["node", "feature", "gain", "at", "low", "whole"])

            for frame in frames:
                for node, feature, _, data in frame.itertuples(index=False):
                    part = np.frombuffer(data).reshape(shape[2:])
                    if held is not None and key != (node, feature):
                        yield out()
                        held = None
                    held, key = part if held is None else held + part, (node, feature)
            if held is not None:
                yield out()

        rows = self.table.mapInArrow(spread, "node int, feature int, part int, data binary")
        rows = rows.repartition(self.parts, "node", "feature").sortWithinPartitions("node", "feature", "part")
        rows = rows.mapInPandas(met, "node int, feature int, gain double, at int, low binary, whole binary")
        return {(r["node"], r["feature"]): (r["gain"], r["at"], np.frombuffer(r["low"]), np.frombuffer(r["whole"])) for r in rows.collect()}


def _grown(rows: _Rows, cuts: list[np.ndarray], depth: int, step: float) -> Tree:
    k = rows.outputs
    tree = Tree(depth, k)

    def settle(node: int, total: np.ndarray) -> None:
        tree.value[node] = -step * total[:k] / (total[k:] + rows.penalty)

    def least(left: np.ndarray, right: np.ndarray) -> float:
        """Gain that a cut must exceed."""
        if rows.loss == NEWTON:
            return LEAST_GAIN
        noise = (left + right)[k:].sum() * (ROUNDING * rows.largest) ** 2
        return noise + LEAST_SHARE * sum((part[:k] ** 2 / part[k:]).sum() for part in (left, right))

    open_nodes = [0]
    for level in range(depth):
        found = rows.cuts(tree, open_nodes)
        rows.free()
        following = []
        for node in open_nodes:
            gain = np.array([found[node, f][0] for f in range(rows.width)])
            top = gain.max()
            f = int(np.argmax(gain >= top - 1e-9 * abs(top))) if np.isfinite(top) else 0
            _, at, left, total = found[node, f]
            settle(node, total)
            if np.isfinite(top) and top > least(left, total - left):
                tree.feature[node], tree.cut[node], tree.threshold[node] = f, at, cuts[f][at]
                # The sums on both sides are known already, so the last level needs no pass.
                settle(2 * node + 1, left)
                settle(2 * node + 2, total - left)
                following += [2 * node + 1, 2 * node + 2]
        open_nodes = following
        if not open_nodes:
            break
    return tree


def _rough(value: float) -> float:
    """A number near the value with 10 binary digits, so that taking it off whole numbers and adding it again is exact."""
    part, power = math.frexp(value)
    return math.ldexp(round(part * 1024), power - 10) if math.isfinite(value) else 0.0


def _halfway(data: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Cuts halfway between the values of the features that have at most ``most`` of them."""

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for f in range(flat.shape[1]):
                known = held.get(f, flat[:0, f])
                if len(known) <= most:  # one value too many is enough to know
                    column = flat[:, f]
                    held[f] = np.unique(np.r_[known, column[~np.isnan(column)]])[: most + 1]
        for f, known in held.items():
            cells = [pa.array(np.full(len(known), f, np.int32)), pa.array(known.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(cells, ["feature", "value"])

    found = data.select("x").mapInArrow(values, "feature int, value double").groupBy("feature")
    found = found.agg(F.collect_set("value").alias("values")).where(F.size("values") <= most).collect()
    cuts = {}
    for feature, held in found:
        known = np.unique(held)
        low, high = known[:-1], known[1:]
        middle = low / 2 + high / 2
        cuts[feature] = np.where((low <= middle) & (middle < high), middle, low)
    return cuts


class _Settings(HasFeaturesCol, HasLabelCol):
    trees = Param(Params._dummy(), "trees", "fitted trees as JSON", typeConverter=TypeConverters.toString)


class BoostedTreesModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction (margins), probability and prediction; for numbers the prediction alone."""

    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec = json.loads(self.getOrDefault(self.trees))
        outputs, loss, base = spec["outputs"], spec.get("loss", NEWTON), spec.get("base", 0.0)
        forest = []
        for t in spec["trees"]:
            tree = Tree(spec["depth"], outputs)
            at = t["nodes"]
            tree.feature[at], tree.threshold[at], tree.value[at] = t["feature"], t["threshold"], t["value"]
            forest.append(tree)

        @F.pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.ascontiguousarray(np.stack(features.to_numpy()).T)
            total = np.full((x.shape[1], outputs), base)
            for tree in forest:
                total += tree.value[tree.leaf(x, tree.threshold)]
            return pd.Series(list(total))

        scored = dataset.withColumn("__margins", margins(vector_to_array(F.col(self.getFeaturesCol()))))
        m = F.col("__margins")
        if loss == SQUARED:
            return scored.withColumn("prediction", m[0]).drop("__margins")
        if outputs == 1:
            chance = 1 / (1 + F.exp((-2 if loss == LOGISTIC else -1) * m[0]))
            raw, chances = F.array(-m[0], m[0]), F.array(1 - chance, chance)
        else:
            powers = F.transform(m, lambda x: F.exp(x - F.array_max(m)))
            total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
            raw, chances = m, F.transform(powers, lambda x: x / total)
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(raw),
                "probability": array_to_vector(chances),
                "prediction": (F.array_position(raw, F.array_max(raw)) - 1).cast("double"),
            }
        ).drop("__margins")


class BoostedTrees(Estimator, _Settings, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over a vector of features and a label index 0, 1, ... without gaps, or a number for squared loss."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", typeConverter=TypeConverters.toInt)
    lossType = Param(Params._dummy(), "lossType", "newton, logistic or squared", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, maxIter: int = 100, maxDepth: int = 6, stepSize: float = 0.1, maxBins: int = 256, lossType: str = NEWTON
    ):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=6, stepSize=0.1, maxBins=256, lossType=NEWTON)
        self._set(**self._input_kwargs)

    def setLabelCol(self, value: str) -> BoostedTrees:
        return self._set(labelCol=value)

    def setFeaturesCol(self, value: str) -> BoostedTrees:
        return self._set(featuresCol=value)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        ensure_checkpoint_dir(dataset.sparkSession)
        loss = self.getOrDefault(self.lossType)
        x = vector_to_array(F.col(self.getFeaturesCol())).alias("x")
        data = dataset.select(x, F.col(self.getLabelCol()).cast("double" if loss == SQUARED else "int").alias("y"))
        if loss == NEWTON:
            return self._boosted(data, loss)
        with kept(data) as rows:
            return self._boosted(rows, loss)

    def _boosted(self, data: DataFrame, loss: str) -> BoostedTreesModel:
        shape = data.agg(
            F.max("y").alias("last"),
            F.max(F.size("x")).alias("width"),
            F.count("y").alias("rows"),
            F.avg("y").alias("mean"),
            F.max(F.abs("y")).alias("largest"),
        ).first()
        if shape["last"] is None:
            raise ValueError("no rows to train on")
        if loss == LOGISTIC and shape["last"] > 1:
            raise ValueError("the logistic loss takes two classes")
        outputs = shape["last"] + 1 if loss == NEWTON and shape["last"] > 1 else 1
        base = _rough(shape["mean"]) if loss == SQUARED else 0.0
        names = [f"x{i}" for i in range(shape["width"])]
        bins = self.getOrDefault(self.maxBins)
        probs = [i / bins for i in range(bins)]
        halfway = {} if loss == NEWTON else _halfway(data, bins)
        rest = [n for i, n in enumerate(names) if i not in halfway]
        found = {}
        if rest or loss == NEWTON:
            wide = data.select(*(F.col("x")[i].alias(n) for i, n in enumerate(names) if n in rest))
            found = approx_quantiles(wide, rest, probs, 1 / (4 * bins))
        cuts = [halfway[i] if i in halfway else np.unique(found[n]) if found[n] else np.zeros(0) for i, n in enumerate(names)]
        rows = _Rows(data, cuts, outputs, shape["rows"], loss, base, max(1.0, shape["largest"]) if loss == LOGISTIC else float(shape["largest"]))
        depth, trees = self.getOrDefault(self.maxDepth), []
        for number in range(self.getMaxIter()):
            tree = _grown(rows, cuts, depth, self.getStepSize() if loss == NEWTON or number else 1.0)
            used = (tree.feature >= 0) | tree.value.any(axis=1)
            used[0] = True  # a tree without a gain may be all zero
            at = np.flatnonzero(used)
            trees.append(
                {
                    "nodes": at.tolist(),
                    "feature": tree.feature[at].tolist(),
                    "threshold": tree.threshold[at].tolist(),
                    "value": tree.value[at].tolist(),
                }
            )
            if number + 1 < self.getMaxIter():
                rows.add(tree)
        rows.free()
        rows.held.unpersist()
        model = BoostedTreesModel()
        model._set(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            trees=json.dumps({"depth": depth, "outputs": outputs, "loss": loss, "base": base, "trees": trees}),
        )
        return model
