"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosine.

Vectors are scaled to length 1. A table has some random directions; a vector's place
along each, moved by a random offset and cut into steps of ``STEP``, names its bucket.
Two vectors at cosine 0.93 lie 0.374 apart and share a step of one direction with
probability 0.851; unrelated ones lie 1.414 apart and share it with probability 0.486.
The number of directions follows the logarithm of the largest label, so that a vector
meets about ``STRANGERS`` unrelated ones however many there are; the number of tables
follows from it, so that none joins a pair at 0.93 with probability ``MISSED`` at most
(8 directions and 20 tables for labels of 100 vectors, 15 and 68 for 5,000). Closer
pairs are missed far less often.

Equal vectors of a label are one row from the start. Buckets of one row are dropped; a
bucket of more than ``BLOCK`` rows is cut into slices, and each pair of slices is a group
of its own, so no task holds more than two slices of a bucket at a time. A group counts
its links as a matrix of cosines; a pair that shares several buckets is counted in the one
of the smallest name, by lists of shared buckets that come with the vectors. Groups send on counts and, for the components, one link for each vector.

Results in the odd cases: a vector that is null, empty, zero or has null or non-finite
components, or whose label is null, links with nothing and is its own component; vectors
of different lengths never link; repeated rows link with each other; a null id is never
a component's name unless all ids are null, and its row is not kept then; an empty table
gives an empty result. Only id, vector and label are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed
from plumbline.llm.components import components

STEP, STRANGERS, MISSED = 2.0, 7.0, 0.002
#: Rows of a bucket that are compared as one matrix.
BLOCK = 512
#: Rows that one call of the comparing function gets, on average.
ROWS_A_TASK = 8_000
#: Vectors that are hashed at a time.
SLICE = 1_024


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    # Powers of two change no digit; squares then neither overflow nor vanish.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def same_step(distance: float) -> float:
    """Probability that two vectors this far apart share a step of one direction."""
    r = STEP / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Directions of a table, and tables, for labels of up to this many vectors."""
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    projections = 8
    while True:
        tables = math.ceil(math.log(MISSED) / math.log1p(-(near**projections)))
        if largest * tables * far**projections <= STRANGERS:
            return projections, tables
        projections += 1


def codes(units: np.ndarray, projections: int, tables: int, seed: int) -> np.ndarray:
    """64-bit bucket name of each unit vector in each table."""
    rng = np.random.default_rng([seed, units.shape[1]])
    directions = rng.standard_normal((units.shape[1], tables * projections))
    offsets = rng.uniform(0, STEP, tables * projections)
    steps = np.floor((units @ directions + offsets) / STEP).astype(np.int64).reshape(len(units), tables, projections)
    mix = rng.integers(1, 2**62, projections) * 2 + 1
    with np.errstate(over="ignore"):
        h = (steps * mix).sum(axis=2).astype(np.uint64)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v) for v in column])


def _lowest(links: np.ndarray) -> np.ndarray:
    """Smallest position that each row of a symmetric link matrix reaches."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _together(shared, bucket: int) -> np.ndarray:
    """Which rows also share a bucket of a smaller name."""
    lists = [x[x < bucket] for x in map(np.asarray, shared)]
    names, place = np.unique(np.concatenate(lists), return_inverse=True)
    held = np.zeros((len(lists), len(names)), np.float32)
    held[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), place] = 1
    held = held[:, held.sum(axis=0) > 1]
    return held @ held.T > 0


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    block: int = BLOCK,
    seed: int = 5,
) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id reached), kept."""
    table = rows.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"), F.col(f"`{label_column}`").alias("label")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.concat(F.hex(F.xxhash64("label", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v", "label")))
    table = table.select("id", "v", "label", F.when(usable, key).alias("key"))
    distinct = checkpointed(
        table.where("key is not null")
        .groupBy("key", "label", "v")
        .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .select("key", "v", F.xxhash64("label", F.size("v")).alias("space"), "low", "copies")
        .withColumn("node", F.monotonically_increasing_id())
    )
    largest = distinct.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    projections, tables = plan(largest, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in sorted(set(batch.column(1).value_lengths().to_pylist())):
                part = batch.filter(pa.array(np.asarray(batch.column(1).value_lengths()) == size))
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                for begin in range(0, len(vectors), SLICE):  # directions of all tables at once
                    found = codes(_units(vectors[begin : begin + SLICE]), projections, tables, seed)
                    names = pa.array(list(found), pa.list_(pa.int64()))
                    cut = part.slice(begin, SLICE)
                    yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(2), names], ["node", "space", "codes"])

    places = distinct.select("node", "v", "space").mapInArrow(hashed, "node long, space long, codes array<long>")
    # The names are kept, since products of other shapes may differ in their last bits.
    places = checkpointed(places).select("node", "space", F.posexplode("codes").alias("t", "code"))
    places = places.select("node", F.xxhash64("space", "t", "code").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = places.join(sizes, "bucket").withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
    member = checkpointed(member.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), "slices").cast("int")))
    shared = member.groupBy("node").agg(F.collect_set("bucket").alias("shared"))  # no more than tables
    # Slices i <= j meet in group (i, j): a row goes to the groups that hold its own slice.
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    member = member.select("node", "bucket", "own", other)
    member = member.select("node", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    calls = max(1, -(-member.count() // ROWS_A_TASK))
    member = member.withColumn("call", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(calls)).cast("int"))
    loaded = member.join(distinct.join(shared, "node").select("node", "v", "copies", "shared"), "node")

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts, firsts = [], [], []
        for _, rows in part.groupby(part["v"].map(len), sort=False):
            rows = rows.sort_values(["bucket", "i", "j"])
            units, shared = _units(_matrix(rows["v"])), rows["shared"].to_numpy()
            bucket, i, j, own, node, copies = (rows[c].to_numpy() for c in ("bucket", "i", "j", "own", "node", "copies"))
            new = (np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            edges = [0, *(np.nonzero(new)[0] + 1), len(rows)]
            for begin, end in zip(edges, edges[1:]):
                links = units[begin:end] @ units[begin:end].T >= threshold
                np.fill_diagonal(links, False)
                if i[begin] != j[begin]:
                    links &= own[begin:end, None] != own[None, begin:end]
                use = links.any(axis=1)
                if not use.any():
                    continue
                name = node[begin:end]
                n = (links & ~_together(shared[begin:end], bucket[begin])) @ copies[begin:end]
                keys.append(name[use]), counts.append(n[use]), firsts.append(name[_lowest(links)][use])
        none = [np.zeros(0, np.int64)]
        columns = {"node": keys or none, "n": counts or none, "first": firsts or none}
        return pd.DataFrame({name: np.concatenate(parts) for name, parts in columns.items()})

    found = checkpointed(loaded.groupBy("call").applyInPandas(compared, "node long, n long, first long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
    whole = distinct.select("node", "key", "low", "copies").join(links, "node", "left").join(joined, "node", "left")
    whole = whole.select("key", "low", "copies", "n", F.coalesce("root", "node").alias("root"))
    names = whole.groupBy("root").agg(F.min("low").alias("component"))
    whole = whole.join(names, "root").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return (
        table.select("id", "key")
        .join(whole.withColumnRenamed("key", "key_"), F.col("key") == F.col("key_"), "left")
        .select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )
