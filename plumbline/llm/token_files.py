"""Token ids in files of patched frame-of-reference blocks.

Documents are sorted by id over range partitions; each partition writes one shard. A row
of a shard holds whole documents: their ids and token counts, the place of the first
token in the shard, and a payload of blocks. A block of ``BLOCK`` ids keeps its minimum,
packs the differences to it at the width that ``PERCENTILE`` of them fit, and lists
those that do not fit as exceptions; the payload begins with an index of block starts,
so a reader can unpack any block alone. Rows go through Spark's Parquet writer, which
commits whole tasks, works with any file system and drops what a lost task left.

Payload, all little-endian: number of ids and of blocks (unsigned 32 bits each); starts
of the blocks and the end (unsigned 32 bits); per block its minimum (32 bits), width
(8 bits), number of exceptions (16 bits), packed differences (low bits first), positions
(16 bits each) and full differences (32 bits each) of the exceptions.

Results in the odd cases: a null or empty text has only the end id; null ids sort first;
rows equal in id are ordered by their text's hash, equal rows are interchangeable; an
empty table writes no rows and reads as an empty result. Only id and text are read, so
extra columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import SLICE_CHARS, text_slices
from plumbline.llm.common import shuffle_partitions, whole_text
from plumbline.llm.subwords import encoder
from plumbline.session import shared_dir

BLOCK = 256
PERCENTILE = 95
#: Ids after which a row of a shard ends with the current document.
ROW_IDS = 65_536


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative number needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Payload of an array of ids below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=2**32 - 1) if blocks else np.zeros(0, np.uint32)
    gaps = grid - low[:, None]
    bits = _widths(gaps)
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.int64)
    odd = bits > width[:, None]
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        inside = np.where(odd[mine], np.uint32(0), gaps[mine]).astype("<u2" if w <= 16 else "<u4")
        planes = np.unpackbits(inside.view(np.uint8), bitorder="little").reshape(-1, 8 * inside.itemsize)
        packed = np.packbits(planes[:, :w].reshape(len(mine), -1), axis=1, bitorder="little")
        for k, b in enumerate(mine.tolist()):
            at = np.flatnonzero(odd[b])
            head = np.array([low[b]], "<u4").tobytes() + bytes([w]) + np.array([len(at)], "<u2").tobytes()
            body[b] = head + packed[k].tobytes() + at.astype("<u2").tobytes() + gaps[b, at].astype("<u4").tobytes()
    start = 8 + 4 * (blocks + 1)
    index = start + np.r_[0, np.cumsum([len(b) for b in body])] if blocks else np.array([start])
    return np.array([n, blocks], "<u4").tobytes() + index.astype("<u4").tobytes() + b"".join(body)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks from ``first`` up to, not including, ``last``."""
    n, blocks = np.frombuffer(payload, "<u4", 2).tolist()
    last = blocks if last is None else min(last, blocks)
    index = np.frombuffer(payload, "<u4", blocks + 1, 8).astype(np.int64)[first:last]
    if not len(index):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    low = raw[index[:, None] + np.arange(4)].copy().view("<u4")
    width = raw[index + 4].astype(np.int64)
    count = raw[index[:, None] + np.arange(5, 7)].copy().view("<u2").astype(np.int64)[:, 0]
    out = np.empty((len(index), BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        packed = raw[index[mine][:, None] + 7 + np.arange(size)]
        kind = np.dtype("<u2" if w <= 16 else "<u4")
        planes = np.zeros((len(mine) * BLOCK, 8 * kind.itemsize), np.uint8)
        planes[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w) if w else 0
        out[mine] = np.packbits(planes, axis=1, bitorder="little").view(kind).reshape(-1, BLOCK)
    for k in np.flatnonzero(count).tolist():
        at = int(index[k] + 7 + BLOCK * width[k] // 8)
        places = np.frombuffer(payload, "<u2", count[k], at)
        out[k, places] = np.frombuffer(payload, "<u4", count[k], at + 2 * int(count[k]))
    flat = (out + low).reshape(-1)
    return flat[: n - first * BLOCK]


def write(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode the documents in ascending id order, each with ``end_id`` behind it, into files at ``path``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = encoder(vocabulary)
        shard, start = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            counts = [len(h) for h in held]
            payload = pack(np.concatenate(held))
            cells = [[shard], [start], [keys], [counts], [sum(counts)], [payload]]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, [c[0] for c in cells]))], schema)

        schema = None
        for ids, texts in text_slices(batches, 3 * SLICE_CHARS):
            if schema is None:
                schema = pa.schema(
                    [
                        ("shard", pa.int32()),
                        ("start", pa.int64()),
                        ("ids", pa.list_(ids.type)),
                        ("counts", pa.list_(pa.int64())),
                        ("n", pa.int64()),
                        ("payload", pa.binary()),
                    ]
                )
            size = sum(map(len, held))
            flat, counts = subwords.encode_flat(texts)
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id)  # each document's end id goes behind it
            cuts = ends + np.arange(1, len(ends) + 1)
            for key, code in zip(ids.to_pylist(), np.split(flat, cuts[:-1])):
                keys.append(key)
                held.append(code)
                size += len(code)
                if size >= ROW_IDS:
                    yield row()
                    start, size = start + size, 0
                    keys, held = [], []
        if held:
            yield row()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(docs[id_column].alias("id"), whole_text(text_column).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    schema = f"shard int, start long, ids array<{kind}>, counts array<long>, n long, payload binary"
    rows.mapInArrow(run, schema).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, as 32-bit integers) from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, start, keys, counts, payload = (batch.column(c)[r] for c in range(5))
                counts = np.array(counts.as_py(), dtype=np.int64)
                begins = np.cumsum(counts) - counts
                flat = unpack(payload.as_py()).astype("<u4").tobytes()
                parts = [flat[4 * b : 4 * (b + c)] for b, c in zip(begins.tolist(), counts.tolist())]
                columns = [
                    pa.array(np.full(len(counts), shard.as_py(), np.int32)),
                    pa.array(begins + start.as_py()),
                    keys.values,
                    pa.array(parts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "start", "doc_id", "ids"])

    docs = files.select("shard", "start", "ids", "counts", "payload")
    docs = docs.mapInArrow(run, f"shard int, start long, doc_id {kind}, ids binary")
    # One row for each shard, whose number is the number of partitions written.
    totals = files.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "ids"
    )


def write_and_read(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write into a new folder of the shared folder and read the files back; the files stay there."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, vocabulary, path, **options)
    return read(docs.sparkSession, path)
