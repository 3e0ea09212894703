"""Packing of token ids into sequences of a fixed capacity by minimum bin slack.

A document's ids, with an end id behind them, are cut at multiples of the capacity, so
only its last piece is shorter. A piece's place depends on its length and its rank among
the pieces of that length, and on nothing else. The plan is therefore made from the
number of pieces of each length, at most ``capacity`` numbers at any size of the corpus:

- A window begins with the longest piece left. Dynamic programming over bitsets of
  reachable sums picks, from the multiset of lengths left, the counts that come closest
  to the room that remains; bitsets kept on the way give the counts back.
- The window is repeated for as long as every length lasts, as one entry of the plan.
- If slack is left, the head of the longest piece left fills it and the rest of that
  piece becomes a piece of its own. So a cut is made only where no choice of whole pieces
  fills the window, and every window is full.
- What is left at the end fills windows of the powers of two that sum to it.

Ranks need no common counter: a task numbers its pieces of each length as it writes
them, and a running sum of counts over the tasks gives each task its first rank.

Results in the odd cases: a null or empty text has only the end id; null and repeated
ids are kept, each row is a document of its own; an empty table gives an empty result.
Only id and text are read, so extra columns cannot clash. A task holds one slice of
texts; a plan has a few entries for each length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import SLICE_CHARS, text_slices
from plumbline.llm.common import whole_text
from plumbline.llm.subwords import encoder
from plumbline.session import shared_dir

CAPACITY = 1024
#: Ranks of one length stay below this number.
RANKS = 2**48
#: Rows of first ranks (two integers and a number each) that may be broadcast: about 25 MB.
STARTS = 1_000_000
#: Pieces of one Arrow batch.
BATCH = 16_384


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length, within those given, whose sum comes closest to ``room`` without passing it."""
    inside = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left and not reach >> room:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (part * length)) & inside
            left -= part
            part *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= part * length
            chosen[length] = chosen.get(length, 0) + part
    return chosen


@dataclass
class Plan:
    """Where the pieces of a length go, as sorted intervals of ranks.

    ``each`` pieces of an interval share a window; ``head`` is 0 for whole pieces, else the
    ids that are cut off, and ``rest`` is the first rank of the remainders among their length.
    """

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    rest: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.length * RANKS + self.first, length * RANKS + rank, "right") - 1


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in left.items())
    used = dict.fromkeys(left, 0)
    known = dict(left)  # ranks given out so far, those of remainders included
    entries: list[tuple[int, ...]] = []
    window = 0

    def take(length: int, each: int, repeats: int, offset: int, head: int = 0, rest: int = 0) -> None:
        entries.append((length, used[length], each, window, offset, head, rest))
        used[length] += each * repeats
        left[length] -= each * repeats
        if not left[length]:
            del left[length]

    while total:
        size = min(capacity, 1 << (total.bit_length() - 1)) if total < capacity else capacity
        longest = max((n for n in left if n <= size), default=0)
        chosen: dict[int, int] = {}
        if longest:
            left[longest] -= 1
            chosen = fullest({n: c for n, c in left.items() if c}, size - longest)
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
        slack = size - sum(n * k for n, k in chosen.items())
        cut = max((n for n, c in left.items() if c > chosen.get(n, 0)), default=0) if slack else 0
        need = chosen | ({cut: chosen.get(cut, 0) + 1} if slack else {})
        repeats = min([total // size] + [left[n] // k for n, k in need.items()])
        offset = 0
        for n, k in chosen.items():
            take(n, k, repeats, offset)
            offset += n * k
        if slack:
            rest = cut - slack
            take(cut, 1, repeats, offset, slack, known.get(rest, 0))
            known[rest] = known.get(rest, 0) + repeats
            used.setdefault(rest, 0)
            left[rest] = left.get(rest, 0) + repeats
        total -= size * repeats
        window += repeats
    columns = np.array(sorted(entries), np.int64).reshape(-1, 7).T
    return Plan(*columns)


def _binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of 32-bit ids as binary values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(4 * lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _piece_rows(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces in the order of their documents, numbered by task and length."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for ids, texts in text_slices(batches, 2 * SLICE_CHARS):
            flat, counts = subwords.encode_flat(texts)
            flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(counts[doc] - start, capacity)
            ends = np.cumsum(length)
            for a in range(0, len(doc), BATCH):
                b = min(a + BATCH, len(doc))
                own = length[a:b]
                order = np.argsort(own, kind="stable")
                ranked = own[order]
                firsts = np.searchsorted(ranked, ranked)
                place = np.empty(b - a, np.int64)
                place[order] = np.arange(b - a) - firsts + seen[ranked]
                seen += np.bincount(own, minlength=capacity + 1)
                taken = flat[ends[a] - own[0] : ends[b - 1]]
                columns = [
                    ids.take(pa.array(doc[a:b])),
                    pa.array(np.full(b - a, part, np.int32)),
                    pa.array(place),
                    pa.array(start[a:b]),
                    pa.array(own.astype(np.int32)),
                    pa.array(counts[doc[a:b]]),
                    _binaries(taken, own),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "place", "start", "length", "doc_tokens", "ids"])

    rows = docs.select(docs[id_column].alias("id"), whole_text(text_column).alias("text"))
    schema = f"id {kind}, part int, place long, start long, length int, doc_tokens long, ids binary"
    return rows.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each piece: id, start in its document, length, doc_tokens, sequence_id, offset, ids (binary)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    _piece_rows(docs, vocabulary, end_id, capacity, id_column, text_column).write.parquet(path)
    pieces = spark.read.parquet(path)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row for each length, of which there are at most ``capacity``.
    totals = {r["length"]: (r["n"], r["parts"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).collect()}
    plan = make_plan({length: n for length, (n, _) in totals.items()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if sum(parts for _, parts in totals.values()) <= STARTS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["part", "length"])
    rank = (F.col("before") + F.col("place")).alias("rank")
    return _placed(ranked.select("id", "start", "length", "doc_tokens", rank, "ids"), plan).withColumnRenamed("id", id_column)


def _placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """The final pieces of ranked ones: whole where the plan takes them whole, else cut where it cuts them."""
    kind = ranked.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in (1, 2, 4))
            row, skip = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(row):
                at = plan.find(length, rank)
                order = rank - plan.first[at]
                head = plan.head[at]
                size = np.where(head > 0, head, length)
                ids = batch.column(5).take(pa.array(row))
                if (head > 0).any() or skip.any():
                    raw = zip(ids.to_pylist(), (4 * skip).tolist(), (4 * (skip + size)).tolist())
                    ids = pa.array([i[a:b] for i, a, b in raw], pa.binary())
                columns = [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start[row] + skip),
                    pa.array(size),
                    batch.column(3).take(pa.array(row)),
                    pa.array(plan.window[at] + order // plan.each[at]),
                    pa.array(plan.offset[at] + order % plan.each[at] * length),
                    ids,
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                cut = np.flatnonzero(head > 0)  # their remainders are placed in the next round
                row, skip = row[cut], skip[cut] + head[cut]
                length, rank = length[cut] - head[cut], plan.rest[at[cut]] + order[cut]

    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (binary). A sequence has at most ``capacity`` ids."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    rows = packed.groupBy("sequence_id").agg(joined.alias("ids"))
    return rows.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
