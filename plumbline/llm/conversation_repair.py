"""Repair of the turn structure of conversations by run-length dynamic programming.

A row is one symbol: what its role begins with, and its first fault. Rows equal in turn,
role and text are one counted row from the start. Equal neighbouring symbols collapse to
runs. An edit of a row, with insertions before it, is a 4 x 4 min-plus matrix over what
the repaired turns end with; a run advances the costs through cached binary powers of its
matrix, from the last run to the first. The audit is then unrolled from the first run on:
blocks of 2**k rows that meet the same costs behind them share one cached choice of
edits, which is the least in ASCII of the cheapest.

Rows are ordered by range over turn, role and the text's digest, so many tasks share a
long conversation; each sends on its runs. A conversation's runs meet in one task as one
short text for each range, since its audit is one value. Texts are only read in a last
stream, sorted by conversation and place, that applies the audit row by row.

Results in the odd cases: a null id is a conversation of its own; a null role, text or
turn counts as one space in the damage and the digest, a null turn stands first; rows of
one turn are ordered by role, then by the SHA-256 of the text; an empty role begins with
no letter and fits nowhere; a conversation without rows has cost 0 and an empty audit; an
empty table gives an empty result. Only id, turn, role and text are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORDS, shuffle_partitions

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits; a truncated row that stays adds one more.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: What a role begins with, and the first fault of a row. A symbol is one letter for a pair of these.
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER = len(INITIALS)
#: What the repaired turns end with: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 2**40
#: Blocks of up to 2**BLOCK_POWER rows keep their choices in the cache.
BLOCK_POWER = 10
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def symbol(initial: int, fault: int) -> str:
    return chr(97 + 4 * initial + fault)


def _parts(letter: str) -> tuple[int, int]:
    return divmod(ord(letter) - 97, 4)


def _kept(state: int, initial: int) -> int | None:
    """State after a row is kept, if it may be."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def _edits(state: int, letter: str) -> list[tuple[str, int, int]]:
    """Edits of one row, in ASCII order: letter, cost, next state."""
    initial, fault = _parts(letter)
    out = [(DELETE, DELETE_COST, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        after = _kept(state, initial)
        if after is not None:
            out.append((KEEP, more, after))
        out.append((REROLE, REROLE_COST + more, _NEXT[state]))
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1).clip(max=FAR)


def _insertions() -> np.ndarray:
    """Cheapest insertions from each state to each."""
    cost = np.full((4, 4), FAR)
    np.fill_diagonal(cost, 0)
    for state, after in _NEXT.items():
        cost[state, after] = INSERT_COST
    return _times(_times(cost, cost), cost)


FREE = _insertions()
#: Costs of ending: nothing or an assistant's turn may come last.
END = (FREE + np.array([0, FAR, FAR, 0])).min(axis=1)


@lru_cache(maxsize=None)
def power(letter: str, k: int) -> np.ndarray:
    """Min-plus matrix of 2**k rows of one symbol, each with insertions before it."""
    if k:
        return _times(power(letter, k - 1), power(letter, k - 1))
    row = np.full((4, 4), FAR)
    for state in range(4):
        for _, cost, after in _edits(state, letter):
            row[state, after] = min(row[state, after], cost)
    return _times(FREE, row)


def _before(letter: str, k: int, costs: np.ndarray) -> np.ndarray:
    return (power(letter, k) + costs).min(axis=1)


def _blocks(count: int) -> list[int]:
    """Powers of two that sum to a count, the largest first; the largest one may repeat."""
    whole, rest = divmod(count, 2**BLOCK_POWER)
    return [BLOCK_POWER] * whole + [k for k in range(BLOCK_POWER - 1, -1, -1) if rest >> k & 1]


@lru_cache(maxsize=4096)
def choices(letter: str, k: int, after: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """For each state before a block of 2**k rows: the state behind it and the edits chosen.

    ``after`` holds the costs that each state behind the block still meets, less the least of them.
    """
    costs = np.array(after)
    if k:
        middle = _before(letter, k - 1, costs)
        early = choices(letter, k - 1, tuple((middle - middle.min()).tolist()))
        late = choices(letter, k - 1, after)
        return tuple((late[q][0], edits + late[q][1]) for q, edits in early)
    before = _before(letter, 0, costs)
    out = []
    for state in range(4):
        edits = ""
        while True:
            options = [(e, c + costs[to], to) for e, c, to in _edits(state, letter)]
            options.append((INSERT, INSERT_COST + before[_NEXT[state]], _NEXT[state]))
            edit, _, to = min(o for o in options if o[1] == before[state])
            edits, state = edits + edit, to
            if edit != INSERT:
                break
        out.append((state, edits))
    return tuple(out)


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of a conversation of such runs of symbols."""
    costs = END
    behind = []
    for letter, count in reversed(runs):
        for k in reversed(_blocks(count)):
            low = costs.min()
            behind.append((letter, k, tuple((costs - low).tolist())))
            costs = _before(letter, k, costs)
    state, audit = START, []
    for block in reversed(behind):
        state, edits = choices(*block)[state]
        audit.append(edits)
    while state not in (START, ASSISTANT):
        state = _NEXT[state]
        audit.append(INSERT)
    return int(costs[START]), "".join(audit)


def illegal(runs: list[tuple[str, int]]) -> int:
    """Neighbouring rows whose roles may not follow each other."""
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    initials = [((INITIALS + "?")[_parts(letter)[0]], n) for letter, n in runs]
    inside = sum(n - 1 for _, n in initials)  # no role may follow itself
    return inside + sum((a, b) not in legal for (a, _), (b, _) in itertools.pairwise(initials))


def _space(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damage(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv, turn, role, text, copies of each row, dropped ones with 0 copies; what happens hangs on the id and turn."""
    key = F.concat(_space(id_column), F.lit(":"), _space(turn_column))
    kind = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20))
    text = _space(text_column)
    return rows.select(
        F.col(f"`{id_column}`").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(_space(role_column)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with the digest of the text, which orders the rows of one turn and role."""
    return rows.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256))


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows: conv, turn, role, digest, n copies, initial, plain (fault of the row alone), seen (earlier in its conversation)."""
    last = F.regexp_extract("text", r"(?s)\A.*([^\x20\x09-\x0D])", 1)
    plain = F.when(~F.col("text").rlike(WORDS), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    places = [F.when(F.col("role").startswith(c), i) for i, c in enumerate(INITIALS)]
    initial = F.coalesce(*places, F.lit(OTHER))
    same = ["conv", "turn", "role", "digest"]
    table = _ordered(rows).withColumns({"plain": plain, "initial": initial})
    table = table.groupBy(*same, "plain", "initial").agg(F.sum("copies").alias("n"))
    # Null turns stand first, and a struct with a flag says so. The first turn of each text joins as a row of its own:
    # a text that one conversation repeats in very many turns is thereby no hot key.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = table.where("n > 0").groupBy("conv", "role", "digest").agg(F.min(turn)["turn"].alias("turn"))
    both = table.withColumn("first", F.lit(False)).unionByName(firsts.withColumn("first", F.lit(True)), allowMissingColumns=True)
    return both.groupBy(*same).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.max("plain").alias("plain"),
        F.max("initial").alias("initial"),
        (~F.max("first")).alias("seen"),
    )


def _runs_of(n: int, plain: int, initial: int, seen: bool) -> list[tuple[str, int]]:
    """Runs of a counted row: its first copy may be no duplicate, the others are."""
    if not n:
        return []
    if plain == BLANK:
        return [(symbol(initial, BLANK), n)]
    if seen:
        return [(symbol(initial, DUPLICATE), n)]
    return [(symbol(initial, plain), 1)] + ([(symbol(initial, DUPLICATE), n - 1)] if n > 1 else [])


def _collapsed(runs: Iterator[tuple[str, int]]) -> list[tuple[str, int]]:
    return [(letter, sum(n for _, n in same)) for letter, same in itertools.groupby(runs, key=lambda r: r[0])]


def _written(runs: list[tuple[str, int]]) -> str:
    return "".join(f"{letter}{n if n > 1 else ''}" for letter, n in runs)


def _read(text: str) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[end].isdigit():
            end += 1
        yield text[at], int(text[at + 1 : end] or 1)
        at = end


def _stream(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Schema | None, Iterator[tuple[object, Iterator[tuple]]]]:
    """Schema of a sorted stream, and its rows by the conversation in their first column."""
    first = next(batches, None)
    if first is None:
        return None, iter(())
    rows = (row for batch in itertools.chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    return first.schema, itertools.groupby(rows, key=lambda r: r[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, 1000)):
        cells = [pa.array(c, t) for c, t in zip(zip(*held), schema.types)]
        yield pa.RecordBatch.from_arrays(cells, schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = rows.schema["conv"].dataType.simpleString()
    table = counted(rows)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = shuffle_partitions(rows)
    ranged = table.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conversations = _stream(batches)
        if schema:
            rows = ((conv, _written(_collapsed(r for row in group for r in _runs_of(*row[1:])))) for conv, group in conversations)
            yield from _batches(rows, pa.schema([("conv", schema.types[0]), ("runs", pa.string())]))

    narrow = ranged.select("conv", "n", "plain", "initial", "seen")
    pieces = narrow.mapInArrow(collapse, f"conv {kind}, runs string").withColumn("part", F.spark_partition_id())
    whole = F.array_sort(F.collect_list(F.struct("part", "runs")))
    runs = pieces.groupBy("conv").agg(F.concat_ws("", F.transform(whole, lambda p: p["runs"])).alias("runs"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                own = _collapsed(_read(text))
                faults = [0] * len(FAULTS)
                for letter, n in own:
                    faults[_parts(letter)[1]] += n
                found.append((*faults[1:], illegal(own), *cheapest(own)))
            cells = [pa.array(c) for c in zip(*found)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    schema = f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    found = runs.mapInArrow(solve, schema)
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    turns = rows.select("conv", turn.cast("decimal(20,0)").alias("turn")).distinct().groupBy("conv")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.agg(gaps.alias("gaps")).withColumnRenamed("conv", "other")
    return found.join(counts, F.col("conv").eqNullSafe(F.col("other"))).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns, sorted inside each conversation: conv, place, edit, turn, role, text.

    ``found`` is what ``audits`` returns for the same rows. A conversation lies in one partition and
    is streamed there; one without repaired turns has one row whose place is null.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    turn_kind = rows.schema["turn"].dataType.simpleString()
    body = _ordered(rows).where("copies > 0").select("conv", F.lit(1).alias("level"), "turn", "role", "digest", "text", "copies")
    heads = found.select("conv", F.lit(0).alias("level"), F.col("audit").alias("text"))
    both = heads.unionByName(body, allowMissingColumns=True).select("conv", "level", "turn", "role", "text", "copies", "digest")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "level", "turn", "role", "digest")]
    stream = both.repartition(shuffle_partitions(rows), "conv").sortWithinPartitions(*order).drop("digest")

    def turns(conv, group: Iterator[tuple]) -> Iterator[tuple]:
        audit, state, place = iter(next(group)[4]), START, 0
        for _, _, turn, role, text, copies in itertools.chain(group, [(conv, 1, None, None, None, 1)]):
            for _ in range(copies):
                for edit in audit:
                    if edit == INSERT:
                        state = _NEXT[state]
                        yield conv, place, edit, None, "user" if state == USER else "assistant", ""
                    elif edit == REROLE:
                        state = _NEXT[state]
                        yield conv, place, edit, turn, "user" if state == USER else "assistant", text
                    elif edit == KEEP:
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                        yield conv, place, edit, turn, role, text
                    place += edit != DELETE
                    if edit != INSERT:
                        break
        if not place:
            yield conv, None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conversations = _stream(batches)
        if schema:
            rows = (row for conv, group in conversations for row in turns(conv, group))
            kinds = [schema.types[0], pa.int64(), pa.string(), schema.types[2], pa.string(), pa.string()]
            yield from _batches(rows, pa.schema(list(zip(["conv", "place", "edit", "turn", "role", "text"], kinds))))

    return stream.mapInArrow(run, f"conv {kind}, place long, edit string, turn {turn_kind}, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``repaired``: conv and the SHA-256 of its turns as role:text, joined by line breaks."""
    kind = turns.schema["conv"].dataType.simpleString()

    def digest(group: Iterator[tuple]) -> str:
        total = hashlib.sha256()
        for _, place, role, text in group:
            if place is not None:
                total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        return total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conversations = _stream(batches)
        if schema:
            rows = ((conv, digest(group)) for conv, group in conversations)
            yield from _batches(rows, pa.schema([("conv", schema.types[0]), ("repaired_sha256", pa.string())]))

    return turns.select("conv", "place", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")
