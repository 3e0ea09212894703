"""Whitening, packing and the repair of turns against brute force, the library and odd rows."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import conversation_repair, packing, whitening
from plumbline.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def whitened(rows):
    """By definition, from all vectors at once."""
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return ((n * x - total) ** 2).sum(axis=1), y @ vectors, values


@pytest.mark.parametrize("block", [12, whitening.BLOCK, 200])
def test_whitening_as_by_definition(spark, folder, block):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    source = table.orderBy("vec_id").collect()
    deviation, projected, values = whitened([r["embedding"] for r in source])
    got = whitening.whiten(table, block=block).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * len(source) and {r["n"] for r in got} == {len(source)}
    assert [r["deviation"] for r in got[::8]] == deviation.tolist()
    white = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    expected = projected[:, :8] / np.sqrt(values[:8])
    sign = np.sign((white * expected).sum(axis=0))
    assert np.abs(white * sign - expected).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:8]], values[:8] / values.sum(), rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_misses_no_component_that_the_start_is_blind_to(spark, monkeypatch):
    """A block that starts orthogonal to the largest component is corrected by the fresh block."""
    rng = np.random.default_rng(1)
    data = rng.standard_normal((400, 40)) * np.linspace(1, 2, 40)
    data[:, 0] *= 9
    x = np.floor(1024 * data).astype(np.int64)
    y = x - x.mean(axis=0)
    covariance = y.T @ y / len(y)
    values, vectors = np.linalg.eigh(covariance)
    hidden = vectors[:, -1:]

    class Known(whitening.Spectrum):
        def __init__(self):
            self.size = 40

        def times(self, block):
            return covariance @ block

    class Blind:
        """Draws that never see the hidden direction until the fresh block."""

        def __init__(self, seed):
            self.rng, self.calls = np.random.Generator(np.random.PCG64(seed)), 0

        def standard_normal(self, shape):
            self.calls += 1
            found = self.rng.standard_normal(shape)
            return found if self.calls > 2 else found - (hidden @ (hidden.T @ found)).reshape(found.shape)

    monkeypatch.setattr(whitening.np.random, "default_rng", Blind)
    found, _ = whitening.leading(Known(), 8, 12, 3)
    assert np.allclose(found, values[::-1][:8], rtol=1e-10)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, id int, x string, n int"
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (1, one), (None, [0.0, 0.5, -1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 1.0])]
    rows += [(5, [float("inf"), 0.0, 1.0]), (6, []), (7, [1.0]), (8, [3e38, 0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "x", 1) for r in rows], schema).repartition(4)
    got = whitening.whiten(table).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 6, None: 3}
    assert {r["n"] for r in got} == {3} and all(r["identity_error"] < 1e-9 for r in got)
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)  # three points, two equal: one direction
    equal = whitening.whiten(table.where("vec_id = 1")).collect()
    assert [r["whitened"] for r in equal] == [None] * 6 and equal[0]["explained"] is None and equal[0]["deviation"] == 0
    assert whitening.whiten(table.where("vec_id > 1 and vec_id < 7")).count() == 0
    assert whitening.whiten(table.limit(0)).columns[0] == "vec_id"


def test_whitening_sums_are_exact(spark):
    rows = [(i, [1e15 + 3 * i, -1e15 - i, float(i)]) for i in range(7)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0, shift=0).collect()
    total = [sum(int(r[1][d]) for r in rows) for d in range(3)]
    exact = {i: sum((7 * int(v[d]) - total[d]) ** 2 for d in range(3)) for i, v in rows}
    assert {r["vec_id"]: r["deviation"] for r in got} == exact


def placed(counts, capacity):
    """Every piece of a plan as rows of window, offset, size; length by length."""
    plan = packing.make_plan(dict(counts), capacity)
    length = np.concatenate([np.full(c, n) for n, c in counts.items()])
    rank = np.concatenate([np.arange(c) for c in counts.values()])
    out = []
    while len(length):
        at = plan.find(length, rank)
        order, head = rank - plan.first[at], plan.head[at]
        size = np.where(head > 0, head, length)
        out.append(np.stack([plan.window[at] + order // plan.each[at], plan.offset[at] + order % plan.each[at] * length, size]))
        cut = head > 0
        length, rank = (length - head)[cut], (plan.rest[at] + order)[cut]
    return plan, np.concatenate(out, axis=1).T


@pytest.mark.parametrize(
    "counts, capacity",
    [({600: 1000}, 1024), ({513: 101, 7: 3}, 1024), ({1: 1}, 1024), ({1023: 5}, 1024), ({3: 5000, 1000: 5, 1024: 7}, 1024)]
    + [(collections.Counter(random.Random(s).randint(1, 50) for _ in range(300)), 50) for s in range(5)]
    + [(collections.Counter(random.Random(s).choice([511, 700, 1000, 3]) for _ in range(3000)), 1024) for s in range(3)],
)
def test_plan_fills_every_window(counts, capacity):
    _, rows = placed(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    for window, group in itertools.groupby(rows.tolist(), key=lambda r: r[0]):
        at = 0
        for _, offset, size in group:
            assert offset == at and size > 0
            at += size
        assert at == capacity or at & (at - 1) == 0, (window, at)
    assert rows[:, 2].sum() == sum(n * c for n, c in counts.items())


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(300):
        counts = {n: rng.randint(1, 4) for n in rng.sample(range(1, 30), rng.randint(1, 4))}
        room = rng.randint(0, 60)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        chosen = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_grows_with_lengths_not_with_pieces():
    few, many = ({n: k * (1 + n % 7) for n in range(1, 1025)} for k in (50, 5_000_000))
    assert len(packing.make_plan(many).first) < 2 * len(packing.make_plan(few).first) < 20_000


def test_packing_query_as_the_library(spark, folder):
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ids = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in docs}
    rows = sorted(QUERIES["op12_packing"](spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for doc, group in itertools.groupby(rows, key=lambda r: r["doc_id"]):
        at = 0
        for r in group:
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids.pop(doc))
    assert not ids
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    for _, group in itertools.groupby(by_place, key=lambda r: r["sequence_id"]):
        total = 0
        for r in group:
            assert r["offset"] == total
            total += r["length"]
        assert total <= 1024 and (total == 1024 or total & (total - 1) == 0)


def test_packing_odd_rows_and_sequences(spark, monkeypatch):
    schema = "doc_id long, text string, id int, length int, part string"
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "word " * 5000), (4, " \n\t"), (5, "é́ <|endoftext|>")]
    docs = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], schema).repartition(3)
    for starts in (packing.STARTS, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(packing, "STARTS", starts)
        pieces = packing.pack(docs, BYTES, capacity=64)
        got = pieces.collect()
        assert collections.Counter(r["doc_id"] for r in got if r["start"] == 0) == {1: 1, 2: 2, None: 1, 3: 1, 4: 1, 5: 1}
        assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    held = packing.sequences(pieces).collect()
    assert sum(r["n_tokens"] for r in held) == sum(r["length"] for r in got) and max(r["n_tokens"] for r in held) == 64
    assert sum(np.frombuffer(r["ids"], "<u4").tolist().count(0) for r in held) >= len(rows)
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def cheapest(rows):
    """Least cost and audit of a list of (initial, fault), by search over what was written so far."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, out
        if (i, out[-1:]) in done:
            continue
        done.add((i, out[-1:]))
        options = [(2, "I", i, out + c) for c in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            options.append((3, "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                options += [(more, "K", i + 1, out + initial)] + [(2 + more, "R", i + 1, out + c) for c in "ua"]
        for c, edit, to, text in options:
            if re.fullmatch("s?(ua)*u?", text):
                heapq.heappush(heap, (cost + c, audit + edit, to, text))


def test_runs_as_by_search():
    rng = random.Random(3)
    for n in [*range(8)] * 200 + [300] * 5:
        repeat = 1 if n < 8 else 20
        rows = [(rng.choice("suax"), rng.choice(conversation_repair.FAULTS)) for _ in range(n)]
        rows = [r for r in rows for _ in range(rng.choice([1, repeat]))]
        letters = [conversation_repair.symbol("suax".index(i), conversation_repair.FAULTS.index(f)) for i, f in rows]
        runs = conversation_repair._collapsed((letter, 1) for letter in letters)
        assert conversation_repair.cheapest(runs) == cheapest(rows)[:2]


def repaired(rows):
    """The contract row by row."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        conv, at, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{at}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols = set(), []
        for _, role, text in own:
            body = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "duplicate" if (role, text) in seen else "none" if body[-1:] in (".", "!", "?") else "truncated"
            symbols.append((role[:1] or "?", fault if body else "blank"))
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit, shape = cheapest(symbols)
        left, held = iter(own), []
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                letter = shape[len(held)]
                held.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[letter]}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == fault for _, f in symbols) for fault in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(symbols)),
            cost,
            audit,
            hashlib.sha256("\n".join(held).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(spark, rows, tmp_path):
    schema = "conv_id long, turn long, role string, text string, conv string, copies int, place int, n int"
    table = spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], schema).repartition(4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def test_repair_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "s", "ufo"], ["Yes.", "no", None, "", " \t", "Ä?\n", "x" * 50_000]
    rows = [
        (rng.choice([None, *range(12)]), rng.choice([None, -5, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)
    ]
    rows += [(50, 1, "user", "same")] * 4 + [(t, t, "user", "Hi.") for t in range(100, 160)]
    assert result(spark, rows, tmp_path) == repaired(rows)


def test_repair_of_one_conversation_over_all_ranges(spark, tmp_path):
    rng = random.Random(8)
    rows = [(1, t, "user" if t % 3 else "assistant", rng.choice(["Same.", "Other.", f"No {t}"])) for t in range(5000)]
    rows += [(2, t, "user", "Same.") for t in range(3000)]
    assert result(spark, rows, tmp_path) == repaired(rows)


def test_repaired_turns_are_rows(spark):
    rows = spark.createDataFrame([(1, 5, "user", "A."), (1, 6, "user", "B.")], "conv_id long, turn long, role string, text string")
    damaged = conversation_repair.damage(rows)
    assert damaged.where("copies = 1").count() == 2
    found = conversation_repair.audits(damaged)
    turns = conversation_repair.repaired(damaged, found).orderBy("place").collect()
    assert [(r["place"], r["edit"], r["turn"], r["role"], r["text"]) for r in turns] == [(0, "K", 5, "user", "A."), (1, "R", 6, "assistant", "B.")]


def test_repair_of_an_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path) == {}
