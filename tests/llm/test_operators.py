"""The corpus operators against brute force, exact round trips and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    lm_scoring,
    near_dedup,
    source_mix,
    token_files,
    url_filter,
)
from plumbline.llm.components import components
from plumbline.llm.queries import CHECKS, QUERIES
from plumbline.llm.subwords import SubwordEncoder

WORD_END = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `id` int, `kept` int"
ODD = [
    (1, None, "en", "a", 0, "x", 1, 1),
    (2, "", None, None, 0, "x", 1, 1),
    (2, "", None, None, 0, "x", 1, 1),
    (3, " \t\n", "en", "a", 3, "x", 1, 1),
    (None, "one two three four five six", "en", None, 9, "x", 1, 1),
    (4, "one  two three four five\nsix", "en", "a", 9, "x", 1, 1),
    (5, "one two three four five six seven eight", "en", "b", 9, "x", 1, 1),
    (6, "lang " * 30_000, "de", "b", 9, "x", 1, 1),
    (7, "x" * 200_000, "de", "b", 9, "x", 1, 1),
    (8, "123 !!! <|endoftext|> ΣΑΣ é́ don't", None, "b", 9, "x", 1, 1),
]
TEXTS = [r[1] or "" for r in ODD] + ["a  b \n c\n\nd \n", " lead", "\nx", "½ × ÷ é×é", "12ab  \t\n", "it's.. !a", "  "]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(spark, folder, name):
    assert difference(spark, connect(folder), QUERIES[name], CHECKS[name], folder) is None


def test_exact_odd_rows(odd, empty):
    rows = exact_dedup.exact_groups(odd, ranges=4).collect()
    assert len(rows) == len(ODD) and sum(r["kept"] for r in rows) == 7
    groups = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in rows}
    assert groups[hashlib.sha256(b"").hexdigest()] == (1, 3)
    assert groups[hashlib.sha256(b"one two three four five six").hexdigest()] == (4, 2)
    kept = exact_dedup.exact_dedup(odd, ranges=4)
    assert kept.columns == odd.columns and kept.count() == 7
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def test_exact_copies_spread_over_ranges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rows = exact_dedup.exact_groups(docs, ranges=16).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(0, 4000)} and sum(r["kept"] for r in rows) == 1
    assert exact_dedup.exact_dedup(docs, ranges=16).count() == 1


def test_bpe_as_the_library(odd, empty):
    library = Tokenizer.from_file(WORD_END)
    ours = bpe.WordEndBpe(WORD_END)
    for text, ids in zip(TEXTS, ours.encode_batch(TEXTS)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(odd, WORD_END).count() == len(ODD)
    assert bpe.encode_decode(empty, WORD_END).count() == 0


def test_subwords_as_the_library():
    library = Tokenizer.from_file(BYTES)
    ids, counts = SubwordEncoder(BYTES).encode_flat(TEXTS)
    for text, got in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("ids", [[], [5], [7] * 256, [0, 2**32 - 1], list(range(700)), [3] * 255 + [2**31]])
def test_blocks_round_trip(ids):
    assert token_files.unpack(token_files.pack(np.array(ids, np.int64))).tolist() == ids


def test_token_files(spark, folder, odd, empty):
    library, at = Tokenizer.from_file(BYTES), 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in sorted(QUERIES["op6_token_files"](spark, folder).collect()):
        want = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert token_files.write_and_read(odd, BYTES).count() == len(ODD)
    assert token_files.write_and_read(empty, BYTES).count() == 0


def test_language_held_out(spark, folder, odd, empty):
    rows = QUERIES["op4_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert rows.where("rejected or score < 0 or score > 1").count() == 0
    models = language_id.learn(odd)
    found = {r["doc_id"]: r for r in language_id.identify(odd, models).collect()}
    assert found[1]["lang_pred"] == found[3]["lang_pred"] == "und" and found[1]["rejected"]
    assert language_id.accepted(odd, models).columns == odd.columns
    nothing = language_id.identify(odd, language_id.learn(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def _kneser_ney(texts):
    """Chance of each n-gram and weight of the order below each context, counted over all texts."""
    full = collections.Counter()
    for text in texts:
        for word in language_id.words_of(text):
            symbols = "\x01" * (language_id.ORDER - 1) + word + "\x02"
            full.update(symbols[i : i + language_id.ORDER] for i in range(len(symbols) - language_id.ORDER + 1))
    chance, rest, counts = {}, {}, full
    for n in range(language_id.ORDER, 0, -1):
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        off = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        total, kinds = collections.Counter(), collections.Counter()
        for gram, c in counts.items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        chance.update({gram: (c - off) / total[gram[:-1]] for gram, c in counts.items()})
        rest.update({context: off * kinds[context] / total[context] for context in total})
        counts = collections.Counter(gram[1:] for gram in counts)
    return chance, rest


def _kneser_ney_bits(chance, rest, word):
    symbols, bits = "\x01" * (language_id.ORDER - 1) + word + "\x02", 0.0
    for i in range(language_id.ORDER, len(symbols) + 1):
        p = 1e-5
        for n in range(1, language_id.ORDER + 1):
            gram = symbols[i - n : i]
            p = chance.get(gram, 0.0) + rest.get(gram[:-1], 1.0) * p
        bits -= np.log2(p)
    return bits


def _spelled(number):
    return "".join(chr(97 + int(d)) for d in str(number * 7919))


def test_language_learns_from_every_labelled_document(spark):
    texts = {
        "aa": [f"{_spelled(i)} {_spelled(i % 50)} ab" for i in range(2_000)],
        "bb": [f"{_spelled(i)[::-1]}xyz" + " zz" * (i % 3) for i in range(1_500)],
    }
    texts["bb"][700] += " qqqqqqqq wwwwww qkwk"  # the one text far from the others
    rows = [(lang, text) for lang, held in texts.items() for text in held] + [("aa", None), (None, "zzz"), ("cc", "12 !")]
    models = language_id.learn(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert models.languages == ["aa", "bb"]
    brute = [_kneser_ney(texts[lang]) for lang in models.languages]
    words = sorted({w for held in texts.values() for t in held for w in language_id.words_of(t)}) + ["unseen", "é"]
    expected = np.array([[_kneser_ney_bits(*tables, w) for tables in brute] for w in words])
    np.testing.assert_allclose(models.bits(words), expected, rtol=1e-5)
    spelled = dict(zip(words, expected))
    for i, lang in enumerate(models.languages):
        over = []
        for text in texts[lang]:
            held = language_id.words_of(text)
            letters = sum(map(len, held))
            over.append(min(sum(spelled[w] for w in held)) / (letters + len(held)) - language_id.SHORT_MARGIN / letters)
        assert models.bounds[i] == pytest.approx(np.quantile(over, language_id.CALIBRATED) + language_id.MARGIN, abs=2e-3)


def test_language_models_of_bounded_size_keep_the_mass(spark):
    texts = [f"{_spelled(i)} {_spelled(i % 50)} ab" for i in range(500)]
    rows = spark.createDataFrame([("aa", t) for t in texts], "label string, text string")
    whole, small = language_id.fit(rows), language_id.fit(rows, model_cells=400)
    assert len(small.keys) < len(whole.keys) / 2 and len(small.keys) < 800
    words = ["\x01" * (language_id.ORDER - 1) + w + "\x02" for t in texts for w in language_id.words_of(t)]
    symbols = sorted(set("".join(words)) - {"\x01"})

    def rows_of(models, grams):
        codes = [np.array([ord(g[-1 - n]) for g in grams], np.uint64) for n in range(len(grams[0]))]
        return models._rows(language_id._hashes(codes)[-1] if codes else np.zeros(len(grams), np.uint64))

    for models in (whole, small):
        for n in range(language_id.ORDER):
            contexts = sorted({w[i - n : i] for w in words for i in range(language_id.ORDER - 1, len(w))})
            shares = sum(models.chance[rows_of(models, [c + s for c in contexts]), 0].astype(float) for s in symbols)
            np.testing.assert_allclose(shares + models.back_off[rows_of(models, contexts), 0], 1, atol=1e-6)


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_classes(spark, folder, odd, empty):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op5_near_dedup"](spark, folder).collect()}
    sets = {r["doc_id"]: _shingles(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) > 0.5 * max(len(sets[a]), len(sets[b])):
                near = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if near >= 0.85:
                    assert got[a] == got[b], (a, b, near)
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == len(ODD)
    assert near_dedup.near_dedup(odd).columns == odd.columns
    assert near_dedup.near_dedup(odd).count() == len(ODD) - 1  # ids 4 and null hold the same words
    assert near_dedup.near_dedup(empty).count() == 0


def test_embeddings_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1)]
    rows += [(6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0], 1), (10, [], 1), (None, [1.0, 0.1], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows) and by_id[1] == (3, 1, True) and by_id[2] == (3, 1, False)
    assert by_id[None] == (3, 1, False)
    assert all(by_id[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embedding_links_of_all_rows(spark):
    """Clouds around shared centres, against all pairs; a pair at exactly the threshold; clashing columns."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((150, 32))
    vectors = centres[rng.integers(0, 150, 900)] + 0.22 * rng.standard_normal((900, 32))
    vectors[:2] = 0
    vectors[0, 0], vectors[1, :2] = 1, (0.6, 0.8)
    rows = [(i, v.tolist(), 1, "x", 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, shared int")
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (units @ units.T >= 0.93).sum(axis=1) - 1
    for block in (512, 3):  # a small block cuts buckets into slices
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert want.sum() > 500 and sum(got.values()) >= 0.99 * want.sum()
        assert all(got[i] <= want[i] for i in got)
    two = df.where("vec_id < 2")
    assert [r["n_links"] for r in embedding_dedup.near_duplicates(two, threshold=0.6).collect()] == [1, 1]


def test_embedding_tables_follow_the_label():
    """Unrelated vectors met stay few, and near pairs found, at every size."""
    near, far = (embedding_dedup.same_step(math.sqrt(2 - 2 * c)) for c in (0.93, 0.0))
    for n in (10, 1_000, 100_000, 10**9):
        k, tables = embedding_dedup.plan(n, 0.93)
        assert n * tables * far**k <= embedding_dedup.STRANGERS and (1 - near**k) ** tables <= embedding_dedup.MISSED


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def test_mix(spark, folder, odd, empty):
    rows = QUERIES["op10_source_mix"](spark, folder).collect()
    again = source_mix.mix(spark.read.parquet(f"{folder}/documents.parquet").repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    taken, target, most = collections.Counter(), {}, collections.Counter()
    for r in again:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    sizes = {r["source"]: r["source_size"] for r in again}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:  # excess reshared by weight until none is above its limit
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not above:
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    want |= {s: level * weights[s] for s in open_}
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in want)
    assert source_mix.mix(odd).count() == len(ODD) and source_mix.mixed(odd).columns == odd.columns
    assert source_mix.mix(empty).count() == source_mix.mixed(empty).count() == 0


def test_urls_odd_rows(spark):
    urls = [None, "", "no scheme", "http://A.net", "http://a.NET/", "http://b.example.net/en/x?q", "ftp://notnet/", "x://org/fr/#a"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = url_filter.judge(pages, [("net", "/")], [("example.net", "/en/"), ("org", "/fr/")]).orderBy("page_id").collect()
    rules = [None, None, None, None, "net/", "example.net/en/", None, "org/fr/"]
    assert [r["rule"] for r in got] == rules
    assert [r["verdict"] for r in got] == ["block" if r == "net/" else "allow" for r in rules]
    assert url_filter.judge(pages.limit(0), [("net", "/")], []).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    listed = keys.where("cast(key as int) % 7 = 0")
    held = url_filter.cascade(listed, keys)
    rows = keys.select("key", *url_filter._hashes(F.col("key"))).toPandas()
    inside = held.passed(rows["one"].to_numpy(), rows["two"].to_numpy()) % 2 == 1
    assert (inside == (rows["key"].astype(int) % 7 == 0)).all()


def test_licenses(spark, odd, empty):
    texts = ["Copyright 2020 X\nreleased under the mit LICENCE", "a\nLicensed under CC BY-NC 4.0.\nb", "none", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["license_of_text"], r["licenses"]) for r in license_scan.scan(docs).collect()}
    assert got == {0: ("MIT", ["MIT"]), 1: (None, ["CC-BY-NC-4.0"]), 2: (None, []), 3: (None, [])}
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


def test_lm_base_and_odd_rows(odd, empty):
    rows = lm_scoring.score(odd, F.lit(True), BYTES).collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") + [None] for r in ODD]
    counts = collections.Counter(w for ws in words for w in ws)
    total = sum(counts.values())
    want = sorted(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws) for ws in words)
    assert np.allclose(sorted(r["base_score"] for r in rows), want) and {r["train_tokens"] for r in rows} == {total}
    assert all(r["score"] < 0 for r in rows)
    assert lm_scoring.score(empty, F.lit(True), BYTES).count() == 0


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    held = lm_scoring.Subwords(BYTES)
    end = held.size - 1
    ids, sizes = held.sequences(lm_scoring.words_of(["the cat sat on the mat and then some"] * 3), end)
    initial = np.arange(held.size) % 2 == 0
    reader = lm_scoring.Reader(
        lm_scoring.fresh(ids, sizes, initial, end, rng),
        rng.integers(0, 9, held.size).astype(float),
        rng.integers(0, 3, (lm_scoring.PAIRED, lm_scoring.PAIRED)).astype(float),
        end,
    )
    # All continuations of one text: their probabilities add up to 1.
    flat = np.empty(2 * held.size, np.int64)
    flat[::2], flat[1::2] = ids[0], np.arange(held.size)
    chances = reader.log_chances(flat, np.full(held.size, 2))
    assert abs(np.exp(chances[1::2]).sum() - 1) < 1e-3


def test_pipeline(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_lm_counts_pairs_across_words_of_all_documents(spark, folder, monkeypatch):
    rows = [(i, f"alpha{i % 3} beta{i % 3}", True) for i in range(300)] + [(900, "alpha1 beta1", False), (901, "alpha1 beta2", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, F.col("t"), BYTES).where("doc_id >= 900").collect()}
    assert got[900] > got[901]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = lm_scoring.Subwords(BYTES)
    table = lm_scoring.encoded(docs, F.lit(True), BYTES, "doc_id", "text", 3)
    counts = lm_scoring.corpus_counts(table, lm_scoring.initial_ids(held)).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids, _ = held.sequences(lm_scoring.words_of([r["text"] or ""]), held.size - 1)
        want.update(zip([held.size - 1, *ids[:-1].tolist()], ids.tolist()))
    assert {divmod(r["key"], held.size): r["n"] for r in counts if r["kind"] == lm_scoring.PAIR} == want
    # Pairs that tasks hold and pairs that are joined count alike.
    held_out = F.col("doc_id") % 5 != 2
    one = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, held_out, BYTES).collect()}
    monkeypatch.setattr(lm_scoring, "HOT_PAIRS", 0)
    two = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, held_out, BYTES).collect()}
    assert all(math.isclose(one[k], two[k], rel_tol=1e-6) for k in one)


def _start(texts):
    held = lm_scoring.Subwords(BYTES)
    end = held.size - 1
    ids, sizes = held.sequences(lm_scoring.words_of(texts), end)
    model = lm_scoring.fresh(ids, sizes, np.arange(held.size) % 2 == 0, end, np.random.default_rng(0))
    return held, end, ids, sizes, model


LM_TEXTS = ["the cat sat on the mat", "and then some more of it " * 20, "", "mat cat"]


def test_lm_gradient_of_all_windows():
    _, end, ids, sizes, model = _start(LM_TEXTS)
    inputs, depth, targets = lm_scoring.windows(ids, sizes, end)
    targets.reshape(-1)[len(ids) :] = -1
    grad = lm_scoring._zeros(model, np.float64)
    assert lm_scoring.gradients(model, inputs, depth, targets, grad) == len(ids)

    def loss(name, table):
        setattr(model, name, table)
        return -np.log(_class_chances(model, ids, sizes, end)).sum()

    for name in model.trained():
        table = getattr(model, name)
        place = np.unravel_index(np.abs(grad[name]).argmax(), table.shape)
        step = np.zeros_like(table)
        step[place] = 1e-2
        slope = (loss(name, table + step) - loss(name, table - step)) / 2e-2
        setattr(model, name, table)
        assert math.isclose(slope, grad[name][place], rel_tol=3e-2, abs_tol=1e-2), name


def test_lm_gradient_of_windows_in_a_row(monkeypatch):
    """Windows that share their halves, in parts, learn what the same windows learn one by one."""
    monkeypatch.setattr(lm_scoring, "PART", 3)
    _, end, ids, sizes, model = _start(LM_TEXTS)
    inputs, depth, targets = lm_scoring.windows(ids, sizes, end)
    targets.reshape(-1)[len(ids) :] = -1
    weights, row, alone = (lm_scoring.Weights(model, zero=z) for z in (False, True, True))
    assert lm_scoring.batch_gradients(weights, model, inputs, depth, targets, row, in_row=True) == len(ids)
    for w in range(len(inputs)):
        one = slice(w, w + 1)
        lm_scoring.batch_gradients(weights, model, inputs[one], depth[one], targets[one], alone)
    assert np.allclose(row.flat, alone.flat, atol=1e-5) and np.abs(row.flat).max() > 0.1
    # Weights so large that exponentials would overflow.
    model.query, model.out = model.query * 300, model.out * 300
    large = lm_scoring.Weights(model, zero=True)
    lm_scoring.batch_gradients(lm_scoring.Weights(model), model, inputs, depth, targets, large, in_row=True)
    assert np.isfinite(large.flat).all() and np.abs(large.bias).max() <= len(ids)


def test_lm_adam_moves_by_the_rule():
    _, end, ids, sizes, model = _start(LM_TEXTS)
    inputs, depth, targets = lm_scoring.windows(ids, sizes, end)
    adam, want = lm_scoring.Adam(model, 1e-6), lm_scoring.Weights(model).flat.astype(np.float64)
    first, second = np.zeros_like(want), np.zeros_like(want)
    for step in (1, 2, 3):
        n = adam.learn(inputs, depth, targets, in_row=True)
        grad = adam.grad.flat.astype(np.float64) / n
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        want -= 0.01 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        adam.move(n, 0.01)
        assert np.allclose(adam.weights.flat, want, atol=1e-4)
    assert np.array_equal(lm_scoring.Weights(adam.moved()).flat, adam.weights.flat)


def test_lm_round_averages_what_tasks_learn(spark):
    texts = [f"{a} {b} and {a}" * (1 + i % 5) for i, (a, b) in enumerate(zip("red green blue " * 40, "cat dog bird " * 40))]
    held, end, ids, sizes, model = _start(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lm_scoring.encoded(docs.repartition(3), F.lit(True), BYTES, "id", "text", 3)
    rows = table.collect()
    assert sorted(r["ids"] for r in rows) == sorted(
        held.sequences(lm_scoring.words_of([t]), end)[0].astype("<u2").tobytes() for t in texts
    )
    assert all(0 <= r["draw"] < 1 for r in rows) and len({r["draw"] for r in rows}) == len(rows)
    one = lm_scoring.corpus_round(table.coalesce(1), model, end, 0.01)
    in_order = [lm_scoring._values(pa.array([r["ids"]]), "<u2") for r in table.coalesce(1).collect()]
    whole = (np.concatenate([i for i, _ in in_order]), np.concatenate([n for _, n in in_order]))
    want, places = lm_scoring.learned(model, iter([whole]), end, 0.01)
    assert places == len(ids)
    for name in model.trained():
        assert np.allclose(getattr(one, name), getattr(want, name), atol=1e-5), name
    # Many tasks go through the tree; all of them count by their places.
    many = lm_scoring.corpus_round(table.repartition(2 * lm_scoring.MERGED + 3), model, end, 0.01)

    def loss(model):
        return -np.log(_class_chances(model, ids, sizes, end)).sum()

    assert loss(one) < loss(model) and loss(many) < loss(model)
    none = lm_scoring.corpus_round(table.where("false"), model, end, 0.01)
    assert np.array_equal(lm_scoring._flat(none), lm_scoring._flat(model))


def test_lm_scores_as_the_model_says():
    """The reader's class chances are those of the plain forward pass."""
    held, end, ids, sizes, model = _start(LM_TEXTS)
    counts = np.bincount(ids, minlength=held.size).astype(float)
    reader = lm_scoring.Reader(model, counts, np.zeros((lm_scoring.PAIRED, lm_scoring.PAIRED)), end)
    mass = np.bincount(model.group, weights=counts + 1, minlength=lm_scoring.CLASSES)
    inside = (counts[ids] + 1) / mass[model.group[ids]]
    want = np.log(_class_chances(model, ids, sizes, end)) + np.log(inside)
    assert np.allclose(reader.log_chances(ids, sizes), want, atol=1e-3)


def _class_chances(model, ids, sizes, end):
    inputs, depth, targets = lm_scoring.windows(ids, sizes, end)
    z = np.exp(lm_scoring._forward(model, inputs, depth)[-1])
    z /= z.sum(axis=1, keepdims=True)
    return z[np.arange(len(ids)), model.group[targets.reshape(-1)[: len(ids)]]].tolist()


def test_whole_licenses_however_wrapped(spark):
    import textwrap
    from pathlib import Path

    bodies = {f.stem: f.read_text() for f in Path(license_scan.__file__).parent.joinpath("license_texts").glob("*.txt")}
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0"} == set(bodies)
    cases = []
    for name, body in bodies.items():
        cases.append((name, name, body))
        body = body.split("END OF TERMS AND CONDITIONS")[0]  # the appendix has copyright lines to fill in
        for width in (40, 61, 78):
            apart = re.sub(r"(?m)^(\s*Copyright \([cC]\) .*)$", r"\1\n", body)  # such lines stand alone
            paragraphs = re.split(r"\n\s*\n", apart)
            wrapped = "\n\n".join(
                x if x.lstrip().startswith("Copyright (C)") else textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False)
                for x in paragraphs
            )
            cases += [(name, name, wrapped), (None, name, f"Some words before.\n\n# Copyright (c) 2020 X\n\n{wrapped}\n\nand after")]
    cases.append((None, "Apache-2.0", "About.\nLicensed under the Apache License,\nVersion 2.0.\nMore."))
    cases.append(("MIT", "MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + bodies["MIT"]))
    curly = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", bodies["MIT"]).replace("copy, modify", "copy\u2014modify")
    cases.append(("MIT", "MIT", curly))
    one_line = " ".join(bodies["MIT"].split())
    cases.append(("MIT", "MIT", "Copyright (c) 2020 X\nCopyright (c) 2021 Y " + one_line))
    cases.append((None, "MIT", "Copyright (c) 2020 X " + one_line + " More words."))
    cases.append((None, "MIT", "Some words. Copyright (c) 2020 X " + one_line))
    docs = spark.createDataFrame([(i, c[2]) for i, c in enumerate(cases)], "doc_id int, text string")
    found = license_scan.scan(docs)
    for r in found.collect():
        whole, name, text = cases[r["doc_id"]]
        assert r["license_of_text"] == whole and name in r["licenses"], (name, text[:60], r)
    # The checking SQL states the runs too.
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(CHECKS["op9_license_scan"]).fetchall()
    assert sorted(want) == sorted((r["doc_id"], r["license_of_text"], ",".join(r["licenses"])) for r in found.collect())


def test_licenses_work_follows_the_text_not_their_number(spark):
    """A thousand licences: same plan, each found; a notice inside a line is none."""
    known = [(f"L{i}", f"Permission number {i} is granted to all who ask") for i in range(1000)]
    texts = [known[7][1], f"a\n{known[8][1][:20]}\n{known[8][1][20:]}\nb", f"a {known[9][1]} b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["license_of_text"], r["licenses"]) for r in license_scan.scan(docs, known).collect()}
    assert got == {0: ("L7", ["L7"]), 1: (None, ["L8"]), 2: (None, [])}


def test_pieces_are_held_by_hash_over_slices(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    encoder, sent, plain = SubwordEncoder(BYTES, cache_pieces=60), [], SubwordEncoder._split_ids

    def noted(self, parts):
        sent.append(parts)
        return plain(self, parts)

    monkeypatch.setattr(SubwordEncoder, "_split_ids", noted)
    slices = [["red fox  12", "", "a\n\n b\tc é"], ["red fox", " fox red 12  "], [" ".join(f"w{i}" for i in range(80))], ["red fox\n"], ["red fox"]]
    for texts in slices:
        ids, counts = encoder.encode_flat(texts)
        wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
        assert (np.diff(encoder.pieces.hashes.astype(object)) > 0).all() and not encoder.cache
    # Only new pieces are encoded, and a full cache is emptied before the next texts.
    assert [sorted(p) for p in sent[1:]] == [[b" red"], sorted([b"w", *[b" w"], *{str(i).encode() for i in range(80)}]), [b" fox", b"red"]]


def test_lm_words_are_held_by_hash(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 4)
    held, sent, plain = lm_scoring.Subwords(BYTES), [], SubwordEncoder.encode_flat

    def noted(self, texts):
        sent.append(sorted(texts))
        return plain(self, texts)

    monkeypatch.setattr(SubwordEncoder, "encode_flat", noted)
    end = held.size - 1
    slices = [["Red  fox", "", "RED"], ["red\tdog fox"], ["", " "], ["It's été <|endoftext|> x"], ["red"]]
    for texts in slices:
        ids, sizes = held.sequences(lm_scoring.words_of(texts), end)
        lower = ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
        parts = [[plain(held.encoder, [" " + w])[0].tolist() for w in t.split()] for t in lower]
        assert ids.tolist() == [i for p in parts for i in [*sum(p, []), end]]
        assert sizes.tolist() == [sum(map(len, p)) + 1 for p in parts]
        assert isinstance(held.cache.store, np.ndarray)
    assert sent == [[" fox", " red"], [" dog"], sorted([" it's", " été", " <|endoftext|>", " x"]), [" red"]]
