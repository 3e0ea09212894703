"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of its lower-case words, up to ``ORDER``
letters with the word's boundaries. All models share one array of n-gram hashes, sorted,
with a row of probabilities and of back-off weights for each n-gram; the first bits of a
hash say where to look. A text's cross-entropy under a language is the sum over its words
divided by the letters; the lowest one wins. Words of one slice are scored once each,
together, in numpy.

The models are fitted to the words of all labelled documents. Tasks count n-grams, Spark
sums them, counts continuations and shares each context's mass out; the driver gets the
n-grams of the models alone. These have ``MODEL_CELLS`` n-grams times languages at most:
beyond that a language's rarest n-grams have no row of their own, and their share of
their context stays with the lower order.

A document is rejected when it has no letter, or when its cross-entropy lies above the
bound of its language: the ``CALIBRATED`` quantile over all its labelled documents plus a
margin in bits that shrinks with the text's length. Rejection does not change the
predicted language of a text that has letters.

Results in the odd cases: a null text, or one without letters, is ``und`` with score 0,
and rejected; ties go to the language first in code point order; without a labelled
document everything is ``und``; repeated rows count each time and give repeated rows. Only
text, for learning the label and for ``identify`` the id are read, so extra columns cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import text_slices
from plumbline.llm.common import checkpointed, whole_text

UNKNOWN = "und"
ORDER = 5
#: N-grams of the models times languages, at most: 8 bytes each in every task.
MODEL_CELLS = 2**24
#: Quantile of the calibration, and the decimals of a bit to which its values are counted.
CALIBRATED, DECIMALS = 0.999, 3
#: Bits a letter that every text may lie above the calibrated bound, and more for a short one.
MARGIN, SHORT_MARGIN = 2.0, 60.0
#: Words that a task keeps the bits of, and words that it counts before it hands on their n-grams.
CACHE_WORDS, COUNTED_WORDS = 300_000, 100_000
#: Words whose n-grams are in memory at once, some 20 MB of numbers.
PART_WORDS = 16_384
_WORD = re.compile(r"[^\W\d_]+")
#: Symbols that begin and end a word; no letter has these codes.
BEGIN, END = 1, 2
_PLACES = [f"s{i}" for i in range(1, ORDER + 1)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, each ended by END, and where each word begins."""
    joined = "".join(w + "\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(codes == END)
    return codes, np.r_[0, ends[:-1] + 1]


def _backs(codes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The symbol 0, 1, ... places before each symbol; BEGIN fills up the front of a word."""
    place = np.arange(len(codes)) - np.repeat(begins, np.diff(np.r_[begins, len(codes)]))
    out = []
    for n in range(ORDER):
        back = np.roll(codes, n)
        back[place < n] = BEGIN
        out.append(back)
    return out


def _hashes(backs: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of the n-gram of the last n symbols, for n from 0."""
    hashes = [np.zeros(len(backs[0]) if backs else 0, np.uint64)]
    for n, back in enumerate(backs, 1):
        h = (hashes[-1] ^ (back + np.uint64(n << 40))) * _MIX
        hashes.append(h ^ (h >> np.uint64(31)))
    return hashes


@dataclass(frozen=True)
class Models:
    """Per n-gram and language: probability, and weight of the lower order after it; bounds for rejection."""

    languages: list[str]
    keys: np.ndarray
    chance: np.ndarray
    back_off: np.ndarray
    floor: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray

    @cached_property
    def _longest(self) -> int:
        return int(np.diff(self.starts).max())

    def _rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash; the last row stands for an unseen n-gram."""
        bits = (len(self.starts) - 1).bit_length() - 1
        at = self.starts[hashes >> np.uint64(64 - bits)].astype(np.intp)
        for _ in range(self._longest):
            at += self.keys[np.minimum(at, len(self.keys) - 1)] < hashes
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes
        return np.where(found, at, len(self.keys))

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word, with its end, under each language."""
        if not self.languages:
            return np.zeros((len(words), 0))
        codes, begins = _symbols(words)
        fronts = self._rows(np.concatenate(_hashes([np.full(1, BEGIN, np.uint64)] * ORDER)))
        p = np.repeat(self.floor[None, :], len(codes), axis=0)
        lower = np.full(len(codes), fronts[0])
        for n, gram in enumerate(_hashes(_backs(codes, begins))[1:], 1):
            # The context of a symbol is the shorter n-gram that ended at the symbol before it.
            context = np.roll(lower, 1)
            context[begins] = fronts[n - 1]
            lower = self._rows(gram)
            p *= self.back_off[context]
            p += self.chance[lower]
        return np.add.reduceat(-np.log2(p), begins, axis=0)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Place of the first key with each of the first bits, some four times as many as there are keys."""
    bits = max(1, int(len(keys)).bit_length() + 1)
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)


class Scorer:
    """Cross-entropies of texts, with a cache of words."""

    def __init__(self, models: Models):
        self.models = models
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = defaultdict(itertools.count().__next__)  # a new word gets the next place
        self.rows = np.zeros((0, len(self.models.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Rows of the words that the cache has got since the last call."""
        self.rows = np.concatenate([self.rows, self.models.bits(words).astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.array([sum(map(str.isalpha, w)) for w in words])])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text under each language, and its letters."""
        if len(self.cache) > CACHE_WORDS:
            self._forget()
        cut = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sizes.sum())
        new = len(self.cache) - len(self.letters)
        if new:
            self._learn(list(itertools.islice(reversed(self.cache), new))[::-1])
        bits = np.zeros((len(texts), len(self.models.languages)))
        letters = np.zeros(len(texts), np.int64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            begins = np.cumsum(sizes[filled]) - sizes[filled]
            letters[filled] = np.add.reduceat(self.letters[at], begins)
            bits[filled] = np.add.reduceat(self.rows[at], begins, axis=0, dtype=np.float64)
            bits /= np.maximum(1, letters + sizes)[:, None]
        return bits, letters


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels and texts become the n-grams of ORDER symbols in them; no count is lost, some n-grams come several times."""

    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counts in held.items():
            words = sorted(counts)  # words with the same beginning share n-grams
            for begin in range(0, len(words), PART_WORDS):
                part = words[begin : begin + PART_WORDS]
                codes, begins = _symbols(part)
                weight = np.repeat(np.array([counts[w] for w in part]), np.diff(np.r_[begins, len(codes)]))
                backs = _backs(codes, begins)
                _, first, inverse = np.unique(_hashes(backs)[ORDER], return_index=True, return_inverse=True)
                cells = [pa.array(back[first].astype(np.int32)) for back in reversed(backs)]
                sums = pa.array(np.bincount(inverse, weight).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(first), pa.string()), *cells, sums], ["label", *_PLACES, "n"])

    held: dict[str, Counter] = {}
    for labels, texts in text_slices(batches):
        for label, text in zip(labels.to_pylist(), texts):
            held.setdefault(label, Counter()).update(words_of(text))
        if sum(map(len, held.values())) > COUNTED_WORDS:
            yield from out(held)
            held = {}
    yield from out(held)


def _orders(rows: DataFrame) -> DataFrame:
    """label, n, the last n symbols of an n-gram (0 in other places) and c: its number, for a shorter one of symbols seen before it."""
    kinds = ", ".join(f"{p} int" for p in _PLACES)
    grams = rows.mapInArrow(_counted, f"label string, {kinds}, n long")
    grams = checkpointed(grams.groupBy("label", *_PLACES).agg(F.sum("n").alias("c")))
    parts = []
    for n in range(ORDER, 0, -1):
        own = _PLACES[ORDER - n :]
        if n < ORDER:
            grams = grams.groupBy("label", *own).agg(F.count(F.lit(1)).alias("c"))
        none = [F.lit(0).alias(p) for p in _PLACES[: ORDER - n]]
        parts.append(grams.select("label", F.lit(n).alias("n"), *none, *own, "c"))
    return checkpointed(reduce(DataFrame.unionAll, parts))


def fit(rows: DataFrame, model_cells: int = MODEL_CELLS, alphabet_floor: float = 1e-5) -> Models:
    """Models, without bounds for rejection, from rows of label and text."""
    orders = _orders(rows)
    sizes = orders.groupBy("label", "n").agg(
        F.count(F.lit(1)).alias("grams"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    )
    sizes = {(r["label"], r["n"]): r for r in sizes.collect()}
    languages = sorted({label for label, _ in sizes})
    if not languages:
        return Models([], *[np.zeros(0)] * 6)
    # Longer n-grams get more of the room, half of what is left each time.
    room = {n: model_cells // len(languages) ** 2 >> (ORDER - n + 1) for n in range(1, ORDER + 1)}
    least = dict.fromkeys(sizes, 1)
    full = [(label, n) for (label, n), r in sizes.items() if r["grams"] > room[n]]
    if full:
        spark = orders.sparkSession
        wide = F.broadcast(spark.createDataFrame(full, "label string, n int"))
        for (label, n), found in _by_count(orders.join(wide, ["label", "n"])).items():
            kept = np.cumsum(found[:, 1]) <= room[n]  # from the highest count down
            least[label, n] = int(found[kept][-1, 0]) if kept.any() else int(found[0, 0]) + 1
    # Ney's estimate of the discount.
    discounts = [
        (*at, min(0.95, max(0.1, r["once"] / max(1, r["once"] + 2 * r["twice"]))), least[at]) for at, r in sizes.items()
    ]
    discounts = F.broadcast(orders.sparkSession.createDataFrame(discounts, "label string, n int, off double, least long"))
    context = Window.partitionBy("label", "n", *_PLACES[:-1])
    c, off, known = F.col("c"), F.col("off"), F.col("c") >= F.col("least")
    grams = (
        orders.join(discounts, ["label", "n"])
        .withColumn("total", F.sum("c").over(context))
        .withColumn("back_off", F.sum(F.when(known, F.least(c, off)).otherwise(c)).over(context) / F.col("total"))
        .where(known)
        .select("label", "n", *_PLACES, (F.greatest(c - off, F.lit(0.0)) / F.col("total")).alias("chance"), "back_off")
        .toArrow()
    )
    index = {label: i for i, label in enumerate(languages)}
    places = np.array([index[label] for label in grams["label"].to_pylist()], np.intp)
    orders_of, share, rest = (grams[name].to_numpy() for name in ("n", "chance", "back_off"))
    backs = [grams[p].to_numpy().astype(np.uint64) for p in reversed(_PLACES)]
    key, before = _hashes(backs), _hashes(backs[1:])
    rows_of = np.arange(len(orders_of))
    key, before = np.stack(key)[orders_of, rows_of], np.stack(before)[orders_of - 1, rows_of]
    keys = np.unique(np.concatenate([key, before]))
    chance = np.zeros((len(keys) + 1, len(languages)), np.float32)
    back_off = np.ones((len(keys) + 1, len(languages)), np.float32)
    chance[np.searchsorted(keys, key), places] = share
    back_off[np.searchsorted(keys, before), places] = rest
    floor = np.full(len(languages), alphabet_floor)
    return Models(languages, keys, chance, back_off, floor, np.full(len(languages), np.inf), _starts(keys))


def _by_count(orders: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """How many n-grams have each count, by language and order, from the highest count down."""
    found: dict[tuple[str, int], list] = {}
    for r in orders.groupBy("label", "n", "c").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("c")).collect():
        found.setdefault((r["label"], r["n"]), []).append((r["c"], r["grams"]))
    return {at: np.array(pairs) for at, pairs in found.items()}


def learn(docs: DataFrame, label_column: str = "lang", text_column: str = "text", model_cells: int = MODEL_CELLS) -> Models:
    """Models and bounds from all labelled documents."""
    rows = docs.select(F.col(f"`{label_column}`").cast("string").alias("label"), whole_text(text_column).alias("text"))
    rows = rows.where("label is not null")
    models = fit(rows, model_cells)
    if not models.languages:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def excess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for labels, texts in text_slices(batches):
            bits, letters = scorer.entropies(texts)
            over = bits.min(axis=1) - SHORT_MARGIN / np.maximum(1, letters)
            yield pa.RecordBatch.from_arrays([labels, pa.array(over), pa.array(letters)], ["label", "over", "letters"])

    over = rows.mapInArrow(excess, "label string, over double, letters long").where("letters > 0")
    over = over.groupBy("label", F.round("over", DECIMALS).alias("over")).agg(F.count(F.lit(1)).alias("docs"))
    limits = over.groupBy("label").agg(F.percentile("over", F.lit(CALIBRATED), F.col("docs")).alias("q"))
    found = {r["label"]: r["q"] for r in limits.collect()}
    shared.destroy()  # executors need not hold these models beside those with bounds
    bounds = np.array([found.get(k, np.inf) + MARGIN for k in models.languages])
    return replace(models, bounds=bounds)


def _judged(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language (the last one for none), score, bits and rejection of each text."""
    models = scorer.models
    bits, letters = scorer.entropies(texts)
    none = (letters == 0) | (not models.languages)
    if models.languages:
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1 / np.exp2(-4 * (bits - least[:, None])).sum(axis=1)
        over = least - SHORT_MARGIN / np.maximum(1, letters) > models.bounds[best]
    else:
        best, least = np.zeros(len(texts), int), np.zeros(len(texts))
        score, over = least, least > 0
    place = np.where(none, len(models.languages), best)
    return place, np.where(none, 0.0, score), np.where(none, 0.0, least), none | over


def identify(docs: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, language, score (share of the best among the models, 0 to 1), bits, rejected."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN])
        scorer = Scorer(shared.value)
        for ids, texts in text_slices(batches):
            place, *rest = _judged(scorer, texts)
            columns = [ids, pa.array(names[place]), *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "bits", "rejected"])

    rows = docs.select(docs[id_column].alias("id"), whole_text(text_column).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double, rejected boolean")
    return out.withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, models: Models, text_column: str = "text") -> DataFrame:
    """The documents that are not rejected, in their own columns; only texts go to Python, and one flag comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("boolean")
    def rejected(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in columns:
            batch = pa.RecordBatch.from_arrays([texts, texts], ["id", "text"])
            flags = [_judged(scorer, held)[3] for _, held in text_slices([batch])]
            yield pa.array(np.concatenate([np.zeros(0, bool), *flags]))

    return docs.where(~rejected(whole_text(text_column)))
