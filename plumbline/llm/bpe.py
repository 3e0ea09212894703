"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

The merges run in numpy over many words at once. The symbols of all words lie in one
flat array. A round looks every neighbouring pair up by binary search among the sorted
pair keys, takes the lowest rank of each word, merges all its places from left to right,
and sets words without a known pair aside. Words seen before come from a cache.

``WordEndBpe`` follows a file with word ends: texts are put into normal form C, lower
case and words; white space is lost. Decoding joins the tokens by spaces, as such a
file, which names no decoder, asks. The special tokens are found in the raw text.

Results in the odd cases: a null or empty text, or one of white space, has no ids and
decodes to an empty text; a null id is kept; repeated rows give repeated results; an
empty table gives an empty result. Only the id and the text are read, so extra columns
cannot clash. Memory holds one slice of texts at a time and a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import whole_text

#: How this kind of file cuts a normalised text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters of text that are encoded together, and words that the cache may hold.
SLICE_CHARS = 1_000_000
CACHE_WORDS = 300_000
NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """Merges of a vocabulary as sorted pair keys, for batches of words."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str = ""):
        letters = byte_letters()
        self.width = np.int64(max(vocab.values()) + 1)
        self.inside = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + word_end, -1) for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol."""
        rank = np.full(len(symbols), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        key = symbols[inner] * self.width + symbols[inner + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        rank[inner[known]] = self.ranks[at[known]]
        return rank

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.inside[raw]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        known = symbols >= 0
        symbols, word = symbols[known], word[known]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self._ranks(symbols, word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            ready = best == NONE
            if ready.any():
                done.append((word[ready], symbols[ready]))
                open_ = ~ready
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            hit = rank == best
            place = np.arange(len(hit))
            begins = hit & ~np.r_[False, hit[:-1]]
            run = place - np.maximum.accumulate(np.where(begins, place, -1))
            hit &= run % 2 == 0  # in a run of equal symbols every second pair overlaps
            symbols[hit] = self.made[rank[hit]]
            stays = ~np.r_[False, hit[:-1]]
            symbols, word = symbols[stays], word[stays]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))


class WordEndBpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = MergeTable(vocab, spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len)[::-1])) + ")")
        self.words = regex.compile(WORD_PATTERN)
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.cache: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: the form of a letter does not depend on its neighbours.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.words.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in their order."""
        parts = self.special_pattern.split(text) if self.special else [text]
        if len(parts) == 1:
            return self._split(text)
        return [w for p in parts for w in ([p] if p in self.special else self._split(p))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        cache.update(self.special)
        cut = [self.pieces(t) for t in texts]
        new = list({w for words in cut for w in words if w not in cache})
        if new:
            ids, counts = self.table.encode([w.encode() for w in new])
            flat, at = ids.astype("<u4").tobytes(), 0
            for w, n in zip(new, (counts * 4).tolist()):
                cache[w] = flat[at : at + n]
                at += n
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_end_bpe(path: str) -> WordEndBpe:
    """One encoder for each worker process, so its cache outlives a task."""
    return WordEndBpe(path)


def text_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a few documents at a time; a longer text ends its slice."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        begin, held, chars = 0, [], 0
        for i, text in enumerate(texts):
            held.append(text.as_py())
            chars += len(held[-1])
            if chars >= most:
                yield ids.slice(begin, len(held)), held
                begin, held, chars = i + 1, [], 0
        if held:
            yield ids.slice(begin, len(held)), held


def _id_type(docs: DataFrame, id_column: str) -> str:
    return docs.schema[id_column].dataType.simpleString()


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ids (binary, little-endian unsigned 32-bit integers), decoded (from those ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_end_bpe(vocabulary)
        for keys, texts in text_slices(batches):
            ids = bpe.encode_batch(texts)
            decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), decoded], ["id", "ids", "decoded"])

    rows = docs.select(docs[id_column].alias("id"), whole_text(text_column).alias("text"))
    out = rows.mapInArrow(run, f"id {_id_type(docs, id_column)}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_column)
