"""Subword ids of whole texts by the tokenizers library, with a cache of pieces.

A byte-level file cuts a text into pieces and encodes each alone. Texts of printable
ASCII without apostrophes and of Latin-1 letters are cut here, many texts at once as
one array of bytes; equal pieces are found by sorting their hashes. Other texts are cut
only before a space that stands in front of other text, where a piece always begins.
The library encodes each new piece once for as long as the cache holds it: new pieces
go to it joined by line breaks, and those cut here only to its merges. The cache of those
is arrays sorted by hash, so pieces met before cost no Python object.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces that the cache may hold.
CACHE_PIECES = 600_000
_CUT = re.compile(r" (?=\S)")
_JOINABLE = re.compile(rb" ?\S+")
#: Classes of bytes: white space, letters (those of two bytes too), digits, the rest.
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[[*b"\t\n\r "]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
#: Bytes of texts that are cut here: printable ASCII without the apostrophe, and À to ÿ, whose first byte is 0xC3.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b"\t\n\r", *range(32, 39), *range(40, 127), *range(128, 192), 0xC3]] = True
#: Second bytes of × and ÷, which are no letters.
_SIGNS = (0x97, 0xB7)
#: Odd base of the polynomial hash of bytes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 2**20), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of bytes, from one running sum of byte times power."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[begins]) * down[begins]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def plain_texts(data: list[bytes]) -> np.ndarray:
    """Whether each text is of plain bytes only."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    other = ~_PLAIN[raw]
    for sign in _SIGNS:
        at = np.flatnonzero(raw == sign)
        other[at[raw[at - 1] == 0xC3]] = True
    upto = np.r_[0, np.cumsum(other)][np.r_[0, np.cumsum([len(d) for d in data], dtype=np.int64)]]
    return np.diff(upto) == 0


def cut_pieces(raw: np.ndarray, doc_begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of plain texts laid end to end; no text is empty."""
    kind = _CLASS[raw]
    space = kind == _SPACE
    first = np.zeros(len(raw) + 1, bool)
    first[doc_begins] = first[-1] = True
    before = np.r_[np.uint8(9), kind[:-1]]
    begins = kind != before
    # Of white space before other text, the last one is apart, and a plain space joins what follows.
    last = space & ~np.r_[space[1:], False] & ~first[1:]
    begins |= last
    begins[1:] &= ~(last[:-1] & (raw[:-1] == 32))
    begins |= first[:-1]
    return np.flatnonzero(begins)


class IdCache:
    """Ids of pieces or words by their hash: the hashes sorted, the ids end to end."""

    def __init__(self, kind: type = np.uint64):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, self.kind)
        self.where, self.lengths, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is held there."""
        at = np.searchsorted(self.hashes, hashes)
        held = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        held[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, held

    def add(self, hashes: np.ndarray, ids: np.ndarray, where: np.ndarray, lengths: np.ndarray) -> None:
        """Hold new hashes, which come sorted; ``where`` their ids begin among ``ids``."""
        at, where = np.searchsorted(self.hashes, hashes), where + len(self.store)
        self.store = np.concatenate([self.store, ids])
        for name, values in (("hashes", hashes), ("where", where), ("lengths", lengths)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at the places, end to end, and where those of each end."""
        n = self.lengths[at]
        goes = np.cumsum(n)
        total = int(goes[-1]) if len(goes) else 0
        return self.store[np.arange(total) + np.repeat(self.where[at] - goes + n, n)], goes


class SubwordEncoder:
    """Ids of texts from one byte-level vocabulary file."""

    def __init__(self, path: str, plain_specials: bool = False, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.library, self.merger):
            tokenizer.no_truncation()
            tokenizer.no_padding()
            tokenizer.encode_special_tokens = plain_specials
        # The merger gets text that is cut already: only the line breaks between pieces end one.
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([letters, pre_tokenizers.Split("Ċ", "isolated")])
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [] if plain_specials else [t.content for t in added]
        (self.line_break,) = self._whole("\n")
        self.cache: dict[bytes, np.ndarray] = {}
        self.cache_pieces = cache_pieces
        self.pieces = IdCache()

    def _whole(self, text: str) -> np.ndarray:
        return self._ids(self.library, text)

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        (encoding,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, "<u4")

    def _learn(self, parts: list[bytes]) -> None:
        joined = [p for p in parts if _JOINABLE.fullmatch(p)]
        for p in set(parts).difference(joined):
            self.cache[p] = self._whole(p.decode())
        if not joined:
            return
        ids = self._ids(self.library, b"\n".join(joined).decode())
        ends = np.append(np.flatnonzero(ids == self.line_break), len(ids)).tolist()
        if len(ends) != len(joined):
            raise ValueError("a piece holds the line break's id")
        at = 0
        for p, end in zip(joined, ends):
            self.cache[p] = ids[at:end].copy()
            at = end + 1

    def _codes(self, parts: list[bytes]) -> list[np.ndarray]:
        new = [p for p in dict.fromkeys(parts) if p not in self.cache]
        if new:
            self._learn(new)
        return list(map(self.cache.__getitem__, parts))

    def _split_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space inside, end to end, and how many each has."""
        ids = self._ids(self.merger, b"\n".join(parts).decode())
        breaks = ids == self.line_break
        counts = np.diff(np.r_[-1, np.flatnonzero(breaks), len(ids)]) - 1
        if len(counts) != len(parts):
            raise ValueError("a piece holds the line break's id")
        return ids[~breaks], counts

    def _places(self, joined: bytes, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in the cache of distinct pieces, by rising hash; new ones are encoded."""
        at, held = self.pieces.find(hashes)
        if not held.all():
            mine = np.flatnonzero(~held)
            begins, ends = begins[mine], ends[mine]
            raw = np.frombuffer(joined, np.uint8)
            spaces = np.r_[0, np.cumsum(_CLASS[raw] == _SPACE)]
            blank = spaces[ends] - spaces[begins]
            plain = (blank == 0) | ((blank == 1) & (raw[begins] == 32) & (ends - begins > 1))
            order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
            spans = [joined[x:y] for x, y in zip(begins[order].tolist(), ends[order].tolist())]
            n = int(plain.sum())
            flat, counts = self._split_ids(spans[:n]) if n else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
            alone = [self._whole(p.decode()) for p in spans[n:]]
            counts = np.r_[counts, np.array([len(a) for a in alone], np.int64)]
            back = np.argsort(order)  # to the order of the hashes
            where = np.cumsum(counts) - counts
            self.pieces.add(hashes[mine], np.concatenate([flat, *alone]), where[back], counts[back])
            at, _ = self.pieces.find(hashes)
        return at

    def _plain(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in data])
        joined = b"".join(data)
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(len(data), np.int64)
        raw = np.frombuffer(joined, np.uint8)
        doc_begins = np.cumsum(sizes) - sizes
        begins = cut_pieces(raw, doc_begins[sizes > 0])
        ends = np.r_[begins[1:], len(raw)]
        hashes, example, inverse = np.unique(range_hashes(raw, begins, ends), return_index=True, return_inverse=True)
        at = self._places(joined, hashes, begins[example], ends[example])
        ids, goes = self.pieces.take(at[inverse])
        upto = np.r_[0, goes][np.searchsorted(begins, np.r_[doc_begins, len(raw)])]
        return ids, np.diff(upto)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array of unsigned 32-bit integers, and how many each text has."""
        if len(self.cache) + len(self.pieces) > self.cache_pieces:
            self.cache.clear()
            self.pieces.clear()
        data = [t.encode() for t in texts]
        plain = plain_texts(data).tolist()
        if self.specials:
            plain = [p and not any(s in t for s in self.specials) for t, p in zip(texts, plain)]
        if all(plain):
            return self._plain(data)
        ids, counts = self._plain([d for d, p in zip(data, plain) if p])
        bounds = np.r_[0, np.cumsum(counts)]
        arrays, k = [], 0
        for text, p in zip(texts, plain):
            if p:
                arrays.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
            elif any(s in text for s in self.specials):
                arrays.append(self._whole(text))
            else:
                first, *rest = _CUT.split(text)
                parts = ([first.encode()] if first else []) + [b" " + w.encode() for w in rest]
                arrays.append(np.concatenate([np.zeros(0, "<u4"), *self._codes(parts)]))
        return np.concatenate(arrays), np.array([len(a) for a in arrays])


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False, cache_pieces: int = CACHE_PIECES) -> SubwordEncoder:
    """One encoder for each worker process, so its cache outlives a task."""
    return SubwordEncoder(path, plain_specials, cache_pieces)
