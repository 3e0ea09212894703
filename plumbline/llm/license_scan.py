"""Known licences by digests of canonical texts.

The canonical form of a text keeps what licences agree in: letters and digits in lower
case, without punctuation of any script, copyright lines and differences of spelling. A
whole text is put into that form, hashed, and joined by hash with the digests of known
licence texts and notices, a small table given by the caller and broadcast.

Parts of a text are looked up the same way. An anchor table holds the first words of
every known form; where a document has these words, a window of the form's length is cut,
hashed, and joined with the same table. So the work follows the document and not the
number of licences. A notice must fill a run of whole lines; a whole licence text (folder
``license_texts``, with its title or without, with its appendix or without) may begin and
end anywhere. A line that begins with "copyright" or "(c)" as a licence text goes on is no
copyright line. Windows are cut from the text without its copyright lines and, where it
has some, from the text with them; a licence that follows a copyright notice on the
notice's own line, to the end of the text, is the licence of the whole text.

Results in the odd cases: a null or empty text has no match; a text that has nothing
but copyright lines has an empty form, which never matches; each licence counts once for
a document, however often it is repeated; rows are kept apart by a row number, so
repeated rows and null ids give a result each; an empty table gives an empty result.
Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import whole_text

#: Public licence identifiers, and notices or short licence texts they are known by.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.",
    ),
]
#: Titles that may stand above a licence text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
}
#: Spellings that count as equal, each written as the second one.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("v", "version")]
#: Words of a known form that must stand in a text before a window is cut there.
ANCHOR = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PLAIN = bytes(b if b == 10 or 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def texts() -> list[tuple[str, str]]:
    """Whole licence texts by licence, each without what may be left out: its appendix, its title."""
    # The files hold public licence texts word for word, since digests must match.
    out = []
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        body = file.read_text()
        bodies = [body, re.split(r"END OF TERMS AND CONDITIONS", body)[0], re.split(r"\nExhibit A - ", body)[0]]
        if file.stem.startswith("BSD-"):  # clauses behind bullets, and the holder called owner
            bodies.append(re.sub(r"(?m)^\s*[0-9]\. ", "* ", body))
            bodies += [re.sub(r"(COPYRIGHT\s+)HOLDER OR", r"\1OWNER OR", b) for b in bodies]
        bodies += [f"{title}\n\n{b}" for title in TITLES.get(file.stem, []) for b in bodies]
        out += [(file.stem, b) for b in dict.fromkeys(bodies)]
    return out


@dataclass(frozen=True)
class Spared:
    """Words that go on behind "copyright" and "(c)" in known texts, so that these begin no copyright line."""

    copyright: list[str]
    item: list[str]

    @classmethod
    def of(cls, bodies: list[str]) -> Spared:
        joined = "\n".join(bodies).lower()
        return cls(*(sorted(set(re.findall(start + r"\s+([a-z]+)", joined))) for start in (r"\bcopyright", r"\(c\)")))

    def patterns(self) -> tuple[str, str]:
        """What a copyright line of lower-case letters begins with, and what rules it out."""
        begin = r"[ \t]*(copyright([ \t:]+[^\x00-\x20]|[(©0-9])|\(c\)[ \t]*[^\x00-\x20]|©)"
        copyright, item = ("|".join(words) or "-" for words in (self.copyright, self.item))
        return begin, rf"[ \t]*(copyright[ \t]+({copyright})|\(c\)[ \t]*({item}))([^0-9a-z]|$)"


class Canonical:
    """Canonical words of the lines of a text."""

    def __init__(self, spared: Spared):
        self.begins, self.spared = map(re.compile, spared.patterns())
        self.words = {other: spelling.split() for other, spelling in SPELLINGS}
        self.hints = [*self.words, *(f"v{d}" for d in range(10))]

    def lines(self, text: str) -> tuple[list[list[str]], list[bool]]:
        """Words of each line that has some, and whether the line is a copyright line."""
        text = text.encode("utf-8", "replace").translate(_LOWER).decode("utf-8")
        notices = None
        if "copyright" in text or "(c)" in text or "©" in text:
            notices = [bool(self.begins.match(x)) and not self.spared.match(x) for x in text.split("\n")]
        if not text.isascii():
            for c in set(text):
                if c > "\x7f" and unicodedata.category(c)[0] not in "LNM":
                    text = text.replace(c, " ")
        text = text.encode().translate(_PLAIN).decode()
        lines = [x.split(" ") for x in text.split("\n")]
        lines = [[w for w in x if w] for x in lines]
        if any(hint in text for hint in self.hints):
            lines = [list(chain.from_iterable(map(self._spelled, x))) for x in lines]
        notices = notices or [False] * len(lines)
        kept = [(x, n) for x, n in zip(lines, notices) if x]
        return [x for x, _ in kept], [n for _, n in kept]

    def _spelled(self, word: str) -> list[str]:
        if word[0] == "v" and word[1:2] and "0" <= word[1] <= "9":
            return ["version", word[1:]]
        return self.words.get(word) or [word]

    def form(self, text: str) -> str:
        lines, notices = self.lines(text)
        return " ".join(chain.from_iterable(x for x, n in zip(lines, notices) if not n))


def digest(form: str) -> bytes:
    return hashlib.sha256(form.encode()).digest()


#: Kinds of windows: the text, a run of whole lines, any run of words, and one behind a notice to the end.
TEXT, LINES, WORDS, REST = range(4)


class Windows:
    """Digests of a text and of its windows that begin as a known form does."""

    def __init__(self, canonical: Canonical, forms: list[str]):
        self.canonical = canonical
        self.lengths: dict[tuple, set[int]] = {}
        for words in map(str.split, forms):
            self.lengths.setdefault(tuple(words[:ANCHOR]), set()).add(len(words))
        self.first: dict[str, list[int]] = {}
        for head in self.lengths:
            sizes = self.first.setdefault(head[0], [])
            if len(head) not in sizes:
                sizes.append(len(head))

    def _cut(self, lines: list[list[str]], notices: list[bool]) -> Iterator[tuple[int, bytes]]:
        words = list(chain.from_iterable(lines))
        starts = None
        for p in (p for p, w in enumerate(words) if w in self.first):
            for size in self.first[words[p]]:
                for n in self.lengths.get(tuple(words[p : p + size]), ()):
                    if p + n > len(words):
                        continue
                    if starts is None:
                        starts = set(accumulate(map(len, lines), initial=0))
                        # Words up to the first line that is no notice.
                        leading = next((i for i, notice in enumerate(notices) if not notice), len(lines))
                        before = sum(map(len, lines[:leading]))
                    name = digest(" ".join(words[p : p + n]))
                    yield LINES if p in starts and p + n in starts else WORDS, name
                    if p + n == len(words) and p < before:
                        yield REST, name

    def of(self, text: str) -> set[tuple[int, bytes]]:
        lines, notices = self.canonical.lines(text)
        body = [x for x, n in zip(lines, notices) if not n] if any(notices) else lines
        form = " ".join(chain.from_iterable(body))
        found = {(TEXT, digest(form) if form else b"")}
        found.update(self._cut(body, [False] * len(body)))
        if body is not lines:
            found.update(self._cut(lines, notices))
        return found


def known_forms(known=None) -> tuple[Canonical, list[tuple[str, bool, str]]]:
    """The canonical form in use, and (licence, is a whole licence text, form) of all that is known."""
    notices, bodies = list(known or KNOWN), [] if known else texts()
    canonical = Canonical(Spared.of([body for _, body in [*notices, *bodies]]))
    forms = [(name, False, canonical.form(x)) for name, x in notices] + [(name, True, canonical.form(x)) for name, x in bodies]
    return canonical, [f for f in dict.fromkeys(forms) if f[2]]


def scan(docs: DataFrame, known=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, license_of_text (the whole text is that licence) and licenses (of text or parts, sorted).

    known: licences and notices in place of ``KNOWN`` and the whole licence texts.
    """
    canonical, forms = known_forms(known)
    windows = Windows(canonical, [form for _, _, form in forms])
    table = docs.sparkSession.createDataFrame(
        [(name, whole, digest(form)) for name, whole, form in forms], "license string, body boolean, digest binary"
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias("id"), whole_text(text_column).alias("text")
    )

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, kinds, names = [], [], []
            for place, text in enumerate(batch.column(2)):
                for kind, name in windows.of(text.as_py()):
                    places.append(place), kinds.append(kind), names.append(name)
            at = pa.array(places, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.int32()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "kind", "digest"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("kind", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    found = rows.mapInArrow(units, schema).join(F.broadcast(table), "digest", "left")
    # A notice is a text or a run of whole lines; a whole licence text may stand between other words.
    name = F.when(F.col("body") | F.col("kind").isin(TEXT, LINES), F.col("license"))
    of_text = F.when((F.col("kind") == TEXT) | (F.col("body") & (F.col("kind") == REST)), F.col("license"))
    return (
        found.groupBy("row", "id")
        .agg(F.min(of_text).alias("license_of_text"), F.sort_array(F.collect_set(name)).alias("licenses"))
        .select(F.col("id").alias(id_column), "license_of_text", "licenses")
    )
