"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row; a text of one to four words is one shingle. Its weight
is (1 + ln tf) times the mean weight of its words, and a word's weight goes from 1 to 2
with its inverse document frequency over the whole corpus. Frequencies are counted for
``CELLS`` hash cells of words, so the table has one size for every corpus. The damping
keeps the weighted similarity near the plain one: copies of a text, which make its words
frequent, cannot push an edited copy below the threshold.

A text has ``BANDS`` * ``ROWS`` samples; texts that agree in all samples of a band share
a bucket. At similarity 0.8 a pair shares none with probability 0.005. Every text of a
bucket is compared with the bucket's leader, the text whose buckets are the fullest; then
every pair of a bucket that is not
joined yet is compared, so a large group costs one comparison for each text and no link
between different groups is lost. A text is not compared with its leader if their total
weights rule the threshold out, or their samples agree too little for it (under 55 %;
at 0.8 that happens once in 100,000 pairs). All other comparisons are by exact weighted
Jaccard similarity, those inside a bucket by tasks that get every set once and send on
one link for each component that a text reaches. Links are joined into classes; texts with the same words are one
text from the start.

Results in the odd cases: a null, empty or blank text is a class of its own; a class is
named by its smallest id, and a null id is larger than any other; rows equal in id and
text are one class, of which one row stays; an empty table gives an empty result. Texts
are cut whole, however long. Rows travel as one struct where they are kept, so names of
extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import text_slices
from plumbline.llm.common import checkpointed, whole_text
from plumbline.llm.components import components
from plumbline.llm.subwords import range_hashes

WORDS, BANDS, ROWS, THRESHOLD = 5, 10, 4, 0.8
CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: Share of equal samples below which a pair is not compared.
AGREE = 0.55
#: Characters whose shingles are sampled together; small enough for a processor's cache.
SLICE = 150_000
#: Members of a bucket that ask and are asked in one group, and rows that one call gets, on average.
ASKING, ASKED, ROWS_A_CALL = 256, 1024, 2000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the place of its text in the list."""
    joined = b"\n".join([*data, b""])
    raw = np.frombuffer(joined, np.uint8)
    blank = np.r_[True, _BLANK[raw]]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = edges[::2], edges[1::2]
    doc_ends = np.cumsum([len(d) + 1 for d in data])
    return range_hashes(raw, begins, ends), np.searchsorted(doc_ends, begins, side="right")


def shingles(data: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle (32-bit hash) and weight, ordered by doc and shingle, each shingle of a doc once."""
    h, doc = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32)
    mass = weights[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    counts = np.bincount(doc, minlength=len(data))
    firsts = np.cumsum(counts) - counts
    place = np.arange(len(h)) - firsts[doc]
    begins = np.flatnonzero(place <= np.maximum(counts[doc] - WORDS, 0))
    length = np.minimum(counts[doc[begins]], WORDS)
    value = np.zeros(len(begins), np.uint64)
    weight = np.zeros(len(begins), np.float32)
    for k in range(WORDS):
        at = np.minimum(begins + k, len(h) - 1)
        there = k < length
        step = np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64))
        value += np.where(there, (h[at] ^ np.uint64(k)) * step, np.uint64(0))
        weight += np.where(there, mass[at], np.float32(0))
    value = (_mixed(value) >> np.uint64(32)).astype(np.int64) | (doc[begins] << 32)
    order = np.argsort(value)
    value, weight = value[order], (weight / length)[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    tf = np.diff(np.r_[first, len(value)])
    weight = weight[first] * (1 + np.log(tf)).astype(np.float32)
    value = value[first]
    return value >> 32, (value & 0xFFFFFFFF).astype(np.uint32), weight.astype(np.float32)


def _tables() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) quantiles, their inverses and logarithms, and uniform numbers, for 16-bit draws."""
    x = np.r_[0, np.geomspace(1e-6, 40, 200_000)]
    uniform = (np.arange(65536) + 0.5) / 65536
    gamma = np.interp(uniform, 1 - (1 + x) * np.exp(-x), x)
    return tuple(t.astype(np.float32) for t in (gamma, 1 / gamma, np.log(gamma), uniform))


_GAMMA, _INVERSE, _LOG, _UNIFORM = _tables()


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Consistent weighted samples of each distinct doc in order, as n 32-bit names.

    Each draw takes r, c from Gamma(2, 1) and b from [0, 1) by the shingle's hash, sets
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r), and the least a wins.
    """
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out = np.empty((len(begins), n), np.int32)
    base = _mixed(shingle.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    log_weight = np.log(weight)
    low = np.uint64(0xFFFF)
    for k in range(n):
        z = _mixed(base + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64))
        at = (z & low).astype(np.int32)
        r = _GAMMA[at]
        b = _UNIFORM[((z >> np.uint64(32)) & low).astype(np.int32)]
        t = np.floor(log_weight * _INVERSE[at] + b)
        log_a = _LOG[((z >> np.uint64(16)) & low).astype(np.int32)] - r * (t - b + np.float32(1))
        # A float that is positive orders like its bits; the shift keeps every value positive.
        rank = np.maximum(log_a + np.float32(128), np.float32(1e-30)).view(np.uint32).astype(np.uint64)
        name = _mixed(z + t.astype(np.int64).view(np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)
        least = np.minimum.reduceat((rank << np.uint64(32)) | name, begins)
        out[:, k] = least.astype(np.uint32).view(np.int32)
    return out


def word_weights(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Weight of each cell of words, from document frequencies over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, np.int64), 0
        for ids, texts in text_slices(batches):
            h, doc = word_hashes([t.encode() for t in texts])
            n += len(texts)
            both = np.unique((doc << CELL_BITS) | (h >> np.uint64(64 - CELL_BITS)).astype(np.int64))
            total += np.bincount(both & (CELLS - 1), minlength=CELLS)
        cells = np.flatnonzero(total)
        columns = [pa.array(np.r_[cells, CELLS].astype(np.int32)), pa.array(np.r_[total[cells], n])]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n"])

    rows = docs.select(F.lit(0).alias("id"), whole_text(text_column).alias("text"))
    counts = rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(CELLS + 1)
    df[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    n = max(df[-1], 2)
    return (1 + np.log((n + 1) / (df[:-1] + 1)) / np.log(n + 1)).astype(np.float32)


def signed(docs: DataFrame, weights, id_column: str, text_column: str, n: int = BANDS * ROWS) -> DataFrame:
    """Per row: id, raw (hash of the text), key (digest of its words; null without any), mass, samples."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE):
            data = [t.encode() for t in texts]
            doc, shingle, weight = shingles(data, weights.value)
            keys: list[bytes | None] = [None] * len(data)
            mass = np.zeros(len(data))
            names: list[np.ndarray | None] = [None] * len(data)
            if len(doc):
                mass += np.bincount(doc, weights=weight, minlength=len(data))
                for d, row in zip(np.unique(doc).tolist(), samples(doc, shingle, weight, n)):
                    names[d] = row
                    keys[d] = hashlib.blake2b(b" ".join(data[d].split()), digest_size=16).digest()
            columns = [ids, pa.array(keys, pa.binary()), pa.array(mass), pa.array(names, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "mass", "samples"])

    # The hash of the text rides with the id through the struct.
    rows = docs.select(
        F.struct(docs[id_column].alias("id"), F.xxhash64(whole_text(text_column)).alias("raw")).alias("id"),
        whole_text(text_column).alias("text"),
    )
    out = rows.mapInArrow(run, f"id struct<id:{kind},raw:bigint>, key binary, mass double, samples array<int>")
    return out.select("id.id", "id.raw", "key", "mass", "samples")


def _sets(docs: DataFrame, wanted: DataFrame, weights, id_column: str, text_column: str) -> DataFrame:
    """key, shingles and their weights (packed) for the wanted texts (id, raw, key)."""
    texts = docs.select(
        docs[id_column].alias("id"), F.xxhash64(whole_text(text_column)).alias("raw"), whole_text(text_column).alias("text")
    )
    on = texts["id"].eqNullSafe(wanted["id"]) & (texts["raw"] == wanted["raw"])
    texts = texts.join(wanted, on).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, held in text_slices(batches, SLICE):
            doc, shingle, weight = shingles([t.encode() for t in held], weights.value)
            cuts = np.searchsorted(doc, np.arange(len(held) + 1)).tolist()
            columns = [
                keys,
                pa.array([shingle[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([weight[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "shingles", "weights"])

    return texts.mapInArrow(run, "key binary, shingles binary, weights binary").dropDuplicates(["key"])


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    sa, sb = np.frombuffer(a[0], np.uint32), np.frombuffer(b[0], np.uint32)
    wa, wb = np.frombuffer(a[1], np.float32), np.frombuffer(b[1], np.float32)
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    both = sb[at] == sa
    shared = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose weighted similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, wa, sb, wb = (batch.column(k) for k in range(6))
            keep = [
                similarity((sa[i].as_py(), wa[i].as_py()), (sb[i].as_py(), wb[i].as_py())) >= threshold
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    loaded = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "wa", "sb", "wb")
    return checkpointed(loaded.mapInArrow(run, "a binary, b binary"))


def _linked(group: pd.DataFrame, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between the components of the asking members of a group and those of the others, by their labels."""
    labels = group["label"].to_numpy()
    asks = np.flatnonzero(group["asks"].to_numpy())
    asked = np.flatnonzero(group["asked"].to_numpy())
    sets = [np.frombuffer(x, np.uint32) for x in group["shingles"]]
    weights = [np.frombuffer(x, np.float32) for x in group["weights"]]
    mass = np.array([w.sum(dtype=np.float64) for w in weights])
    sizes = [len(sets[m]) for m in asked]
    shingle = np.concatenate([sets[m] for m in asked])
    owner, weight = np.repeat(np.arange(len(asked)), sizes), np.concatenate([weights[m] for m in asked])
    order = np.argsort(shingle, kind="stable")
    shingle, owner, weight = shingle[order], owner[order], weight[order]
    for a in asks:
        low = np.searchsorted(shingle, sets[a], "left")
        n = np.searchsorted(shingle, sets[a], "right") - low
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(low - upto + n, n)
        least = np.minimum(weight[at], np.repeat(weights[a], n))
        shared = np.bincount(owner[at], weights=least, minlength=len(asked))
        linked = asked[shared >= threshold * (mass[a] + mass[asked] - shared)]
        linked = linked[labels[linked] != labels[a]]
        for label in np.unique(labels[linked]):
            yield labels[a], label


def _rest(member: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of members of a bucket (bucket, key, label), by their labels.

    Members outside the bucket's largest component ask all members. Askers and asked are cut
    into slices, and each pair of slices is a group that one call holds and compares.
    """
    parts = member.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")
    )
    tops = tops.where("labels > 1").select(
        "bucket",
        F.col("top.label").alias("top"),
        F.ceil(F.col("n") / ASKED).cast("int").alias("asked_slices"),
        F.ceil((F.col("n") - F.col("top.n")) / ASKING).cast("int").alias("asking_slices"),
    )
    mixed = member.join(tops, "bucket")

    def slices(own: str, other: str, asks: bool) -> DataFrame:
        """Each member once for every slice of the other side."""
        mine = F.pmod(F.xxhash64("key", "bucket"), own).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        side = mixed.where("label != top") if asks else mixed
        i, j = ("mine", "every") if asks else ("every", "mine")
        return side.select("bucket", "key", "label", mine.alias("mine"), every.alias("every")).select(
            "bucket", "key", "label", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(asks).alias("asks")
        )

    both = slices("asking_slices", "asked_slices", True).unionByName(slices("asked_slices", "asking_slices", False))
    both = both.groupBy("bucket", "i", "j", "key", "label").agg(
        F.max("asks").alias("asks"), F.max(~F.col("asks")).alias("asked")
    )
    both = checkpointed(both)
    calls = max(1, -(-both.count() // ROWS_A_CALL))
    call = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(calls)).cast("int")
    loaded = both.withColumn("call", call).join(sets, "key")

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        found = {
            pair
            for _, group in part.groupby(["bucket", "i", "j"], sort=False)
            if group["asks"].any() and group["asked"].any()
            for pair in _linked(group, threshold)
        }
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype=object)

    return checkpointed(loaded.groupBy("call").applyInPandas(compared, "a binary, b binary"))


def _alike(threshold: float):
    """Condition on the columns of a pair: what total weights and samples allow."""
    ratio = F.least("mass_a", "mass_b") >= F.lit(threshold * 0.999) * F.greatest("mass_a", "mass_b")
    equal = F.aggregate(
        F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return ratio & (equal >= F.lit(AGREE) * F.size("samples_a"))


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row: id, raw, wordless, class_id (smallest id of its class), leads (this id and text name the class)."""
    weights = docs.sparkSession.sparkContext.broadcast(word_weights(docs, text_column))
    every = checkpointed(signed(docs, weights, id_column, text_column, bands * rows))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw")).alias("low")
    texts = every.where("key is not null").groupBy("key")
    texts = checkpointed(texts.agg(first, F.first("mass").alias("mass"), F.first("samples").alias("samples")))
    band = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.xxhash64(k, F.slice("samples", k * rows + 1, F.lit(rows))),
    )
    member = texts.select("key", F.explode(band).alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = checkpointed(member.join(sizes, "bucket"))
    # The leader is the text whose buckets are the fullest: the one that edited copies were made from, if any.
    company = member.groupBy("key").agg(F.sum("n").alias("company"))
    member = checkpointed(member.drop("n").join(company, "key"))
    leaders = member.groupBy("bucket").agg(F.max(F.struct("company", "key"))["key"].alias("leader"))
    member = checkpointed(member.drop("company").join(leaders, "bucket"))
    wanted = member.select("key").distinct().join(texts, "key")
    sets = checkpointed(_sets(docs, wanted.select("low.id", "low.raw", "key"), weights, id_column, text_column))

    side_a = texts.select(F.col("key").alias("a"), F.col("mass").alias("mass_a"), F.col("samples").alias("samples_a"))
    side_b = texts.select(F.col("key").alias("b"), F.col("mass").alias("mass_b"), F.col("samples").alias("samples_b"))
    stars = member.select(F.col("key").alias("a"), F.col("leader").alias("b")).where("a != b").distinct()
    stars = stars.join(side_b, "b").join(side_a, "a").where(_alike(threshold)).select("a", "b")
    links = _verified(stars, sets, threshold)
    roots = components(links)

    # What is left: pairs of a bucket in different components.
    labelled = member.select("bucket", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    labelled = checkpointed(labelled.select("bucket", "key", F.coalesce("root", "key").alias("label")))
    # The components found so far are the nodes of a second, much smaller graph.
    tops = components(_rest(labelled, sets, threshold)).select(F.col("node").alias("label"), F.col("root").alias("top"))

    named = texts.select("key", "low").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "low", F.coalesce("root", "key").alias("label")).join(tops, "label", "left")
    named = checkpointed(named.select("key", "low", F.coalesce("top", "label").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("class"))
    named = named.join(lows, "root").select(F.col("key").alias("key_"), "class")
    joined = every.select("id", "raw", "key").join(named, F.col("key") == F.col("key_"), "left")
    leads = F.col("key").isNull() | (F.col("id").eqNullSafe(F.col("class.id")) & (F.col("raw") == F.col("class.raw")))
    return joined.select(
        "id",
        "raw",
        F.col("key").isNull().alias("wordless"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        leads.alias("leads"),
    )


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per document: id, class_id, kept (its id names the class)."""
    found = classes(docs, id_column, text_column, **options)
    return found.select(F.col("id").alias(id_column), "class_id", F.col("leads").alias("kept"))


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each class, in its own columns."""
    found = classes(docs, id_column, text_column, **options).where("leads")
    found = found.groupBy("id", "raw").agg(F.max("wordless").alias("wordless"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        docs[id_column].alias("id_"),
        F.xxhash64(whole_text(text_column)).alias("raw_"),
    )
    on = rows["id_"].eqNullSafe(found["id"]) & (rows["raw_"] == found["raw"])
    same = Window.partitionBy("id_", "raw_").orderBy(F.lit(0))
    rows = rows.join(found, on).withColumn("place", F.row_number().over(same))
    return rows.where("wordless or place = 1").select("row.*")
