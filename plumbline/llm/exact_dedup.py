"""Exact duplicates by a content sort.

Splitters sampled from the normalised bytes cut the corpus into ranges. Each range is
sorted by content (Spark's external sort) and every text is compared in full with the
one before it. Ties are cut too: a splitter ends in a random part, so copies of one
text spread over as many ranges as they need. A text that a splitter cuts leaves one
piece in each range it touches; those pieces, at most two for each range, are joined
again by their SHA-256.

Results in the odd cases: a null text is an empty one; all empty texts are equal;
among rows equal in text and id one stays; a null id is larger than any other and
stays only in a group of nulls; an empty table gives an empty result. Rows travel as
one struct, so names of extra columns cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import one_space, shuffle_partitions, whole_text
from plumbline.session import shared_dir

#: Sampled keys for each splitter.
OVERSAMPLE = 32
#: Characters of the content that lead the sort key; the hash of the whole text follows.
LEAD = 24


def _content(text: Column) -> Column:
    """Sort key of a text: its first bytes in hexadecimal, then its hash."""
    return F.concat_ws(" ", F.hex(F.encode(F.substring(text, 1, LEAD), "utf-8")), F.hex(F.xxhash64(text)))


def _splitters(keys: DataFrame, ranges: int) -> list[str]:
    """Up to ``ranges`` - 1 sampled keys that cut the rows evenly; the sample's size is bounded."""
    n = keys.count()
    if not n:
        return []
    share = min(1.0, OVERSAMPLE * ranges / n)
    sample = sorted(r[0] for r in (keys if share == 1 else keys.sample(False, share, 7)).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters up to the key, by binary search."""
    steps = F.lit([2**i for i in reversed(range(len(splitters).bit_length()))])
    table = F.lit(splitters)
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(splitters)) & (F.try_element_at(table, low + step) <= key), low + step
        ).otherwise(low),
    )


def _sorted_ranges(docs: DataFrame, id_column: str, text_column: str, ranges: int | None) -> DataFrame:
    """Every row with its range, its run of equal texts there, and whether a splitter may cut the run."""
    ranges = ranges or 4 * shuffle_partitions(docs)
    text = one_space(whole_text(text_column))
    spread = F.concat_ws(" ", _content(text), F.hex(F.xxhash64(F.monotonically_increasing_id())))
    splitters = _splitters(docs.select(spread.alias("key")), ranges)
    cut = sorted({s.rpartition(" ")[0] for s in splitters})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spread.alias("key"))
    rows = rows.select("row", (_range_of(F.col("key"), splitters) if splitters else F.lit(0)).alias("range"))
    rows = rows.repartition(shuffle_partitions(docs), "range")
    text = one_space(F.coalesce(F.col("row").getField(text_column).cast("string"), F.lit("")))
    rows = rows.select("*", text.alias("text")).select("*", _content(F.col("text")).alias("content"))
    id_ = F.col("row").getField(id_column)
    order = Window.partitionBy("range").orderBy("content", "text", id_.asc_nulls_last())
    fresh = F.coalesce(F.col("text") != F.lag("text").over(order), F.lit(True))
    rows = rows.withColumn("fresh", fresh)
    run = F.sum(F.col("fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "row",
        "range",
        run.alias("run"),
        "fresh",
        (F.col("content").isin(cut) if cut else F.lit(False)).alias("cut"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"),
    )


def _written(df: DataFrame) -> DataFrame:
    """Through a table in the shared folder, which later steps read in part."""
    path = f"{shared_dir(df.sparkSession)}/exact-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    narrow = docs.select(id_column, text_column)
    rows = _sorted_ranges(narrow, id_column, text_column, ranges)
    rows = rows.select(F.col("row").getField(id_column).alias("id"), "range", "run", "fresh", "cut", "text_sha256")
    piece = Window.partitionBy("range", "run")
    rows = _written(
        rows.select("*", F.min("id").over(piece).alias("low"), F.count(F.lit(1)).over(piece).alias("size"))
    )
    pieces = rows.where("cut and fresh")
    same = Window.partitionBy("text_sha256")
    first = F.row_number().over(same.orderBy(F.col("low").asc_nulls_last(), "range", "run"))
    joined = pieces.select(
        F.col("range").alias("range_"),
        F.col("run").alias("run_"),
        F.min("low").over(same).alias("low_"),
        F.sum("size").over(same).alias("size_"),
        (first == 1).alias("first_"),
    )
    # At most two pieces for each range, so the broadcast is bounded by the number of ranges.
    on = (F.col("range") == F.col("range_")) & (F.col("run") == F.col("run_")) & F.col("cut")
    return rows.join(F.broadcast(joined), on, "left").select(
        F.col("id").alias(id_column),
        F.when(F.col("range_").isNull(), F.col("low")).otherwise(F.col("low_")).alias("keep_id"),
        F.coalesce("size_", "size").alias("group_size"),
        (F.col("fresh") & F.coalesce("first_", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None
) -> DataFrame:
    """The documents that stay, in their own columns; the texts are shuffled once."""
    heads = _written(_sorted_ranges(docs, id_column, text_column, ranges).where("fresh").drop("fresh"))
    same = Window.partitionBy("text_sha256")
    first = F.row_number().over(same.orderBy(F.col("id").asc_nulls_last(), "range", "run"))
    pieces = heads.where("cut").select(
        F.col("row").getField(id_column).alias("id"), "range", "run", "text_sha256"
    )
    losers = pieces.select("range", "run", (first > 1).alias("later")).where("later").drop("later")
    return heads.join(F.broadcast(losers), ["range", "run"], "left_anti").select("row.*")
