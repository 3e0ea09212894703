"""Verdicts on urls by lists of host and path rules, through Bloom filter cascades.

A url has few candidate keys: each domain that its host belongs to, with the beginning
of its path at each length that a rule has. The candidates of the whole corpus are the
key universe. A cascade makes membership exact over that universe: the first level holds
the listed keys; the second the unlisted keys of the universe that the first lets
through; the third the listed keys that the second lets through, and so on until none
is left. A key is listed when the number of levels it passes in a row is odd. Building
a level needs one pass over the universe, which keeps only false positives; judging
needs no join, only the levels, whose size follows the lists.

Results in the odd cases: a null url, or one without ``://``, has empty host and path
and no rule; repeated urls give repeated rows; an empty table or empty lists give no
rule anywhere. Only id and url are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Bits for each key and tests for each look-up: under 1 in 100 false positives a level.
BITS, TESTS = 10, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to the query or fragment; empty when there is no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    # (?s) lets the dot match line breaks: whatever stands in a url belongs to it.
    host = F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``domain/path`` that a rule which fits the url may have, longest domain first."""
    labels = F.split(host, r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None)])
    begins = F.filter(begins, lambda b: b.isNotNull())
    return F.flatten(F.transform(domains, lambda d: F.transform(begins, lambda b: F.concat(d, b))))


@dataclass(frozen=True)
class Cascade:
    """Levels of packed bits; each key has two hashes that give its places."""

    levels: tuple[np.ndarray, ...]

    def passed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many levels each key passes before the first that stops it."""
        depth = np.zeros(len(one), dtype=np.int64)
        alive = np.ones(len(one), dtype=bool)
        for level, bits in enumerate(self.levels):
            size = np.uint64(8 * len(bits))
            for k in range(TESTS):
                place = _place(one, two, level, k) % size
                alive &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            depth += alive
        return depth


def _place(one: np.ndarray, two: np.ndarray, level: int, k: int) -> np.ndarray:
    h = one.view(np.uint64) + two.view(np.uint64) * np.uint64(2 * (k + TESTS * level) + 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit(1)).alias("two")


def _level(keys: DataFrame, level: int) -> np.ndarray:
    """Bits of one level; tasks join the places of their keys, so only set bits reach the driver."""
    n = keys.count()
    size = -(-max(64, BITS * n) // 8) * 8

    def places(one: pd.Series, two: pd.Series) -> pd.Series:
        a, b = one.to_numpy(np.int64), two.to_numpy(np.int64)
        each = np.stack([_place(a, b, level, k) % np.uint64(size) for k in range(TESTS)], axis=1)
        return pd.Series(list(each.astype(np.int64)))

    place = F.explode(F.pandas_udf(places, "array<bigint>")("one", "two")).alias("place")
    words = keys.select(place).select(F.shiftright("place", 5).alias("word"), (F.col("place") % 32).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    bits = np.zeros(-(-size // 32), dtype="<u4")
    for row in words.toLocalIterator():
        bits[row["word"]] = row["bits"]
    return bits.view(np.uint8)[: size // 8].copy()


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Filter for the column ``key`` of ``listed`` that is exact for every ``key`` of ``universe``."""
    inside = listed.select(*_hashes(F.col("key"))).distinct()
    outside = universe.select(*_hashes(F.col("key"))).distinct().join(inside, ["one", "two"], "left_anti")
    sides, found = [inside, checkpointed(outside)], Cascade(())
    while True:
        depth = len(found.levels)
        passing = F.pandas_udf(
            lambda one, two, f=found: pd.Series(f.passed(one.to_numpy(np.int64), two.to_numpy(np.int64)) == len(f.levels)),
            "boolean",
        )
        keys = sides[depth % 2].where(passing("one", "two")).distinct() if depth else inside
        keys = keys.cache()
        try:
            if keys.isEmpty():
                return found
            found = Cascade((*found.levels, _level(keys, depth)))
        finally:
            keys.unpersist()


def judge(
    pages: DataFrame,
    block: list[tuple[str, str]],
    allow: list[tuple[str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    unlisted: str = "allow",
) -> DataFrame:
    """id, host, path, rule (the longest that fits, else null) and verdict of every url.

    A rule is (host, path). Each list has a cascade over the corpus's candidate keys; a
    url whose candidates are in neither gets ``unlisted``. A key on both lists blocks.
    """
    spark: SparkSession = pages.sparkSession
    lengths = sorted({len(p) for _, p in [*block, *allow]})
    host, path = host_and_path(F.col(f"`{url_column}`"))
    urls = pages.select(F.col(f"`{id_column}`").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = urls.select(F.explode("keys").alias("key"))
    lists = [
        cascade(spark.createDataFrame([(h + p,) for h, p in rules], "key string"), universe)
        for rules in (block, allow)
    ]

    def side(one: pd.Series, two: pd.Series) -> pd.Series:
        """For each candidate of each url: 2 if blocked, 1 if allowed, else 0."""
        a = np.concatenate([np.zeros(0, np.int64), *one.tolist()]).astype(np.int64)
        b = np.concatenate([np.zeros(0, np.int64), *two.tolist()]).astype(np.int64)
        in_block, in_allow = (f.passed(a, b) % 2 == 1 for f in lists)
        codes = np.where(in_block, 2, np.where(in_allow, 1, 0)).astype(np.int64)
        return pd.Series(np.split(codes, np.cumsum([len(x) for x in one])[:-1]) if len(one) else [])

    one = F.transform("keys", lambda k: F.xxhash64(k))
    two = F.transform("keys", lambda k: F.xxhash64(k, F.lit(1)))
    urls = urls.withColumn("sides", F.pandas_udf(side, "array<bigint>")(one, two))
    fits = F.filter(F.arrays_zip("keys", "sides"), lambda x: x["sides"] > 0)
    longest = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["keys"]), x["keys"].alias("k"), x["sides"].alias("s"))))
    return urls.withColumn("best", longest).select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.col("best.k").alias("rule"),
        F.when(F.col("best.s") == 2, "block").when(F.col("best.s") == 1, "allow").otherwise(unlisted).alias("verdict"),
    )
