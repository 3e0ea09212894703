"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same number of copies, target / size of the
source. The whole part is given; the fraction is a probability that has to become 0 or
1. Documents are paired, and words move at random from one to the other, by chances
that keep every document's expectation, until one of the two is decided; the undecided
one meets the next document. A bucket of documents leaves one undecided document, the
residual, and the residuals of ``FAN`` buckets form a bucket of the next level: a
reduction tree whose groups stay small however large a source is. The words of a source
never leave it, so what it takes differs from its target only by the rounding of the
last residual, that is by less than one document.

Draws are hashes of the id, so reruns agree on any partitioning.

Results in the odd cases: a null or wordless text has size 0 and takes nothing; a null
source is a source of its own, the last; repeated rows are units of their own and are
interchangeable; a null id is an id like any other; a table without words has targets 0.
Rows travel as one struct in ``mixed``, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORDS, checkpointed, small_side

#: Documents or residuals that meet in one bucket, on average.
FAN = 64
#: Below this a fraction of a copy counts as none (rounding of doubles).
TINY = 1e-9


def sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """id, source, size in words of every document, as columns of those names."""
    return docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{source_column}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_column}`").cast("string"), F.lit(WORDS)), F.lit(0))
        .cast("long")
        .alias("size"),
    )


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, none above ``most`` times its size.

    Sources in code point order, null last, take the weights in turn. What stops at its
    limit leaves its excess to the others by weight, so every other source gets the same
    words for each unit of weight: the first level, going up by limit / weight, that the
    next source can take. One row for each source is sorted, not one for each document.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = F.lit([float(w) for w in weights])
    per = per.select("*", F.element_at(table, (rank - 1) % len(weights) + 1).alias("weight"))
    per = per.withColumn("limit", F.col("source_size") * most)
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy()) * share
    per = per.withColumn("level", (everything - full) / rest)
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    shared = F.least(F.col("limit"), level * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(shared, F.col("limit")).alias("target"))


def _draw(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**52)) / F.lit(float(2**52))


def _meet(a: Column, x: Column) -> Column:
    """One pivotal step: the undecided unit of ``a`` meets ``x``."""
    s, p = a["size"], a["p"]
    t, q = x["size"], x["p"]
    into_a = F.least(s * (1 - p), t * q)  # words that x can give
    out_of_a = F.least(s * p, t * (1 - q))  # words that a can give
    up = x["u"] * (into_a + out_of_a) < out_of_a  # x gives, by the chance that keeps both expectations

    def moved(who: Column, chance: Column) -> Column:
        return F.least(F.greatest(chance, F.lit(0.0)), F.lit(1.0)).alias(who)

    def state(done: Column, copies: int, stays: Column, chance: Column) -> Column:
        decided = F.struct(done["unit"].alias("unit"), F.lit(copies).alias("extra"))
        return F.struct(
            F.concat(a["decided"], F.array(decided)).alias("decided"),
            stays["unit"].alias("unit"),
            stays["size"].alias("size"),
            moved("p", chance),
        )

    gained = F.when(s * (1 - p) <= t * q, state(a, 1, x, q - into_a / t)).otherwise(
        state(x, 0, a, p + into_a / s)
    )
    lost = F.when(s * p <= t * (1 - q), state(a, 0, x, q + out_of_a / t)).otherwise(
        state(x, 1, a, p - out_of_a / s)
    )
    begun = F.struct(a["decided"].alias("decided"), x["unit"].alias("unit"), t.alias("size"), q.alias("p"))
    return F.when(a["unit"].isNull(), begun).when(up, gained).otherwise(lost)


def _reduced(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: each bucket decides all its units but one."""
    entry = F.struct(
        (-F.col("size")).alias("order"), "h", "unit", "size", "p", _draw(F.lit(seed), F.lit(level), "h").alias("u")
    )
    grouped = units.groupBy("source", "bucket", "buckets").agg(F.sort_array(F.collect_list(entry)).alias("met"))
    kind = units.schema["unit"].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<struct<unit:{kind},extra:int>>").alias("decided"),
        F.lit(None).cast(kind).alias("unit"),
        F.lit(0.0).alias("size"),
        F.lit(0.0).alias("p"),
    )
    state = F.aggregate("met", start, _meet)
    return grouped.select("source", "bucket", "buckets", state.alias("state"))


def rounded(units: DataFrame, seed: int = 11) -> DataFrame:
    """unit and extra (0 or 1) for every unit, from source, h, unit, size (double) and p."""
    counts = small_side(units.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 0
    same = units["source"].eqNullSafe(counts["source"])
    units = units.join(counts, same).drop(counts["source"])
    units = units.withColumn("buckets", F.ceil(F.col("n") / FAN)).drop("n")
    units = units.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "h"), "buckets"))
    kind = units.schema["unit"].dataType.simpleString()
    decided, level, widest = [], 0, -(-most // FAN)
    while most:
        state = checkpointed(_reduced(units, level, seed))
        decided.append(state.select(F.inline("state.decided")))
        left = state.select(
            "source", "bucket", "buckets", "state.unit", "state.size", "state.p"
        ).withColumn("h", F.xxhash64(F.lit(seed), "source", "bucket"))
        if widest <= 1:
            last = _draw(F.lit(seed), F.lit("last"), "h") < F.col("p")
            decided.append(left.select("unit", last.cast("int").alias("extra")))
            break
        units = left.withColumns(
            {"bucket": F.floor(F.col("bucket") / FAN), "buckets": F.ceil(F.col("buckets") / FAN)}
        )
        level, widest = level + 1, -(-widest // FAN)
    if not decided:
        return units.sparkSession.createDataFrame([], f"unit {kind}, extra int")
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), copies, taken."""
    sized = sizes(docs, id_column, text_column, source_column)
    same_rows = sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = checkpointed(
        same_rows.select("id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("rep"))
    )
    wanted = small_side(targets(units, weights, share, most))
    units = units.join(wanted, units["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(most))
    units = units.withColumn("whole", F.floor(rate + TINY)).withColumn("p", rate - F.col("whole"))
    unit = F.struct("id", "source", "size", "source_size", "target", "whole", "rep").alias("unit")
    open_ = (F.col("size") > 0) & (F.col("p") > TINY)
    h = F.xxhash64(F.lit(seed), "source", "id", "size", "rep").alias("h")
    undecided = units.where(open_).select("source", h, unit, F.col("size").cast("double").alias("size"), "p")
    result = rounded(undecided, seed).unionByName(units.where(~open_).select(unit, F.lit(0).alias("extra")))
    copies = F.when(F.col("unit.size") > 0, F.col("unit.whole") + F.col("extra")).otherwise(F.col("unit.whole"))
    return result.select("unit.*", copies.cast("long").alias("copies")).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options
) -> DataFrame:
    """The documents of the mix in their own columns, each row as often as the mix takes it."""
    copies = mix(docs, id_column, text_column, source_column, **options)
    keys = [id_column, source_column, "size"]
    copies = copies.groupBy([F.col(f"`{k}`") for k in keys]).agg(
        F.sort_array(F.collect_list("copies")).alias("copies")
    )
    copies = copies.toDF("id", "source", "size", "copies")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_column}`").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{source_column}`").alias("source"),
        size.alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    place = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.lit(0)))
    rows = rows.withColumn("place", place)
    on = [rows[k].eqNullSafe(copies[k]) for k in ("id", "source", "size")]
    taken = rows.join(copies, on).select("row", F.element_at("copies", F.col("place").cast("int")).alias("copies"))
    return taken.where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select("row.*")
