"""The most frequent values of a column without a shuffle of all its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE, N_ROWS = "__value", "__n_rows"
BUCKET, IN_BUCKET = "__bucket", "__in_bucket"
#: Hash buckets of values; their counts are one small table, whatever the column holds.
BUCKETS = 65_536
#: Buckets whose values are counted first, twice as many as wanted values if that is more.
FULLEST = 64


def frequent(df: DataFrame, value: Column, n: int, buckets: int = BUCKETS) -> DataFrame:
    """Value and exact row count of the ``n`` most frequent values, ties in value order; NULL is a value.

    One pass counts rows by a hash bucket of the value, which tasks merge before the shuffle. The values in the
    fullest buckets, at least ``n``, are counted, and the n-th largest of these counts is a bar: a bucket with
    fewer rows cannot hold a value that reaches it. Values of all other buckets that reach the bar are counted
    too, so nothing is missed whatever the hash does. If most values are equally frequent, most buckets reach it
    and the values are counted as by a plain grouping, since all of them compete.
    """
    rows = df.select(value.alias(VALUE)).withColumn(BUCKET, F.pmod(F.xxhash64(VALUE), F.lit(buckets)))
    sizes = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias(IN_BUCKET))

    def counted(some: DataFrame) -> DataFrame:
        # At most one row for each bucket is broadcast.
        inside = rows.join(F.broadcast(some.select(BUCKET)), BUCKET, "left_semi")
        return inside.groupBy(VALUE).agg(F.count(F.lit(1)).alias(N_ROWS))

    # Each bucket holds a value: n buckets name n values, and fewer buckets are all there are.
    fullest = sizes.orderBy(F.desc(IN_BUCKET), BUCKET).limit(max(2 * n, FULLEST))
    first = counted(fullest)
    bar = first.orderBy(F.desc(N_ROWS)).limit(n).agg(F.min(N_ROWS)).scalar()
    # Mostly none: Spark then leaves this pass out, as it sees the empty table that is broadcast.
    others = sizes.where(F.col(IN_BUCKET) >= bar).join(F.broadcast(fullest.select(BUCKET)), BUCKET, "left_anti")
    return first.unionByName(counted(others)).orderBy(F.desc(N_ROWS), F.col(VALUE).asc_nulls_first()).limit(n)
