"""Keeping a narrow table for the length of a multi-pass computation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Persist a table that several passes read, and free it unless it was kept before.

    Lost blocks are recomputed from the source, so losing an executor costs time only.
    """
    if df.storageLevel != StorageLevel.NONE:
        yield df
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
