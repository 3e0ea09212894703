"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir

#: The white space that separates words, and what is not white space.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A side of a join with more rows than this is not broadcast.
BROADCAST_ROWS = 20_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder; a lost executor costs only its own tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """A checkpointed table, marked for broadcast when a count shows that it is small."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole_text(name: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(whole_text(id_column), "utf-8")), F.lit(folds))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
