"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists made of about ``size`` bytes each.

    Keeps the memory of a very long text bounded; ``bytes.split`` separates at the
    same six characters as :data:`WORD`.
    """
    start, end = 0, len(text)
    while start < end:
        stop = end
        if start + size < end and (gap := _GAP.search(text, start + size)):
            stop = gap.start()
        if words := text[start:stop].split():
            yield words
        start = stop


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; a missing text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 if it is missing."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, rows: int) -> bool:
    """True if a frame has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
