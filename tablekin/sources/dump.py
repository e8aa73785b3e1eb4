"""Headerless delimited dumps and row numbers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of a dump: ``(row_id, line)``, the first line being 1.

    A final line without a line end counts. Lines are numbered inside their
    input split and shifted by the lines of the splits before it, so only one
    small row per split is ever ordered. Several files count on in path order.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    blocks = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq")
    )
    position = F.col("seq") - F.col("first_seq")
    return _shifted(lines, blocks, ["file", "start"], "lines", position).select(
        "row_id", "line"
    )


def with_row_number(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 1-based row number to a DataFrame read from Parquet.

    Files count on in path order. The numbers are those of the stored rows, so
    apply this before any filter.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__index"),
    )
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    numbered = _shifted(placed, files, ["__file"], "__rows", F.col("__index"))
    return numbered.select(F.col("row_id").alias(name), *df.columns)


def _shifted(
    rows: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    size: str,
    position: Column,
) -> DataFrame:
    """Number rows by their position in a block and the sizes of earlier blocks.

    A block is known by the hash of its file's path and its start. That is a few
    numbers per input split, 30 MB for the splits of 100 TB, so they are broadcast and
    no line is shuffled.
    """
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(before), F.lit(0))
    file, *rest = keys
    shifts = blocks.withColumn("__offset", offset).withColumn(
        "__block", F.xxhash64(file)
    )
    shifts = shifts.drop(file, size)
    known = rows.withColumn("__block", F.xxhash64(file))
    return known.join(F.broadcast(shifts), ["__block", *rest]).withColumn(
        "row_id", F.col("__offset") + position + 1
    )


def _n_fields(line: Column, delimiter: str) -> Column:
    return F.size(F.split(line, re.escape(delimiter), -1))


def _fields(line: Column, columns: Sequence[str], delimiter: str) -> list[Column]:
    parts = F.split(line, re.escape(delimiter), -1)
    return [
        F.nullif(parts[i], F.lit("")).alias(name) for i, name in enumerate(columns)
    ]


def dump_scan(
    spark: SparkSession, path: str, columns: Sequence[str], delimiter: str = "|"
) -> DataFrame:
    """Rows of a dump: ``row_id`` and one text column per name, empty as NULL.

    There is no quoting. A line of another number of fields is an error, also
    when the query at hand does not look at any of its fields.
    """
    lines = read_lines(spark, path)
    n = _n_fields(F.col("line"), delimiter)
    message = F.concat(
        F.lit(f"expected {len(columns)} columns, found "),
        n,
        F.lit(" in line "),
        F.col("row_id"),
    )
    fits = F.when(n == len(columns), True).otherwise(F.raise_error(message))
    return lines.filter(fits.cast("boolean")).select(
        "row_id", *_fields(F.col("line"), columns, delimiter)
    )


def bad_lines(
    spark: SparkSession, path: str, n_columns: int, delimiter: str = "|"
) -> DataFrame:
    """Lines of another number of fields: ``(row_id, n_fields)``."""
    n = _n_fields(F.col("line"), delimiter).alias("n_fields")
    return (
        read_lines(spark, path).select("row_id", n).filter(F.col("n_fields") != n_columns)
    )


def write_dump(df: DataFrame, path: str, delimiter: str | None = "|") -> None:
    """Write a DataFrame as a dump in the form ``dump_scan`` reads.

    There is no quoting, so a value with the delimiter or a line end is an error. A
    single column may be written without a delimiter.
    """
    if delimiter is None and len(df.columns) > 1:
        raise ValueError("several columns need a delimiter")
    texts = []
    for c in df.columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        breaks = F.contains(text, F.lit("\n"))
        if delimiter is not None:
            breaks = breaks | F.contains(text, F.lit(delimiter))
        message = F.concat(F.lit(f"{c} cannot be written without quoting: "), text)
        texts.append(F.when(breaks, F.raise_error(message)).otherwise(text))
    df.select(F.concat_ws(delimiter or "", *texts).alias("value")).write.mode(
        "overwrite"
    ).text(path, lineSep="\n")
