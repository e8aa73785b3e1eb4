"""Statistics of the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions import values as V
from tablekin.operators import cells as C

#: Columns whose statistics are taken in one pass over the source.
COLUMNS_PER_PASS = 100


def _number(value: Column, text: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.IntegralType, T.FloatType, T.DoubleType)):
        return value.cast("double")
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    return V.float_value(text)


def _kind(text: Column, number: Column) -> Column:
    """What one cell is; NULL for a missing one."""
    whole = ~F.isnan(number) & (F.rint(number) == number)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(number.isNull(), "STRING").when(whole, "INTEGER").otherwise("FLOAT")
    )


def _real_type(kinds: Column) -> Column:
    """The widest kind a column has; NULL for a column without values."""
    widest = F.when(F.size(kinds) == 0, F.lit(None).cast("string"))
    for kind in ("STRING", "FLOAT"):
        widest = widest.when(F.array_contains(kinds, kind), kind)
    return widest.otherwise("INTEGER")


def _statistics(name: str, text: Column, number: Column) -> Column:
    ordered = F.when(~F.isnan(number), number)
    # At most three kinds, whatever the data.
    kinds = F.collect_set(_kind(text, number))
    numeric = (F.size(kinds) > 0) & ~F.array_contains(kinds, "STRING")
    size = F.octet_length(text)
    return F.struct(
        F.lit(name).alias("column_name"),
        F.count_if(text.isNull()).alias("null_count"),
        F.min(text).alias("min_string"),
        F.max(text).alias("max_string"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.when(numeric, F.min(ordered)).alias("min_numeric"),
        F.when(numeric, F.max(ordered)).alias("max_numeric"),
        _real_type(kinds).alias("real_type"),
    )


def _type_only(name: str, text: Column, number: Column) -> Column:
    kinds = F.collect_set(_kind(text, number))
    return F.struct(F.lit(name).alias("column_name"), _real_type(kinds).alias("real_type"))


def _one_pass_each(
    df: DataFrame, columns: Sequence[str] | None, per_column
) -> DataFrame:
    """Aggregate all columns side by side, in one pass for each ``COLUMNS_PER_PASS``.

    Text and number of a cell are projected first, so that they are computed
    once per cell rather than once per statistic.
    """
    names = list(columns or C.scalar_columns(df))
    passes = []
    for start in range(0, len(names), COLUMNS_PER_PASS):
        group = names[start : start + COLUMNS_PER_PASS]
        cells, results = [], []
        for i, name in enumerate(group):
            value, data_type = C.quoted(name), df.schema[name].dataType
            text = F.nullif(value.cast("string"), F.lit(""))
            cells.append(text.alias(f"t{i}"))
            cells.append(_number(value, text, data_type).alias(f"d{i}"))
            results.append(per_column(name, F.col(f"t{i}"), F.col(f"d{i}")))
        counted = df.select(*cells).agg(F.array(*results).alias("columns"))
        passes.append(counted.select(F.inline("columns")))
    return reduce(DataFrame.unionByName, passes)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of statistics per column, over its non-empty values.

    The source is read once: all columns are aggregates of one ungrouped pass, which
    keeps its text minima and sets of kinds as objects, so no cell is shuffled or
    sorted and a task sends one row. Only tables of more than ``COLUMNS_PER_PASS``
    columns take more passes, each over its own columns. A pass has as many tasks as
    the source has splits; deal a small source out over the cores first.
    """
    return _one_pass_each(df, columns, _statistics)


def real_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What the values of each column really are: INTEGER, FLOAT or STRING."""
    return _one_pass_each(df, columns, _type_only)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, distinct hashes and an estimate, per column."""
    hashed = C.distinct_values(df, columns).withColumn(
        "hash", F.xxhash64("raw_key")
    )
    per_hash = hashed.groupBy("column_name", "hash").agg(
        F.count(F.lit(1)).alias("values")
    )
    return per_hash.groupBy("column_name").agg(
        F.sum("values").alias("distinct_count"),
        F.count(F.lit(1)).alias("hash_unique_count"),
        F.approx_count_distinct("hash").alias("approx_count"),
    )


#: Log2 of the registers of a sketch; its standard error is about 1.04 / sqrt(2 ** it).
SKETCH_REGISTERS = 14


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A HyperLogLog sketch of the distinct values of each column: ``(column_name, sketch)``.

    Made in one pass: a task sends a sketch per column, however many values there are,
    and nothing is grouped by value. Sketches of parts of a table merge into that of the
    whole, so those of new files can be added to stored ones. A column without values
    has a sketch of none, an empty table has no sketches.
    """
    names = list(columns or C.scalar_columns(df))
    wide = df.select(*[F.nullif(C.quoted(c).cast("string"), F.lit("")).alias(c) for c in names])
    long = wide.unpivot([], [C.quoted(c) for c in names], "column_name", "value")
    return long.groupBy("column_name").agg(F.hll_sketch_agg("value", SKETCH_REGISTERS).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per column from any number of them."""
    return sketches.groupBy("column_name").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``(column_name, estimate)``: about how many distinct values each column has."""
    return sketches.select("column_name", F.hll_sketch_estimate("sketch").alias("estimate"))
