"""Cells of a table and the distinct values of its columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions import values as V

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_ROW = "__row"


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns whose values have a text form: all but the nested ones."""
    return [f.name for f in df.schema if not isinstance(f.dataType, _NESTED)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def cells(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row ``(row_id, column_name, value)`` per non-empty cell, as text."""
    names = list(columns or scalar_columns(df))
    wide = df.select(
        quoted(row_id).alias(_ROW),
        *[quoted(c).cast("string").alias(c) for c in names],
    )
    long = wide.unpivot(_ROW, [quoted(c) for c in names], "column_name", "value")
    return long.filter("value <> ''").withColumnRenamed(_ROW, "row_id")


def value_index(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """From value to row: ``(row_id, column_name, category, match_key)``.

    Category and key are computed before the unpivot, where each column still
    has its type, so only text columns go through the patterns.
    """
    names = list(columns or scalar_columns(df))
    keyed = []
    for c in names:
        value, data_type = quoted(c), df.schema[c].dataType
        pair = F.struct(
            V.typed_category(value, data_type).alias("category"),
            V.typed_match_key(value, data_type).alias("match_key"),
        )
        keyed.append(F.when(value.cast("string") != "", pair).alias(c))
    wide = df.select(quoted(row_id).alias(_ROW), *keyed)
    long = wide.unpivot(_ROW, [quoted(c) for c in names], "column_name", "cell")
    return long.filter("cell IS NOT NULL").select(
        F.col(_ROW).alias("row_id"), "column_name", "cell.category", "cell.match_key"
    )


def value_sets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys per column: ``(column_name, category, match_key, n)``.

    Columns are grouped by their own type, one grouping per kind of type, and
    turned into text only once per distinct value. Each grouping combines on the
    map side, so a value that fills a third of the table costs nothing extra.
    """
    kinds = _by_kind(df, columns)
    lanes = [_LANES[kind](df, group) for kind, group in sorted(kinds.items())]
    return reduce(DataFrame.unionByName, lanes)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.DoubleType):
        return "double"
    if isinstance(data_type, _TEMPORAL):
        return data_type.typeName()
    return "text"


def _by_kind(df: DataFrame, columns: Sequence[str] | None) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {}
    for c in columns or scalar_columns(df):
        kinds.setdefault(_kind(df.schema[c].dataType), []).append(c)
    return kinds


def _unpivoted(df: DataFrame, names: Sequence[str], spark_type: str) -> DataFrame:
    wide = df.select(*[quoted(c).cast(spark_type).alias(c) for c in names])
    return wide.unpivot([], [quoted(c) for c in names], "column_name", "value")


def _counted(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy("column_name", *keys).agg(F.count(F.lit(1)).alias("n"))


def _integer_lane(df: DataFrame, names: Sequence[str]) -> DataFrame:
    found = _unpivoted(df, names, "bigint").filter("value IS NOT NULL")
    text = F.col("value").cast("string")
    return _counted(found, "value").select(
        "column_name",
        F.concat(V.sign_class(F.col("value")), F.octet_length(text)).alias("category"),
        text.alias("match_key"),
        "n",
    )


def _double_lane(df: DataFrame, names: Sequence[str]) -> DataFrame:
    # Grouping takes -0.0 and 0.0 for one value, their texts differ.
    zero_text = F.when(F.col("value") == 0, F.col("value").cast("string"))
    found = (
        _unpivoted(df, names, "double")
        .filter("value IS NOT NULL")
        .withColumn("zero_text", zero_text)
    )
    text = F.coalesce("zero_text", F.col("value").cast("string"))
    return _fixed_class(_counted(found, "value", "zero_text"), text, "F")


def _temporal_lane(spark_type: str):
    def lane(df: DataFrame, names: Sequence[str]) -> DataFrame:
        found = _unpivoted(df, names, spark_type).filter("value IS NOT NULL")
        text = F.col("value").cast("string")
        return _fixed_class(_counted(found, "value"), text, "S")

    return lane


def _fixed_class(counted: DataFrame, text: Column, letter: str) -> DataFrame:
    keyed = counted.select("column_name", text.alias("text"), "n")
    key = V.text_key(F.col("text")) if letter == "S" else F.col("text")
    category = F.concat(F.lit(letter), F.octet_length("text"))
    return keyed.select(
        "column_name", category.alias("category"), key.alias("match_key"), "n"
    )


def _text_lane(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys are made before the grouping: ``07`` and ``+7`` merge there, and of a
    text only its digest is shuffled, however long it is."""
    text, number, letter = F.col("value"), F.col("number"), F.col("letter")
    other = F.when(letter == "F", text).otherwise(V.text_key(text))
    keyed = (
        _unpivoted(df, names, "string")
        .filter("value <> ''")
        .withColumn("number", V.integer_value(text))
        .withColumn(
            "letter",
            F.when(number.isNotNull(), V.sign_class(number)).otherwise(
                V.text_class(text)
            ),
        )
        .select(
            "column_name",
            "letter",
            F.octet_length("value").alias("size"),
            F.coalesce(number.cast("string"), other).alias("match_key"),
        )
    )
    return _counted(keyed, "letter", "size", "match_key").select(
        "column_name",
        F.concat("letter", F.col("size")).alias("category"),
        "match_key",
        "n",
    )


_LANES = {
    "integer": _integer_lane,
    "double": _double_lane,
    "date": _temporal_lane("date"),
    "timestamp": _temporal_lane("timestamp"),
    "timestamp_ntz": _temporal_lane("timestamp_ntz"),
    "text": _text_lane,
}


def _raw_text_lane(df: DataFrame, names: Sequence[str]) -> DataFrame:
    text = F.col("value")
    keyed = (
        _unpivoted(df, names, "string")
        .filter("value <> ''")
        .select(
            "column_name",
            F.octet_length("value").alias("size"),
            V.text_key(text).alias("match_key"),
        )
    )
    return _counted(keyed, "size", "match_key")


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct raw values per column, different spellings of a number apart.

    ``raw_key`` stands for the value; ``n`` counts its cells.
    """
    kinds = _by_kind(df, columns)
    lanes = [
        (_raw_text_lane if kind == "text" else _LANES[kind])(df, group).select(
            "column_name", F.col("match_key").alias("raw_key"), "n"
        )
        for kind, group in sorted(kinds.items())
    ]
    return reduce(DataFrame.unionByName, lanes)


def category_summary(sets: DataFrame) -> DataFrame:
    """Distinct keys and cells per column and category."""
    return sets.groupBy("column_name", "category").agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.sum("n").alias("n_cells")
    )


def column_categories(sets: DataFrame) -> DataFrame:
    """The categories each column has, as a sorted array."""
    return sets.groupBy("column_name").agg(
        F.sort_array(F.collect_set("category")).alias("categories")
    )


def single_column_set(df: DataFrame, column: str) -> DataFrame:
    """Distinct keys of one chosen column."""
    return value_sets(df, [column]).drop("column_name")
