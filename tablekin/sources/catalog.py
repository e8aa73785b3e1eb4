"""Descriptions of tables and their columns, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.operators import cells as C
from tablekin.operators.overlap import column_totals

TABLES = "id bigint, schema string, name string, dumpfile string"
COLUMNS = (
    "id bigint, table_id bigint, num int, name string, data_type string, "
    "char_length int, precision int, scale int"
)
IDS_PER_TABLE = 1000


class CatalogError(ValueError):
    """A catalog that names incomplete tables or columns."""


def catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Table and column descriptions taken from the schemas of DataFrames.

    Tables are numbered from 1; column ids are unique over the tables.
    """
    table_rows, column_rows = [], []
    width = max([IDS_PER_TABLE, *(len(df.columns) + 1 for df in tables.values())])
    for table_id, (name, df) in enumerate(tables.items(), 1):
        table_rows.append((table_id, schema, name, f"{name}.parquet"))
        for num, field in enumerate(df.schema, 1):
            column_rows.append(
                (
                    table_id * width + num,
                    table_id,
                    num,
                    field.name,
                    field.dataType.simpleString(),
                    None,
                    getattr(field.dataType, "precision", None),
                    getattr(field.dataType, "scale", None),
                )
            )
    return (
        spark.createDataFrame(table_rows, TABLES),
        spark.createDataFrame(column_rows, COLUMNS),
    )


def column_catalog(
    spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = ""
) -> DataFrame:
    """The catalog with what the data adds to it: cells, distinct keys, categories."""
    described, columns = catalog(spark, tables, schema)
    found = []
    for name, df in tables.items():
        sets = C.value_sets(df)
        found.append(
            column_totals(sets)
            .join(C.column_categories(sets), "column_name")
            .withColumn("table_name", F.lit(name))
        )
    data = found[0]
    for more in found[1:]:
        data = data.unionByName(more)
    return (
        columns.withColumnRenamed("name", "column_name")
        .join(
            described.select(F.col("id").alias("table_id"), F.col("name").alias("table_name")),
            "table_id",
        )
        .join(data, ["table_name", "column_name"], "left")
        .select(
            "table_name",
            "column_name",
            "num",
            "data_type",
            F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
            F.coalesce("distinct_keys", F.lit(0)).alias("distinct_keys"),
            "categories",
        )
    )


def catalog_from_tables(table_info: DataFrame, column_info: DataFrame) -> DataFrame:
    """Join stored descriptions, columns in their order; tables without any stay.

    An inner join, which can split a table of very many columns, and the tables
    left over from it.

    ``table_info(id, name, dumpfile)``; ``column_info(id, table_info_id, num, name,
    data_type, char_length, precision, scale)``.
    """
    tables = table_info.select(
        F.col("id").alias("table_id"), F.col("name").alias("table_name"), "dumpfile"
    )
    columns = column_info.select(
        F.col("table_info_id").alias("table_id"),
        F.col("id").alias("column_id"),
        "num",
        F.col("name").alias("column_name"),
        "data_type",
        "char_length",
        "precision",
        "scale",
    )
    described = tables.join(columns, "table_id")
    without = tables.join(columns.select("table_id").distinct(), "table_id", "left_anti")
    return described.unionByName(without, allowMissingColumns=True).orderBy(
        "table_id", "num"
    )


def _missing(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def _label(kind: str, *columns: str):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]
    return F.concat(F.lit(f"{kind} "), F.concat_ws(":", *parts))


def catalog_checks(table_info: DataFrame, column_info: DataFrame) -> DataFrame:
    """What is incomplete in stored descriptions: ``(rule, object)``.

    Where tables carry a ``source_id``, each must name the source it was read from.
    """
    table = _label("table", "id", "name")
    column = _label("column", "id", "name")

    def broken(df: DataFrame, rule: str, label) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), label.alias("object"))

    used = column_info.select(F.col("table_info_id").alias("id")).distinct()
    known = table_info.select(F.col("id").alias("table_info_id")).distinct()
    found = [
        broken(table_info.filter(_missing("id")), "table id", table),
        broken(table_info.filter(_missing("name")), "table name", table),
        broken(table_info.filter(_missing("dumpfile")), "dump file", table),
        broken(table_info.join(used, "id", "left_anti"), "table columns", table),
        broken(column_info.filter(_missing("id")), "column id", column),
        broken(
            column_info.join(known, "table_info_id", "left_anti"),
            "column table",
            column,
        ),
    ]
    if "source_id" in table_info.columns:
        sourceless = table_info.filter(_missing("source_id"))
        found.append(broken(sourceless, "table source", table))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def require_complete(table_info: DataFrame, column_info: DataFrame) -> None:
    """Raise ``CatalogError`` with the number of violations per rule, if there are any.

    ``catalog_checks`` lists them all.
    """
    broken = catalog_checks(table_info, column_info).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.min("object").alias("example")
    )
    found = broken.orderBy("rule").collect()
    if found:
        told = (f"{r['rule']}: {r['n']}, such as {r['example']}" for r in found)
        raise CatalogError("; ".join(told) + "; catalog_checks lists all")
