from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from tablekin.functions import values
from tablekin.operators import cells as C

MIXED = [
    (1, "07", 1.5, None, "a"),
    (2, "+7", -0.0, 3, ""),
    (3, "7", 0.0, 0, None),
    (4, "-3", float("nan"), -4, "a"),
    (5, "x" * 70, float("inf"), 3, "1.50"),
    (6, "y" * 70, 1.5, 3, "1.5"),
]
SCHEMA = "id bigint, t string, d double, i int, `odd.name` string"


def brute_sets(df):
    """Value sets the plain way: every cell as text, one by one."""
    found = Counter()
    text = df.select([C.quoted(c).cast("string") for c in df.columns]).collect()
    cells = [(c, v) for row in text for c, v in zip(df.columns, row) if v]
    spark = df.sparkSession
    keyed = spark.createDataFrame(cells, "c string, v string").select(
        "c", values.value_category(F.col("v")), values.match_key(F.col("v"))
    )
    for row in keyed.collect():
        found[tuple(row)] += 1
    return found


def test_value_sets_equal_cell_by_cell_counting(spark):
    df = spark.createDataFrame(MIXED, SCHEMA).withColumn("z", F.lit("2020-01-01").cast("date"))
    found = {tuple(r)[:3]: r["n"] for r in C.value_sets(df).collect()}
    assert found == brute_sets(df)


def test_spellings_of_an_integer_merge_within_a_length(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    assert rows(C.value_sets(df, ["t"]).filter("match_key = '7'")) == [
        ("t", "P1", "7", 1),
        ("t", "P2", "7", 2),
    ]


def test_negative_integers_and_zero(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    assert rows(C.value_sets(df, ["i"])) == [
        ("i", "N2", "-4", 1),
        ("i", "P1", "0", 1),
        ("i", "P1", "3", 3),
    ]


def test_cells_and_index_skip_empty_ones(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    assert rows(C.cells(df, "id", ["odd.name"]), "row_id", "value") == [
        (1, "a"),
        (4, "a"),
        (5, "1.50"),
        (6, "1.5"),
    ]
    index = C.value_index(df, "id")
    assert index.groupBy("column_name", "category", "match_key").count().count() == len(
        brute_sets(df)
    )
    assert index.count() == sum(brute_sets(df).values())


def test_columns_named_like_our_own(spark):
    df = spark.createDataFrame(
        [(1, 2, "x"), (2, 3, "y")], "row_id bigint, value bigint, column_name string"
    )
    assert rows(C.cells(df, "row_id")) == [
        (1, "column_name", "x"),
        (1, "row_id", "1"),
        (1, "value", "2"),
        (2, "column_name", "y"),
        (2, "row_id", "2"),
        (2, "value", "3"),
    ]
    assert C.value_index(df, "row_id").count() == 6
    assert C.value_sets(df).count() == 6


def test_nested_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0])], "id int, e array<double>")
    assert C.scalar_columns(df) == ["id"]


def test_summaries(spark):
    sets = C.value_sets(spark.createDataFrame(MIXED, SCHEMA), ["t"])
    assert rows(C.category_summary(sets)) == [
        ("t", "N2", 1, 1),
        ("t", "P1", 1, 1),
        ("t", "P2", 1, 2),
        ("t", "S70", 2, 2),
    ]
    assert C.column_categories(sets).first()["categories"] == ["N2", "P1", "P2", "S70"]


def test_single_column(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    assert rows(C.single_column_set(df, "i"))[0] == ("N2", "-4", 1)

