from functools import reduce

from conftest import rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.operators import profile as PR

DATA = [
    ("1", "1.5", "x", None, float("nan"), 2),
    ("20", "", "é", None, 2.0, None),
    (None, "nan", "", None, float("-inf"), -7),
    ("-3", "1e3", "yy", None, None, 0),
]
SCHEMA = "whole string, frac string, txt string, gone string, d double, i int"


def test_profile(spark):
    found = {r["column_name"]: tuple(r)[1:] for r in PR.column_profile(spark.createDataFrame(DATA, SCHEMA)).collect()}
    assert found["whole"] == (1, "-3", "20", 1, 2, -3.0, 20.0, "INTEGER")
    assert found["frac"] == (1, "1.5", "nan", 3, 3, 1.5, 1000.0, "FLOAT")
    assert found["txt"] == (1, "x", "é", 1, 2, None, None, "STRING")
    assert found["gone"] == (4, None, None, None, None, None, None, None)
    assert found["d"] == (1, "-Infinity", "NaN", 3, 9, float("-inf"), 2.0, "FLOAT")
    assert found["i"] == (1, "-7", "2", 1, 2, -7.0, 2.0, "INTEGER")


def test_one_text_that_is_no_number_makes_a_column_text(spark):
    df = spark.createDataFrame([("1",), ("1e400",)], "c string")
    row = PR.column_profile(df).first()
    assert (row["min_numeric"], row["real_type"]) == (None, "STRING")


def test_real_type_agrees_with_the_profile(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    full = PR.column_profile(df).select("column_name", "real_type")
    assert rows(PR.real_type(df)) == rows(full)


def test_distinct_counts_keep_spellings_apart(spark):
    df = spark.createDataFrame([("07", 1), ("+7", 1), ("07", 2), ("", None)], "t string, n int")
    found = PR.distinct_counts(df).select("column_name", "distinct_count", "hash_unique_count")
    assert rows(found) == [("n", 2, 2), ("t", 2, 2)]


def test_profile_needs_no_shuffle_of_cells(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = PR.column_profile(lines)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort [" not in plan


def test_profile_reads_its_source_once(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    for found in (PR.column_profile(lines), PR.real_type(lines)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1


def test_profile_of_more_columns_than_a_pass(spark, monkeypatch):
    wide = spark.range(20).select(*[(F.col("id") * i).cast("string" if i % 2 else "double").alias(f"c{i}") for i in range(130)])
    whole = rows(PR.column_profile(wide))
    assert len(whole) == 130
    monkeypatch.setattr(PR, "COLUMNS_PER_PASS", 7)
    assert rows(PR.column_profile(wide)) == whole
    assert rows(PR.column_profile(wide.limit(0)).select("null_count", "real_type")) == [(0, None)] * 130


def test_sketches_merge_into_that_of_the_whole(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("k"), (F.col("id") % 1000).cast("string").alias("t"), F.lit(None).cast("string").alias("e")
    )
    parts = [df.filter(F.col("k") % 3 == i) for i in range(3)] + [df.filter("k < 20000"), df.limit(0)]
    merged = PR.merged_sketches(reduce(DataFrame.unionByName, map(PR.distinct_sketches, parts)))
    found = {r["column_name"]: r["estimate"] for r in PR.sketched_counts(merged).collect()}
    whole = {r["column_name"]: r["estimate"] for r in PR.sketched_counts(PR.distinct_sketches(df)).collect()}
    for name, exact in (("k", 40_000), ("t", 1000), ("e", 0)):
        # Three standard errors.
        assert abs(found[name] - exact) <= 0.025 * exact
        assert abs(found[name] - whole[name]) <= 0.025 * exact
