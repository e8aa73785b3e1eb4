from conftest import rows
import pytest
from pyspark.sql import functions as F

from tablekin.operators import cells as C
from tablekin.operators import overlap as O

LEFT = [(i, i % 3, "ab" if i % 2 else None) for i in range(9)]
RIGHT = [(i * 2, "ab", i % 3 + 0.5) for i in range(5)]


def sides(spark):
    left = spark.createDataFrame(LEFT, "a bigint, b int, c string")
    right = spark.createDataFrame(RIGHT, "x bigint, y string, z double")
    return C.value_sets(left), C.value_sets(right)


def brute():
    found = {}
    for lc in range(3):
        for rc in range(3):
            left = [str(r[lc]) for r in LEFT if r[lc] is not None]
            right = [str(r[rc]) for r in RIGHT if r[rc] is not None]
            shared = set(left) & set(right)
            if shared:
                pairs = sum(left.count(v) * right.count(v) for v in shared)
                found["abc"[lc], "xyz"[rc]] = (
                    len(shared),
                    pairs,
                    len(set(left)),
                    len(set(right)),
                )
    return found


def test_pair_overlap_equals_brute_force(spark):
    found = O.pair_overlap(*sides(spark)).collect()
    assert {
        (r["l_col"], r["r_col"]): (
            r["shared"],
            int(r["row_pairs"]),
            r["l_distinct"],
            r["r_distinct"],
        )
        for r in found
    } == brute()
    for r in found:
        assert r["shared"] <= min(r["l_distinct"], r["r_distinct"])
        assert 0 < r["l_ratio"] <= 1 and 0 < r["r_ratio"] <= 1


def test_zero_counts_as_a_value(spark):
    shared = O.shared_values(*sides(spark)).filter("match_key = '0'")
    assert rows(shared, "l_col", "r_col") == [("a", "x"), ("b", "x")]


def test_common_categories_and_candidates(spark):
    l_sets, r_sets = sides(spark)
    assert rows(O.common_categories(l_sets, r_sets), "l_col", "r_col", "category") == [
        ("a", "x", "P1"),
        ("b", "x", "P1"),
        ("c", "y", "S2"),
    ]
    candidates = O.candidate_pairs(spark, ["a", "b", "c"], ["x", "y", "z"])
    scored = O.scored_candidates(candidates, O.pair_overlap(l_sets, r_sets))
    assert scored.count() == 9
    assert scored.filter("shared = 0").count() == 6


def test_truth_and_report(spark):
    pairs = O.pair_overlap(*sides(spark))
    flagged = O.truth_flag(spark, pairs, [("a", "x"), ("q", "q")])
    assert rows(flagged.filter("true_positive"), "l_col", "r_col") == [("a", "x")]
    report = O.match_report(pairs, "t", "u", r_schema="s").filter("l_name = 't.c'")
    assert rows(report) == [(1, "t.c", 100.0, 1, 100.0, "s.u.y", 1)]


def test_row_pairs_beyond_64_bits_are_exact(spark):
    n = 4_000_000_000
    sets = spark.createDataFrame(
        [("k", "P1", str(i), n) for i in range(3)],
        "column_name string, category string, match_key string, n bigint",
    )
    counted = O.row_pair_count(sets, sets).first()["row_pairs"]
    assert int(counted) == 3 * n * n > 2**63


@pytest.mark.parametrize("columns", [["*"], ["l_col", "shared"], ["r_col", "l_ratio"]])
def test_tables_are_read_once_whatever_is_asked_for(spark, small, columns):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    customer = spark.read.parquet(f"{small}/customer.parquet")
    df = O.pair_overlap(C.value_sets(orders), C.value_sets(customer)).select(columns)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 8
    assert final.count("ReusedExchange") > 0


def test_shared_per_category(spark):
    l_sets, r_sets = sides(spark)
    found = O.shared_per_category(l_sets, r_sets)
    pairs = O.pair_overlap(l_sets, r_sets)
    total = found.groupBy("l_col", "r_col").agg(F.sum("shared").alias("shared"))
    assert rows(total) == rows(pairs, "l_col", "r_col", "shared")


def test_a_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k")
    )
    sets = C.value_sets(df)
    assert rows(sets.filter("match_key = '5'")) == [("k", "P1", "5", 10001)]
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")


def test_stored_sets_drop_what_cannot_match(spark):
    l_sets, r_sets = sides(spark)
    kept = O.comparable(r_sets, l_sets)
    assert kept.filter("column_name = 'z'").count() == 0
    columns = ("l_col", "r_col", "shared", "l_distinct", "r_distinct")
    assert rows(O.pair_overlap(l_sets, r_sets, stored=True), *columns) == rows(
        O.pair_overlap(l_sets, r_sets), *columns
    )


def test_catalog_overlap_equals_that_of_every_two_tables(spark):
    tables = {
        "a": spark.createDataFrame([(i, str(i % 7), None) for i in range(50)], "k bigint, t string, e string"),
        "b": spark.createDataFrame([(i * 2, f"x{i % 3}") for i in range(40)], "k int, t string"),
        "c": spark.createDataFrame([("x1", "07"), ("", "3"), (None, "x2")] * 5, "u string, v string"),
        "d": spark.createDataFrame([], "k bigint"),
    }
    sets = {t: C.value_sets(df) for t, df in tables.items()}
    found = O.catalog_overlap(O.catalog_sets(sets))
    named = ["l_table", "l_col", "r_table", "r_col", "shared", "l_distinct", "r_distinct", "l_ratio", "r_ratio"]
    expected = []
    for l, r in [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")]:
        for p in O.pair_overlap(sets[l], sets[r]).collect():
            expected.append((l, p["l_col"], r, p["r_col"], *[p[c] for c in named[4:]]))
    assert rows(found, *named) == sorted(expected) and len(expected) > 4
    # Each value set is grouped once, keys once, lists once, pairs once.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.count("collect_set") == 1
