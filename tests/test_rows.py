import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablekin.operators import overlap as O
from tablekin.operators import rows as R

LEFT = [(i, 7 if i % 3 == 0 else i, i % 4) for i in range(60)]
RIGHT = [(100 + i, 7 if i % 3 == 0 else i) for i in range(45)]


def tables(spark, part_rows):
    left = spark.createDataFrame(LEFT, "lid bigint, k bigint, m bigint")
    right = spark.createDataFrame(RIGHT, "rid bigint, j bigint")
    return (
        R.Side.of(left, "lid", part_rows=part_rows),
        R.Side.of(right, "rid", part_rows=part_rows),
    )


def brute():
    return sorted(
        ("lid k m".split()[a], "rid j".split()[b], l[0], r[0])
        for l in LEFT
        for r in RIGHT
        for a in range(3)
        for b in range(2)
        if l[a] == r[b]
    )


@pytest.mark.parametrize("part_rows,block_pairs", [(10**6, 10**6), (4, 9), (1, 1)])
def test_row_pairs_equal_brute_force(spark, part_rows, block_pairs):
    left, right = tables(spark, part_rows)
    assert rows(R.row_pairs(left, right, block_pairs=block_pairs)) == brute()


def test_row_pairs_of_chosen_pairs(spark):
    left, right = tables(spark, 4)
    chosen = spark.createDataFrame([("k", "j"), ("m", "rid")], "l_col string, r_col string")
    expected = [r for r in brute() if (r[0], r[1]) == ("k", "j")]
    assert rows(R.row_pairs(left, right, chosen)) == expected


def test_count_without_listing(spark):
    left, right = tables(spark, 4)
    listed = R.row_pairs(left, right).groupBy("l_col", "r_col").count()
    counted = O.row_pair_count(left.sets, right.sets).withColumn(
        "row_pairs", F.col("row_pairs").cast("bigint")
    )
    assert rows(listed) == rows(counted)


@pytest.mark.parametrize("part_rows", [10**6, 3])
def test_matched_rows(spark, part_rows):
    left, right = tables(spark, part_rows)
    found = R.matched_rows(left, right)
    expected = {(a, b, "left", l) for a, b, l, _ in brute()}
    expected |= {(a, b, "right", r) for a, b, _, r in brute()}
    assert rows(found) == sorted(expected)
    counts = {
        (r["l_col"], r["r_col"]): (r["l_rows"], r["r_rows"])
        for r in R.matched_row_counts(left.sets, right.sets).collect()
    }
    for pair, (l_rows, r_rows) in counts.items():
        assert l_rows == len([r for r in expected if r[:3] == (*pair, "left")])
        assert r_rows == len([r for r in expected if r[:3] == (*pair, "right")])


def test_fetch_matched_rows(spark):
    left, right = tables(spark, 3)
    df = spark.createDataFrame(LEFT, "lid bigint, k bigint, m bigint")
    found = R.fetch_matched_rows(df, "lid", left, right.sets)
    assert rows(found, "lid") == sorted({(l,) for _, _, l, _ in brute()})


def test_heavy_values(spark):
    left, _ = tables(spark, 6)
    assert rows(left.heavy) == [
        ("k", "P1", "7", 4),
        ("m", "P1", "0", 3),
        ("m", "P1", "1", 3),
        ("m", "P1", "2", 3),
        ("m", "P1", "3", 3),
    ]


def test_long_lists_of_heavy_values_are_shuffled(spark, monkeypatch):
    left, right = tables(spark, 1)
    monkeypatch.setattr(R, "FEW", 2)
    listed = R.row_pairs(left, right, block_pairs=1).groupBy("l_col", "r_col").count()
    counted = O.row_pair_count(left.sets, right.sets).select(
        "l_col", "r_col", F.col("row_pairs").cast("bigint")
    )
    assert rows(listed) == rows(counted)


def test_chosen_pairs_make_no_other_rows(spark):
    left = spark.createDataFrame([(i, 1, i) for i in range(60)], "a bigint, s bigint, k bigint")
    right = spark.createDataFrame([(i, 1, i) for i in range(50)], "x bigint, t bigint, m bigint")
    wanted = spark.createDataFrame([("k", "m")], "l_col string, r_col string")
    found = R.row_pairs(R.Side.of(left, "a"), R.Side.of(right, "x"), pairs=wanted)
    assert rows(found, "l_row", "r_row") == [(i, i) for i in range(50)]


def test_fetch_pair_rows(spark):
    left, right = tables(spark, 3)
    df = spark.createDataFrame(LEFT, "lid bigint, k bigint, m bigint")
    for pair in {(a, b) for a, b, _, _ in brute()}:
        found = R.fetch_pair_rows(df, "lid", left, right.sets, *pair)
        expected = sorted({(l,) for a, b, l, _ in brute() if (a, b) == pair})
        assert rows(found, "lid") == expected


def test_pieces_spread_a_hot_value_over_partitions(spark):
    base = spark.range(20000).select("id", F.lit(1).alias("k"))
    side = R.Side.of(base, "id", ["k"], part_rows=500)
    keys = side.sets.select(*R.KEY)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.hits(side.index, keys, side.heavy)
        sizes = [
            r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20000
    assert len(sizes) > 4
