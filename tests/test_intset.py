import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablekin.operators import intset as I

random.seed(7)
EDGES = {0, 15, 16, 63, 64, 65535, 65536, 8388608, 8388609}
SETS = {
    "empty": set(),
    "zero": {0},
    "edges": EDGES,
    "run": set(range(1, 200)),
    "few": {1, 10, 100, 105},
    "large": {random.randrange(2**62) for _ in range(50)} | {2**62, 2**62 + 1, 5},
    "dense": {random.randrange(3000) for _ in range(900)},
}
PAIRS = [
    ("empty", "empty"),
    ("few", "empty"),
    ("edges", "zero"),
    ("run", "few"),
    ("run", "run"),
    ("large", "dense"),
]


def frame(spark, elements, column="element"):
    return spark.createDataFrame([(e,) for e in sorted(elements)], f"{column} bigint")


def elements(df):
    listed = [r[0] for r in df.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


@pytest.mark.parametrize("left,right", PAIRS)
def test_two_sets(spark, left, right):
    a, b = SETS[left], SETS[right]
    # Repeated elements must make no difference.
    fa = frame(spark, a).union(frame(spark, a))
    fb = frame(spark, b)
    assert elements(I.set_intersect(fa, fb)) == a & b
    assert elements(I.set_difference(fa, fb)) == a - b
    assert elements(I.set_union(fa, fb)) == a | b
    assert elements(I.set_symmetric_difference(fa, fb)) == a ^ b
    assert tuple(I.set_comparison(fa, fb).first()) == (
        len(a),
        len(b),
        len(a & b),
        len(a - b),
        len(a | b),
        len(a ^ b),
        a == b,
        a >= b,
        a > b,
    )
    wa, wb = I.bitmap_encode(fa), I.bitmap_encode(fb)
    for operator, expected in (
        (I.bitmap_and, a & b),
        (I.bitmap_andnot, a - b),
        (I.bitmap_or, a | b),
        (I.bitmap_xor, a ^ b),
    ):
        words = operator(wa, wb)
        assert elements(I.bitmap_decode(words)) == expected
        assert I.bitmap_cardinality(words).first()[0] == len(expected)


@pytest.mark.parametrize("name", SETS)
def test_one_set(spark, name):
    a = SETS[name]
    fa = frame(spark, a).union(frame(spark, a))
    assert I.set_cardinality(fa).first()[0] == len(a)
    assert tuple(I.set_emptiness(fa).first()) == (not a, bool(a))
    top = max(a, default=0)
    positive = len([e for e in a if e >= 1])
    assert I.set_all(fa).first()[0] == (positive == top)
    assert I.set_storage_size(fa).first()[0] == 4 + 16 * len({e >> 6 for e in a})
    assert elements(I.bitmap_decode(I.bitmap_encode(fa))) == a
    assert I.bitmap_pages_cardinality(I.bitmap_pages(fa)).first()[0] == len(a)
    if top < 10**4:
        assert elements(I.set_complement(spark, fa)) == set(range(1, top + 1)) - a
    elif top < 10**7:
        assert I.set_complement(spark, fa).count() == top - positive


@pytest.mark.parametrize("name", SETS)
def test_next_and_contains(spark, name):
    a = SETS[name]
    asked = {0, 1, 62, 63, 64, 65, 65535, 65536, 65537, 8388610, 2**40, 2**62 + 2}
    asked |= {random.randrange(2**62) for _ in range(20)} | set(list(a)[:20])
    probes = frame(spark, asked, "n").union(frame(spark, asked, "n"))
    expected = sorted((n, min((e for e in a if e >= n), default=None)) for n in asked)
    assert rows(I.set_next(frame(spark, a), probes)) == expected
    present = I.set_contains(frame(spark, a), probes)
    assert rows(present) == sorted((n, n in a) for n in asked)


def test_build_drops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(3,), (None,), (3,), (0,)], "c int")
    assert elements(I.set_build(df, "c")) == {0, 3}


def test_point_updates(spark):
    updates = spark.createDataFrame(
        [(1, "set"), (2, "set"), (3, "clear"), (4, "clear"), (5, "flip"), (6, "flip")],
        "element bigint, op string",
    )
    found = I.set_point_updates(frame(spark, {1, 3, 5, 9}), updates)
    assert elements(found) == {1, 2, 6, 9}


@pytest.mark.parametrize("bad", [[(1, "set"), (1, "flip")], [(1, "toggle")]])
def test_point_updates_that_are_not_clear_fail(spark, bad):
    updates = spark.createDataFrame(bad, "element bigint, op string")
    with pytest.raises(Exception, match="more than one update|unknown op"):
        I.set_point_updates(frame(spark, {1}), updates).collect()


def test_many_sets_unite_at_once(spark):
    parts = [frame(spark, SETS[n]) for n in ("zero", "few", "edges")]
    assert elements(I.union_all_sets(parts)) == SETS["few"] | EDGES


def test_two_set_operators_take_one_shuffle(spark):
    a = spark.range(1000).select(F.col("id").alias("element"))
    plan = I.set_intersect(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("bad", [1.2, -1.0, 1e30])
def test_only_non_negative_integers_make_a_set(spark, bad):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert elements(I.set_build(df, "v")) == {1, 2}
    with pytest.raises(Exception, match="non-negative"):
        I.set_build(df.union(spark.createDataFrame([(bad,)], "v double")), "v").collect()


@pytest.mark.parametrize("kind", ["double", "decimal(38,12)", "string"])
def test_fractions_of_any_size_make_no_set(spark, kind):
    df = spark.createDataFrame([("1",), ("20",), ("0",)], "v string")
    assert elements(I.set_build(df.select(F.col("v").cast(kind)), "v")) == {0, 1, 20}
    bad = spark.createDataFrame([("1.00000000001",)], "v string").select(F.col("v").cast(kind))
    with pytest.raises(Exception, match="non-negative"):
        I.set_build(bad, "v").collect()


def test_longs_at_the_end_of_their_range(spark):
    last = 2**63 - 1
    df = spark.createDataFrame([(last,)], "v bigint")
    assert elements(I.set_build(df, "v")) == {last}
    with pytest.raises(Exception, match="non-negative"):
        I.set_build(spark.createDataFrame([(2.0**64,)], "v double"), "v").collect()


def test_sizes_of_every_two_of_many_sets(spark):
    held = {"a": {0, 1, 63, 64, 2**62}, "b": {1, 64, 65, 2**62}, "c": {200}, "d": {63, 65}, "e": set(range(500))}
    rows = [(k, e) for k, v in held.items() for e in v] + [("a", 1), ("a", None), (None, 1)]
    found = I.set_pair_sizes(spark.createDataFrame(rows, "set_id string, element bigint"))
    expected = {
        (x, y): (len(held[x]), len(held[y]), len(held[x] & held[y]), len(held[x] - held[y]), len(held[x] | held[y]), len(held[x] ^ held[y]))
        for x in held for y in held if x < y and held[x] & held[y]
    }
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()} == expected
    assert I.set_pair_sizes(found.sparkSession.createDataFrame([], "set_id string, element bigint")).collect() == []


def test_integer_sets_of_many_columns_keep_the_rules(spark):
    df = spark.createDataFrame([(1, 2.0, "3"), (1, None, "3"), (2, 5.0, None)], "x int, `y z` double, w string")
    found = I.integer_sets(df, "t", ["x", "y z", "w"]).collect()
    assert {tuple(r) for r in found} == {("t.x", 1), ("t.x", 2), ("t.y z", 2), ("t.y z", 5), ("t.w", 3)}
    with pytest.raises(Exception, match="not a non-negative integer"):
        I.integer_sets(df.withColumn("x", F.lit(1.5)), "t", ["x", "w"]).collect()
