from hashlib import sha256

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablekin.functions import ids, values, words

CATEGORIES = {
    "7": "P1",
    "007": "P3",
    "+7": "P2",
    "-7": "N2",
    "-0": "P2",
    "0": "P1",
    " 7": "S2",
    "7 ": "S2",
    "7\n": "S2",
    "1.5\n": "S4",
    "nan\n": "S4",
    "1.5": "F3",
    "1e3": "F3",
    ".5": "F2",
    "5.": "F2",
    ".": "S1",
    "e5": "S2",
    "inf": "F3",
    "-Infinity": "F9",
    "NaN": "F3",
    "-nan": "S4",
    "1e400": "S5",
    "1E-400": "F6",
    "9223372036854775807": "P19",
    "9223372036854775808": "F19",
    "-9223372036854775808": "N20",
    "-9223372036854775809": "F20",
    "abc": "S3",
    "é": "S2",
    "1_000": "S5",
    "0x10": "S4",
    "1d": "S2",
    "1.5f": "S4",
    "٣": "S2",
    "": None,
    None: None,
}


def test_categories(spark):
    df = spark.createDataFrame([(v,) for v in CATEGORIES], "v string")
    found = df.select("v", values.value_category(F.col("v"))).collect()
    assert {r[0]: r[1] for r in found} == CATEGORIES


def test_match_keys(spark):
    digest = {t: sha256(t.encode()).hexdigest() for t in ("abc", "x" * 64, "x" * 65)}
    cases = {
        "007": "7",
        "+7": "7",
        "-0": "0",
        "1.50": "1.50",
        **digest,
        "0" * 70 + "5": "5",
        "0" * 70 + ".5": "0" * 70 + ".5",
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    found = {r[0]: r[1] for r in df.select("v", values.match_key(F.col("v"))).collect()}
    assert found == cases


@pytest.mark.parametrize(
    "spark_type,samples",
    [
        ("bigint", ["0", "-5", "9223372036854775807", None]),
        ("int", ["12", "-1"]),
        ("double", ["0.0", "-0.0", "1.5", "NaN", "Infinity", "1e20", "1e-7"]),
        ("float", ["1.1", "NaN"]),
        ("date", ["2020-01-02"]),
        ("timestamp", ["2020-01-02 03:04:05.123"]),
        ("timestamp_ntz", ["2020-01-02 03:04:05"]),
        ("boolean", ["true", "false"]),
        ("decimal(20,2)", ["1.50", "-2.00"]),
        ("decimal(20,0)", ["15", "99999999999999999999"]),
        ("string", ["7", "x", "1.5", ""]),
    ],
)
def test_typed_forms_equal_the_text_forms(spark, spark_type, samples):
    df = spark.createDataFrame([(v,) for v in samples], "t string").select(
        F.col("t").cast(spark_type).alias("v")
    )
    value, data_type = F.col("v"), df.schema["v"].dataType
    text = value.cast("string")
    wrong = df.select(
        values.typed_category(value, data_type).alias("a"),
        values.value_category(text).alias("b"),
        values.typed_match_key(value, data_type).alias("c"),
        values.match_key(text).alias("d"),
        text.alias("t"),
    ).filter("t <> '' AND (NOT a <=> b OR NOT c <=> d)")
    assert wrong.collect() == []


def test_buckets(spark):
    df = spark.createDataFrame([(0,), (255,), (256,), (4097,), (-1,)], "k bigint")
    found = [r[0] for r in df.select(values.bucket_of(F.col("k"))).collect()]
    assert found == ["0", "FF", "0", "1", "FF"]


def test_ids(spark):
    df = spark.createDataFrame([(1, 2, 10, 20), (2, 1, 10, 20)], "x int, y int, l int, r int")
    x, y = F.col("x"), F.col("y")
    found = df.select(
        *ids.aligned_pair(x, y),
        ids.pair_id(x, y),
        ids.row_pair_key(x, y, F.col("l"), F.col("r")),
    )
    assert [tuple(r) for r in found.collect()] == [
        (2, 1, "2-1", "20:10"),
        (2, 1, "2-1", "10:20"),
    ]


def test_qualified_names(spark):
    df = spark.createDataFrame(
        [("s", "t", "c"), ("", "t", "c"), ("s", "", "c")], "s string, t string, c string"
    )
    name = ids.qualified_name(F.col("s"), F.col("t"), F.col("c"))
    assert [r[0] for r in df.select(name).collect()] == [
        "s.t.c",
        "t.c",
        "s.c",
    ]


def test_words(spark):
    df = spark.createDataFrame([(0,), (15,), (63,), (64,), (8388609,)], "n bigint")
    n = F.col("n")
    mask = words.bit_mask(words.word_bit(n))
    assert rows(df.select(n, words.word_offset(n), words.word_bit(n))) == [
        (k, k >> 6, k & 63) for k in (0, 15, 63, 64, 8388609)
    ]
    bit = words.word_bit(n)
    checks = df.select(
        words.trailing_zeros(mask) == bit,
        words.test_bit(mask, bit),
        words.popcount(words.set_bit(F.lit(0).cast("bigint"), bit)) == 1,
        words.clear_bit(mask, bit) == 0,
        words.flip_bit(mask, bit) == 0,
    )
    assert all(all(r) for r in checks.collect())
    zero = spark.range(1).select(words.trailing_zeros(F.lit(0).cast("bigint")))
    assert zero.first()[0] is None
