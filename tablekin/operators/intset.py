"""Sets of non-negative integers.

A set is a DataFrame with a BIGINT column ``element``. Two-set operators tag the
elements with the set they come from and group once by element, which takes one
shuffle, removes repetitions and combines on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions import words as W

IN_A, IN_B = 1, 2
RADIX_BITS = 16


def _checked(df: DataFrame, column: str) -> Column:
    """A column as BIGINT; a value that is no whole number, or a negative one, is an error."""
    value = F.col(f"`{column}`")
    whole = value.try_cast("bigint")
    fits = whole.isNotNull() & (whole >= 0)
    data_type = df.schema[column].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        # In the type's own digits: a narrower one would round fractions away.
        fits = fits & (value == F.floor(value)) & (whole.cast(data_type) == value)
    elif not isinstance(data_type, T.IntegralType):
        fits = fits & value.cast("string").rlike(r"\A\s*[+-]?[0-9]+([.]0*)?\s*\z")
    message = F.concat(F.lit("not a non-negative integer: "), value.cast("string"))
    element = F.when(F.coalesce(fits, F.lit(False)), whole).otherwise(F.raise_error(message))
    return F.when(value.isNotNull(), element)


def set_build(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null integers of a column.

    A value that is no whole number, or a negative one, is an error.
    """
    known = df.select(_checked(df, column).alias("element"))
    return known.filter("element IS NOT NULL").distinct()


def _membership(a: DataFrame, b: DataFrame) -> DataFrame:
    tagged = a.select("element", F.lit(IN_A).alias("side")).unionByName(
        b.select("element", F.lit(IN_B).alias("side"))
    )
    return tagged.groupBy("element").agg(F.bit_or("side").alias("sides"))


def _elements(a: DataFrame, b: DataFrame, *sides: int) -> DataFrame:
    return _membership(a, b).filter(F.col("sides").isin(*sides)).select("element")


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _elements(a, b, IN_A | IN_B)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _elements(a, b, IN_A)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("element").unionByName(b.select("element")).distinct()


def set_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _elements(a, b, IN_A, IN_B)


def set_cardinality(a: DataFrame) -> DataFrame:
    return a.select("element").distinct().agg(F.count(F.lit(1)).alias("cardinality"))


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes and relations of two sets in one row, from one grouping."""
    sides = F.col("sides")
    both, only_a, only_b = (
        F.count_if(sides == value) for value in (IN_A | IN_B, IN_A, IN_B)
    )
    counted = _membership(a, b).agg(
        both.alias("both"), only_a.alias("only_a"), only_b.alias("only_b")
    )
    return counted.selectExpr(
        "both + only_a AS a_cardinality",
        "both + only_b AS b_cardinality",
        "both AS intersect_cardinality",
        "only_a AS difference_cardinality",
        "both + only_a + only_b AS union_cardinality",
        "only_a + only_b AS symmetric_difference_cardinality",
        "only_a + only_b = 0 AS is_equal",
        "only_b = 0 AS is_superset",
        "only_b = 0 AND only_a > 0 AS is_strict_superset",
    )


def set_intersect_cardinality(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_cardinality(set_intersect(a, b))


def set_difference_cardinality(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_cardinality(set_difference(a, b))


def set_union_cardinality(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_cardinality(set_union(a, b))


def set_symmetric_difference_cardinality(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_cardinality(set_symmetric_difference(a, b))


def integer_sets(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Many sets in one frame ``(set_id, element)``: one per column, named ``name.column``.

    All columns are checked and told apart in one scan and one grouping. The rules are
    those of :func:`set_build`.
    """
    checked = [_checked(df, c).alias(c) for c in columns]
    long = df.select(*checked).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "element")
    set_id = F.concat(F.lit(f"{name}."), "column_name")
    return long.filter("element IS NOT NULL").select(set_id.alias("set_id"), "element").distinct()


def set_pair_sizes(sets: DataFrame) -> DataFrame:
    """Sizes of intersection, differences and union of every two sets that meet.

    ``sets`` holds ``(set_id, element)``, repeated rows allowed; a row lacking either is
    ignored. One row per unordered pair with a common element, the smaller id as ``a``.
    Elements are kept 64 to a row, one bit each, so that the join compares as many at
    once and a dense set sends few rows; only sets that share such a row are paired. The
    other sizes follow from those of the sets alone, without another look at elements.
    """
    element = F.col("element")
    paged = (
        sets.filter("set_id IS NOT NULL AND element IS NOT NULL")
        .groupBy("set_id", W.word_offset(element).alias("page"))
        .agg(F.bit_or(W.bit_mask(W.word_bit(element))).alias("bits"))
    )
    sizes = paged.groupBy("set_id").agg(F.sum(F.bit_count("bits")).alias("size"))
    a, b = paged.alias("a"), paged.alias("b")
    both = F.col("a.bits").bitwiseAND(F.col("b.bits"))
    met = (
        a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.set_id") < F.col("b.set_id")))
        .filter(both != 0)
        .groupBy(F.col("a.set_id").alias("a_id"), F.col("b.set_id").alias("b_id"))
        .agg(F.sum(F.bit_count(both)).alias("both"))
    )
    named = met
    for side in ("a", "b"):
        known = sizes.select(F.col("set_id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size"))
        named = named.join(known, f"{side}_id")
    return named.selectExpr(
        "a_id",
        "b_id",
        "a_size AS a_cardinality",
        "b_size AS b_cardinality",
        "both AS intersect_cardinality",
        "a_size - both AS difference_cardinality",
        "a_size + b_size - both AS union_cardinality",
        "a_size + b_size - 2 * both AS symmetric_difference_cardinality",
    )


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_comparison(a, b).select("is_equal")


def set_is_superset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether ``a`` holds all of ``b``; an empty ``b`` is always held."""
    return set_comparison(a, b).select("is_superset")


def set_is_strict_superset(a: DataFrame, b: DataFrame) -> DataFrame:
    return set_comparison(a, b).select("is_strict_superset")


def set_contains(a: DataFrame, probes: DataFrame) -> DataFrame:
    """For each distinct probe ``n`` whether it is an element."""
    asked = probes.select(F.col("n").alias("element"))
    return (
        _membership(a, asked)
        .filter(F.col("sides").bitwiseAND(F.lit(IN_B)) != 0)
        .select(F.col("element").alias("n"), (F.col("sides") != IN_B).alias("present"))
    )


def set_emptiness(a: DataFrame) -> DataFrame:
    """``is_empty`` and its opposite ``has_any``, in one row."""
    some = a.select("element").limit(1).agg(F.count(F.lit(1)).alias("found"))
    return some.select(
        (F.col("found") == 0).alias("is_empty"), (F.col("found") > 0).alias("has_any")
    )


def set_all(a: DataFrame) -> DataFrame:
    """Whether every integer from 1 to the largest element is there."""
    return (
        a.select("element")
        .distinct()
        .agg(
            (
                F.count_if(F.col("element") >= 1)
                == F.coalesce(F.max("element"), F.lit(0))
            ).alias("has_all")
        )
    )


def set_storage_size(a: DataFrame) -> DataFrame:
    """Bytes of the word form: four, and sixteen for each word in use."""
    used = a.select(W.word_offset(F.col("element")).alias("word_offset")).distinct()
    return used.agg((4 + 16 * F.count(F.lit(1))).alias("storage_bytes"))


def set_complement(spark: SparkSession, a: DataFrame) -> DataFrame:
    """The integers from 1 to the largest element that are not there.

    Whole words are generated and joined rather than single integers. The largest
    element, one number, is fetched first, since it sets the range to generate.
    """
    largest = a.agg(F.max("element")).first()[0]
    last_word = -1 if largest is None else largest >> W.WORD_SHIFT
    all_words = spark.range(last_word + 1).withColumnRenamed("id", "word_offset")
    bits = F.coalesce("bits", F.lit(0).cast("bigint"))
    filled = all_words.join(bitmap_encode(a), "word_offset", "left").select(
        "word_offset", F.bitwise_not(bits).alias("bits")
    )
    return bitmap_decode(filled).filter(
        (F.col("element") >= 1) & (F.col("element") <= F.lit(largest))
    )


def set_next(a: DataFrame, probes: DataFrame) -> DataFrame:
    """For each distinct probe ``n`` the least element not below it, or NULL.

    Elements are cut into blocks of 2^16, blocks into blocks of blocks and so on.
    A block looks for the next element within its own group only and else takes
    over what its parent found. A group has at most 2^16 distinct members of either
    kind whatever the data, so neither a sort nor a join grows with it.
    """
    blocks = [
        a.groupBy(F.col("element").alias("block")).agg(F.min("element").alias("least"))
    ]
    asked = [probes.select(F.col("n").cast("bigint").alias("block")).distinct()]
    parent = F.shiftright("block", RADIX_BITS).alias("block")
    for _ in range(3):
        blocks.append(blocks[-1].groupBy(parent).agg(F.min("least").alias("least")))
        asked.append(asked[-1].select(parent).distinct())
    found = _next_in_group(blocks[3], asked[3], own_block=False)
    for level in (2, 1, 0):
        above = found.select(
            F.col("block").alias("parent"), F.col("least").alias("least_above")
        )
        reached = _next_in_group(blocks[level], asked[level], own_block=level == 0)
        found = (
            reached.withColumn("parent", F.shiftright("block", RADIX_BITS))
            .join(above, "parent", "left")
            .select("block", F.coalesce("least", "least_above").alias("least"))
        )
    return found.select(F.col("block").alias("n"), F.col("least").alias("next_element"))


def _next_in_group(
    blocks: DataFrame, looked_up: DataFrame, own_block: bool
) -> DataFrame:
    asked = looked_up.select("block", F.lit(None).cast("bigint").alias("least"))
    group = Window.partitionBy(F.shiftright("block", RADIX_BITS))
    # Downwards, since a frame that grows costs one step per row and one that
    # shrinks costs a pass.
    after = group.orderBy(F.desc("block")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow if own_block else -1
    )
    both = blocks.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumn("asked", F.lit(True))
    )
    return (
        both.withColumn("least", F.min("least").over(after))
        .filter("asked")
        .select("block", "least")
    )


def set_point_updates(a: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply a batch of ``(element, op)`` with op ``set``, ``clear`` or ``flip``.

    One update per element and batch; more of them, or another op, is an error.
    """
    op = F.col("op")
    checked = updates.select(
        "element",
        F.when(op.isin("set", "clear", "flip"), op)
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), op)))
        .alias("op"),
        F.lit(False).alias("member"),
    )
    members = a.select(
        "element", F.lit(None).cast("string").alias("op"), F.lit(True).alias("member")
    )
    state = (
        members.unionByName(checked)
        .groupBy("element")
        .agg(
            F.bool_or("member").alias("member"),
            F.max("op").alias("op"),
            F.count("op").alias("n_ops"),
        )
    )
    single = F.when(F.col("n_ops") <= 1, F.col("op")).otherwise(
        F.raise_error(F.lit("more than one update for an element"))
    )
    kept = (
        F.when(single == "set", True)
        .when(single == "clear", False)
        .when(single == "flip", ~F.col("member"))
        .otherwise(F.col("member"))
    )
    return state.filter(kept).select("element")


def bitmap_encode(a: DataFrame) -> DataFrame:
    """Word form of a set: ``(word_offset, bits)``."""
    element = F.col("element")
    return a.groupBy(W.word_offset(element).alias("word_offset")).agg(
        F.bit_or(W.bit_mask(W.word_bit(element))).alias("bits")
    )


def bitmap_decode(words: DataFrame) -> DataFrame:
    """The elements a word form stands for."""
    elements = W.word_elements(F.col("word_offset"), F.col("bits"))
    return words.select(F.explode(elements).alias("element"))


def bitmap_cardinality(words: DataFrame) -> DataFrame:
    return words.agg(
        F.coalesce(F.sum(W.popcount(F.col("bits"))), F.lit(0)).alias("cardinality")
    )


def _aligned_words(a: DataFrame, b: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    both = a.select("word_offset", F.col("bits").alias("a"), zero.alias("b"))
    both = both.unionByName(
        b.select("word_offset", zero.alias("a"), F.col("bits").alias("b"))
    )
    return both.groupBy("word_offset").agg(
        F.bit_or("a").alias("a"), F.bit_or("b").alias("b")
    )


def _combined(a: DataFrame, b: DataFrame, rule) -> DataFrame:
    """Word by word combination; words left without a bit are dropped."""
    bits = rule(F.col("a"), F.col("b"))
    words = _aligned_words(a, b).select("word_offset", bits.alias("bits"))
    return words.filter("bits <> 0")


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, lambda x, y: x.bitwiseAND(y))


def bitmap_andnot(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, lambda x, y: x.bitwiseOR(y))


def bitmap_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, lambda x, y: x.bitwiseXOR(y))


def bitmap_pages(a: DataFrame) -> DataFrame:
    """Dense form with Spark's own bitmaps of 32,768 bits: ``(page, bitmap)``.

    Elements count from 1 there, so they are shifted by one on the way in.
    """
    position = F.col("element") + 1
    return a.groupBy(F.bitmap_bucket_number(position).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap")
    )


def bitmap_pages_cardinality(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("cardinality")
    )


def union_all_sets(sets: list[DataFrame]) -> DataFrame:
    """Union of any number of sets in one grouping."""
    return reduce(
        DataFrame.unionByName, [s.select("element") for s in sets]
    ).distinct()
