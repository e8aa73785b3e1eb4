"""Which columns of two tables share values, and how many.

All column pairs are found by one equi-join of the distinct values of both
tables. A key occurs once per column there, so a group is never larger than
left columns times right columns, however often the value is repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.functions.ids import coverage, pair_id, qualified_name


def _side(sets: DataFrame, prefix: str) -> DataFrame:
    return sets.select(
        F.col("column_name").alias(f"{prefix}_col"),
        F.col("category").alias(f"{prefix}_category"),
        F.col("match_key").alias(f"{prefix}_key"),
        F.col("n").alias(f"{prefix}_n"),
    )


def shared_values(
    l_sets: DataFrame, r_sets: DataFrame, bucketed: bool = False
) -> DataFrame:
    """Values two columns share: ``(l_col, r_col, category, match_key, l_n, r_n)``.

    The null-safe equality keeps the optimizer from pushing not-null tests, and
    with them the category expression, below the grouping. Stored buckets need
    the plain equality to be recognised; nothing is computed below it there.
    """
    left, right = _side(l_sets, "l"), _side(r_sets, "r")
    if bucketed:
        same = (left.l_category == right.r_category) & (left.l_key == right.r_key)
    else:
        same = left.l_category.eqNullSafe(right.r_category) & left.l_key.eqNullSafe(
            right.r_key
        )
    return left.join(right, same).select(
        "l_col",
        "r_col",
        F.col("l_category").alias("category"),
        F.col("l_key").alias("match_key"),
        "l_n",
        "r_n",
    )


def comparable(sets: DataFrame, other_sets: DataFrame) -> DataFrame:
    """Values of a class and length the other side has; others cannot match.

    The other side is summed up as a range of lengths for each of the four class
    letters, so four rows are broadcast at most. Worth the extra look at it when
    value sets are stored: only the category column is read then, and long texts
    drop out before the join.
    """
    letter = F.substring("category", 1, 1).alias("letter")
    size = F.substring("category", 2, 20).cast("int")
    ranges = other_sets.groupBy(letter).agg(
        F.min(size).alias("shortest"), F.max(size).alias("longest")
    )
    inside = size.between(F.col("shortest"), F.col("longest"))
    return (
        sets.withColumn("letter", letter)
        .join(F.broadcast(ranges), "letter")
        .filter(inside)
        .select(sets.columns)
    )


def row_pair_total():
    """Number of row pairs behind shared values, without listing one of them."""
    left, right = F.col("l_n").cast("decimal(19,0)"), F.col("r_n").cast("decimal(18,0)")
    return F.sum(left * right).cast("decimal(38,0)")


def column_totals(sets: DataFrame) -> DataFrame:
    """Distinct keys and non-empty cells per column.

    Keys are counted by their cells, which are never none: so the grouping below always
    has the counts, whatever columns are asked for, and equals that of other uses.
    """
    return sets.groupBy("column_name").agg(
        F.count_if(F.col("n") > 0).alias("distinct_keys"), F.sum("n").alias("n_cells")
    )


def pair_overlap(
    l_sets: DataFrame, r_sets: DataFrame, stored: bool = False
) -> DataFrame:
    """Overlap of every column pair that shares at least one value.

    ``shared`` counts the common keys over all categories; the ratios divide it
    by the distinct keys of the left and of the right column. ``row_pairs`` is
    the number of (left row, right row) pairs that agree on the two columns.
    ``stored`` tells that the sets are read from files, which are narrowed to what can
    match first. Otherwise the join and the totals share the groupings of the sets.
    """
    left, right = l_sets, r_sets
    if stored:
        left, right = comparable(l_sets, r_sets), comparable(r_sets, l_sets)
    # Counted by cells, like the totals: see ``column_totals``.
    common = F.count_if((F.col("l_n") > 0) & (F.col("r_n") > 0))
    found = (
        shared_values(left, right)
        .groupBy("l_col", "r_col")
        .agg(common.alias("shared"), row_pair_total().alias("row_pairs"))
    )
    return with_coverage(found, l_sets, r_sets)


def shared_per_category(l_sets: DataFrame, r_sets: DataFrame) -> DataFrame:
    """Shared values and their row pairs per column pair and category."""
    return (
        shared_values(l_sets, r_sets)
        .groupBy("l_col", "r_col", "category")
        .agg(
            F.count(F.lit(1)).alias("shared"), row_pair_total().alias("row_pairs")
        )
    )


def with_coverage(
    pairs: DataFrame, l_sets: DataFrame, r_sets: DataFrame
) -> DataFrame:
    """Add size and covered share of both sides to pairs that carry ``shared``."""
    for prefix, sets in (("l", l_sets), ("r", r_sets)):
        totals = column_totals(sets).filter("distinct_keys > 0").select(
            F.col("column_name").alias(f"{prefix}_col"),
            F.col("distinct_keys").alias(f"{prefix}_distinct"),
            F.col("n_cells").alias(f"{prefix}_cells"),
        )
        pairs = pairs.join(totals, f"{prefix}_col")
    return pairs.withColumns(
        {
            "l_ratio": coverage(F.col("shared"), F.col("l_distinct")),
            "r_ratio": coverage(F.col("shared"), F.col("r_distinct")),
        }
    )


def row_pair_count(l_sets: DataFrame, r_sets: DataFrame) -> DataFrame:
    """Row pairs that agree, per column pair, counted from multiplicities."""
    return (
        shared_values(l_sets, r_sets)
        .groupBy("l_col", "r_col")
        .agg(row_pair_total().alias("row_pairs"))
    )


def common_categories(l_sets: DataFrame, r_sets: DataFrame) -> DataFrame:
    """Categories both columns of a pair have, with the keys each side has there."""
    left = l_sets.groupBy(F.col("column_name").alias("l_col"), "category").agg(
        F.count(F.lit(1)).alias("l_keys")
    )
    right = r_sets.groupBy(F.col("column_name").alias("r_col"), "category").agg(
        F.count(F.lit(1)).alias("r_keys")
    )
    return left.join(right, "category").select(
        "l_col", "r_col", "category", "l_keys", "r_keys"
    )


def candidate_pairs(
    spark: SparkSession, l_columns: Sequence[str], r_columns: Sequence[str]
) -> DataFrame:
    """Every left column with every right column, from the two column lists."""
    left = spark.createDataFrame([(c,) for c in l_columns], "l_col string")
    right = spark.createDataFrame([(c,) for c in r_columns], "r_col string")
    return left.crossJoin(right)


def scored_candidates(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs with the number of values they share, 0 where none."""
    counted = pairs.select("l_col", "r_col", "shared")
    return candidates.join(counted, ["l_col", "r_col"], "left").select(
        "l_col", "r_col", F.coalesce("shared", F.lit(0)).alias("shared")
    )


def truth_flag(
    spark: SparkSession, pairs: DataFrame, truth: Iterable[tuple[str, str]]
) -> DataFrame:
    """Mark the pairs known to be true matches."""
    known = spark.createDataFrame(
        sorted(set(truth)), "l_col string, r_col string"
    ).withColumn("known", F.lit(True))
    return pairs.join(known, ["l_col", "r_col"], "left").select(
        *pairs.columns, F.coalesce("known", F.lit(False)).alias("true_positive")
    )


def catalog_sets(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Value sets of many tables in one frame, which tells the tables apart."""
    named = [s.withColumn("table_name", F.lit(t)) for t, s in sets.items()]
    return reduce(DataFrame.unionByName, named)


def catalog_overlap(sets: DataFrame) -> DataFrame:
    """Overlap of every two columns of different tables of a catalog.

    ``sets`` are value sets with a ``table_name``. Every key is grouped once, whatever
    the number of tables, with the columns that hold it; there are few different lists
    of columns, so those are counted and only then taken apart into pairs. Lists are as
    long as the catalog has columns at most, and a list is never made twice.

    ``(l_table, l_col, r_table, r_col, shared, l_distinct, r_distinct, l_ratio,
    r_ratio)``, the alphabetically first table on the left, pairs without a common key
    left out.
    """
    column = F.struct("table_name", "column_name")
    holders = sets.groupBy("category", "match_key").agg(F.sort_array(F.collect_set(column)).alias("holders"))
    lists = holders.filter(F.size("holders") > 1).groupBy("holders").agg(F.count(F.lit(1)).alias("keys"))

    def later(x):
        return F.transform(
            F.filter("holders", lambda y: y["table_name"] > x["table_name"]),
            lambda y: F.struct(
                x["table_name"].alias("l_table"), x["column_name"].alias("l_col"),
                y["table_name"].alias("r_table"), y["column_name"].alias("r_col"),
            ),
        )

    apart = lists.select("keys", F.inline(F.flatten(F.transform("holders", later))))
    pairs = apart.groupBy("l_table", "l_col", "r_table", "r_col").agg(F.sum("keys").alias("shared"))
    totals = sets.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    for side in ("l", "r"):
        named = totals.toDF(f"{side}_table", f"{side}_col", f"{side}_distinct")
        pairs = pairs.join(named, [f"{side}_table", f"{side}_col"])
    return pairs.select(
        "l_table", "l_col", "r_table", "r_col", "shared", "l_distinct", "r_distinct",
        coverage(F.col("shared"), F.col("l_distinct")).alias("l_ratio"),
        coverage(F.col("shared"), F.col("r_distinct")).alias("r_ratio"),
    )


def match_report(
    overlap: DataFrame,
    l_table: str,
    r_table: str,
    l_schema: str = "",
    r_schema: str = "",
) -> DataFrame:
    """Overlap with full column names and percentages, one row per pair."""
    return overlap.select(
        F.col("l_distinct").alias("l_card"),
        qualified_name(F.lit(l_schema), F.lit(l_table), F.col("l_col")).alias("l_name"),
        (100 * F.col("l_ratio")).alias("l_percent"),
        "shared",
        (100 * F.col("r_ratio")).alias("r_percent"),
        qualified_name(F.lit(r_schema), F.lit(r_table), F.col("r_col")).alias("r_name"),
        F.col("r_distinct").alias("r_card"),
    )


def with_pair_id(pairs: DataFrame) -> DataFrame:
    """Label pairs by their two columns, whatever the order of the sides."""
    return pairs.withColumn("pair_id", pair_id(F.col("l_col"), F.col("r_col")))
