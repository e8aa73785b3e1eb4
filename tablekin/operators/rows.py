"""From shared values to the rows behind them.

Rows are found by joins on values, and a value may be held by a large part of a
table. Every value of more than ``PART_ROWS`` cells is therefore split over several
tasks. The list of such values is broadcast while it is short and joined by a shuffle
when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.operators.cells import value_index, value_sets
from tablekin.operators.overlap import shared_values
from tablekin.session import settle

PART_ROWS = 5_000_000
BLOCK_PAIRS = 50_000_000
FEW = 20_000
KEY = ["column_name", "category", "match_key"]


def heavy_values(sets: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Frequent values, with the number of ``parts`` to split the cells of each."""
    n = F.col("n")
    return sets.filter(n > part_rows).select(
        *KEY, F.ceil(n / part_rows).cast("int").alias("parts")
    )


def short(listed: DataFrame) -> DataFrame:
    """A list to join with, marked for broadcast if a look at it finds it short."""
    return F.broadcast(listed) if listed.limit(FEW + 1).count() <= FEW else listed


def _numbered(parts: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)


def hits(index: DataFrame, keys: DataFrame, heavy: DataFrame) -> DataFrame:
    """Cells whose value is among ``keys``, with the further columns of ``keys``.

    The cells of a heavy value are dealt out by a hash of their row, its key
    being repeated once per piece.
    """
    spread = short(heavy)
    piece = F.pmod(F.xxhash64("row_id"), F.coalesce("parts", F.lit(1)).cast("bigint"))
    dealt = index.join(spread, KEY, "left").withColumn("piece", piece).drop("parts")
    pieces = _numbered(F.coalesce("parts", F.lit(1)))
    repeated = (
        keys.join(spread, KEY, "left")
        .withColumn("piece", F.explode(pieces))
        .drop("parts")
    )
    return dealt.join(repeated, [*KEY, "piece"]).drop("piece")


def shared_on_side(sets: DataFrame, other_sets: DataFrame) -> DataFrame:
    """The values of one side that the other side has in some column."""
    other = other_sets.select("category", "match_key")
    return sets.join(other, ["category", "match_key"], "left_semi").select(*KEY)


def _pairs_on_side(shared: DataFrame, side: str) -> DataFrame:
    return shared.select(
        F.col(f"{side}_col").alias("column_name"),
        "category",
        "match_key",
        F.col("r_col" if side == "l" else "l_col").alias("other_col"),
    )


def side_rows(
    index: DataFrame, shared: DataFrame, heavy: DataFrame, side: str
) -> DataFrame:
    """Rows of one side that take part in a column pair: ``(l_col, r_col, row_id)``.

    A cell has one value and a shared value occurs once per pair, so the rows
    are distinct as they come.
    """
    found = hits(index, _pairs_on_side(shared, side), heavy)
    own, other = ("l_col", "r_col") if side == "l" else ("r_col", "l_col")
    return found.select(
        F.col("column_name").alias(own), F.col("other_col").alias(other), "row_id"
    ).select("l_col", "r_col", "row_id")


class Side:
    """What the row operators need of one table: its value index and value sets.

    The sets are looked at several times and should be read from files. ``source`` is the
    table itself and the column that tells its rows apart, or None if each row stands alone;
    what can be told row by row is then not looked for in the index.
    """

    def __init__(
        self, index: DataFrame, sets: DataFrame, part_rows: int = PART_ROWS, source: tuple[DataFrame, str | None] | None = None
    ):
        self.index, self.sets, self.part_rows, self.source = index, sets, part_rows, source

    @classmethod
    def of(cls, df: DataFrame, row_id: str, columns=None, unique: bool = False, **options) -> Side:
        """A table whose column ``row_id`` tells its rows apart.

        Rows with the same one count as one row, unless it is known to be ``unique``.
        """
        sets = settle(value_sets(df, columns), "sets")
        source = (df, None if unique else row_id)
        return cls(value_index(df, row_id, columns), sets, source=source, **options)

    @property
    def heavy(self) -> DataFrame:
        return heavy_values(self.sets, self.part_rows)


def matched_rows(left: Side, right: Side) -> DataFrame:
    """Rows that take part in a pair: ``(l_col, r_col, side, row_id)``."""
    shared = shared_values(left.sets, right.sets)
    tagged = [
        side_rows(table.index, shared, table.heavy, side).select(
            "l_col", "r_col", F.lit(name).alias("side"), "row_id"
        )
        for table, side, name in ((left, "l", "left"), (right, "r", "right"))
    ]
    return tagged[0].unionByName(tagged[1])


def matched_row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows taking part per pair and side, counted from value multiplicities.

    The two arguments are value sets; no row needs to be visited.
    """
    return (
        shared_values(left, right)
        .groupBy("l_col", "r_col")
        .agg(F.sum("l_n").alias("l_rows"), F.sum("r_n").alias("r_rows"))
    )


def fetch_matched_rows(
    df: DataFrame, row_id: str, table: Side, other_sets: DataFrame
) -> DataFrame:
    """Full source rows that share a value with the other table somewhere."""
    keys = shared_on_side(table.sets, other_sets)
    found = hits(table.index, keys, table.heavy).select(F.col("row_id").alias(row_id))
    return df.join(found, row_id, "left_semi")


def fetch_pair_rows(
    df: DataFrame,
    row_id: str,
    table: Side,
    other_sets: DataFrame,
    column: str,
    other_column: str,
) -> DataFrame:
    """Full source rows behind one column pair."""
    own = table.sets.filter(F.col("column_name") == column)
    other = other_sets.filter(F.col("column_name") == other_column)
    keys = shared_on_side(own, other)
    index = table.index.filter(F.col("column_name") == column)
    found = hits(index, keys, table.heavy).select(F.col("row_id").alias(row_id))
    return df.join(found, row_id, "left_semi")


RIGHT_KEY = ["r_col", "category", "match_key"]


def row_pair_blocks(
    shared: DataFrame, part_rows: int = PART_ROWS, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """How to cut frequent values before listing row pairs.

    All left columns that share a value with a right column meet it there, so their
    cells are added up. A value is cut when it makes more than ``block_pairs`` row
    pairs, or has more than ``part_rows`` cells on a side; ``l_parts * r_parts`` blocks
    of row pairs result.
    """
    met = shared.groupBy(*RIGHT_KEY).agg(
        F.sum("l_n").alias("l_n"), F.max("r_n").alias("r_n")
    )
    weight = F.col("l_n").cast("double") * F.col("r_n").cast("double")
    cuts = F.ceil(weight / block_pairs)
    l_parts = F.greatest(
        F.least(F.col("l_n"), F.ceil(F.sqrt(cuts))), F.ceil(F.col("l_n") / part_rows)
    )
    r_parts = F.greatest(
        F.least(F.col("r_n"), F.ceil(cuts / l_parts)), F.ceil(F.col("r_n") / part_rows)
    )
    return met.select(
        *RIGHT_KEY,
        l_parts.cast("int").alias("l_parts"),
        r_parts.cast("int").alias("r_parts"),
    ).filter((F.col("l_parts") > 1) | (F.col("r_parts") > 1))


def row_pairs(
    left: Side,
    right: Side,
    pairs: DataFrame | None = None,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Row pairs that agree on a column pair: ``(l_col, r_col, l_row, r_row)``.

    The result is as large as ``row_pair_count`` says, which for columns of few
    values is the product of the two tables. ``pairs`` (``l_col, r_col``) narrows
    it to chosen column pairs: each left cell is given the right columns it is wanted
    for before the join, so the join makes the rows of the result and no others.
    """
    shared = shared_values(left.sets, right.sets)
    if pairs is not None:
        wanted = pairs.select("l_col", "r_col")
        shared = shared.join(wanted, ["l_col", "r_col"], "left_semi")
    shared = settle(shared, "shared")
    part_rows = min(left.part_rows, right.part_rows)
    blocks = short(row_pair_blocks(shared, part_rows, block_pairs))
    keys = shared.select(F.col("l_col").alias("column_name"), *KEY[1:], "r_col")

    def cut(cells: DataFrame, row: str, own: str, other: str) -> DataFrame:
        own_parts = F.coalesce(own, F.lit(1)).cast("bigint")
        others = _numbered(F.coalesce(other, F.lit(1)))
        return cells.join(blocks, RIGHT_KEY, "left").select(
            *[c for c in cells.columns if c not in (own, other)],
            F.pmod(F.xxhash64(row), own_parts).alias(own),
            F.explode(others).alias(other),
        )

    l_cells = hits(left.index, keys, left.heavy).select(
        F.col("column_name").alias("l_col"), F.col("row_id").alias("l_row"), *RIGHT_KEY
    )
    r_cells = right.index.select(
        F.col("column_name").alias("r_col"), F.col("row_id").alias("r_row"), *KEY[1:]
    )
    joined = cut(l_cells, "l_row", "l_parts", "r_parts").join(
        cut(r_cells, "r_row", "r_parts", "l_parts"), [*RIGHT_KEY, "l_parts", "r_parts"]
    )
    return joined.select("l_col", "r_col", "l_row", "r_row")
