"""Labels and canonical orders of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aligned_pair(x: Column, y: Column) -> tuple[Column, Column]:
    """The two ids of a pair, the larger first."""
    return F.greatest(x, y), F.least(x, y)


def pair_id(x: Column, y: Column) -> Column:
    """A label of two ids that does not depend on their order."""
    high, low = aligned_pair(x, y)
    return F.concat_ws("-", high, low)


def row_pair_key(l_id: Column, r_id: Column, l_row: Column, r_row: Column) -> Column:
    """Label of a row pair, the row of the larger column id first."""
    return F.when(l_id > r_id, F.concat_ws(":", l_row, r_row)).otherwise(
        F.concat_ws(":", r_row, l_row)
    )


def qualified_name(schema: Column | None, table: Column, column: Column) -> Column:
    """``schema.table.column``; a part that is absent or empty is left out."""
    table = F.nullif(table, F.lit(""))
    if schema is None:
        return F.concat_ws(".", table, column)
    return F.concat_ws(".", F.nullif(schema, F.lit("")), table, column)


def coverage(part: Column, whole: Column) -> Column:
    """Share of ``whole`` that ``part`` covers, as a fraction."""
    return part.cast("double") / whole.cast("double")
