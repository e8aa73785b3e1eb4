"""Typed and hashed forms of a table of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablekin.operators.cells import quoted, scalar_columns

#: Digits that are all zero, with or without an exponent.
ZERO_TEXT = r"\A\s*[+-]?(0+[.]?0*|[.]0+)([eE][+-]?[0-9]{1,9})?\s*\z"
# Fixed names of the declared types that are recognised.
TEXT_TYPES = ("CHAR", "VARCHAR", "VARCHAR2")
NUMBER_TYPES = ("NUMBER", "NUMERIC")
DATE_TYPES = ("DATE", "DATETIME")


def _spec(column: Row | dict) -> tuple[dict, str]:
    spec = column.asDict() if isinstance(column, Row) else dict(column)
    return spec, (spec.get("data_type") or "").upper()


def declared_cast(value: Column, column: Row | dict) -> Column:
    """Cast a text to a declared type; what is no such number becomes NULL.

    Texts and dates stay text, whole even where they are longer than declared.
    """
    spec, data_type = _spec(column)
    if data_type in TEXT_TYPES or data_type in DATE_TYPES:
        return value
    if data_type in NUMBER_TYPES:
        precision, scale = spec.get("precision") or 38, spec.get("scale") or 0
        number = f"decimal({precision},{scale})"
        # Spark's cast takes a zero with a large exponent for too large.
        return F.coalesce(value.try_cast(number), F.when(value.rlike(ZERO_TEXT), F.lit(0).cast(number)))
    raise ValueError(f"no rule for declared type {data_type!r}")


#: Sign, digits before and behind the point, and exponent of a number.
NUMBER_TEXT = r"\A\s*[+-]?([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]{1,9}))?\s*\z"
#: Digits that the widest decimal holds.
MOST_DIGITS = 38


def _plainly_fits(value: Column, precision: int, scale: int) -> Column:
    """Whether a text is digits with at most one point, no more of them on either side
    than declared. Such a number breaks no rule, and most are told so without a pattern."""
    rest = F.translate(value, "0123456789", "")
    whole = F.length(F.substring_index(value, ".", 1))
    part = F.length(value) - whole - F.length(rest)
    few = (whole <= precision - scale) & (part <= scale) & (whole + part > 0)
    return rest.isin("", ".") & few


def _number_rule(value: Column, precision: int, scale: int) -> Column:
    """What keeps a text from being a decimal of this precision and scale, exactly.

    Digits are counted in the text, so nothing is rounded on the way: ``digits`` if more
    count than any decimal holds, ``scale`` if some behind the point would be lost,
    ``precision`` if there are too many before it.
    """
    whole, part, power = (F.regexp_extract(value, NUMBER_TEXT, i) for i in (1, 2, 3))
    digits = F.concat(whole, part)
    ended = F.rtrim(digits, F.lit("0"))
    # The number is the digits up to the last that is not zero, times ten to the shift.
    shift = (
        F.coalesce(power.try_cast("int"), F.lit(0))
        - F.length(part)
        + (F.length(digits) - F.length(ended))
    )
    counting = F.length(F.ltrim(ended, F.lit("0")))
    return (
        F.when(_plainly_fits(value, precision, scale), F.lit(None).cast("string"))
        .when(~value.rlike(NUMBER_TEXT) | (digits == ""), "number")
        .when(counting == 0, F.lit(None).cast("string"))
        .when(counting > MOST_DIGITS, "digits")
        .when(-shift > scale, "scale")
        .when(counting + shift > precision - scale, "precision")
    )


def broken_rule(value: Column, column: Row | dict) -> Column:
    """The rule of its declared type that a text breaks, NULL if none.

    Texts may be too long (``length``); numbers may be none (``number``) or not fit
    without loss (``scale``, ``precision``, ``digits``).
    """
    spec, data_type = _spec(column)
    if data_type in NUMBER_TYPES:
        rule = _number_rule(value, spec.get("precision") or MOST_DIGITS, spec.get("scale") or 0)
        return F.when(value.isNotNull(), rule)
    if data_type in TEXT_TYPES and spec.get("char_length") is not None:
        return F.when(F.char_length(value) > spec["char_length"], "length")
    return F.lit(None).cast("string")


def _texts(columns: Sequence[Row | dict]) -> list[tuple[Row | dict, Column]]:
    return [(c, F.nullif(quoted(c["name"]), F.lit(""))) for c in columns]


def typed_load(
    df: DataFrame, row_id: str, columns: Sequence[Row | dict], strict: bool = True
) -> DataFrame:
    """Row number and one column per declared type, named as declared.

    A value that does not fit its type is an error, and so is a number that would lose
    digits. Without ``strict`` an overlong text is kept as it is, a number with too many
    digits behind the point is rounded, and any other that does not fit is NULL;
    ``load_rejects`` lists all of these.
    """
    made = []
    for column, text in _texts(columns):
        value, rule = declared_cast(text, column), broken_rule(text, column)
        if strict:
            message = F.concat(
                F.lit(f"{column['name']} breaks the rule of its "), rule, F.lit(": "), text
            )
            value = F.when(rule.isNull(), value).otherwise(F.raise_error(message))
        made.append(value.alias(column["name"]))
    return df.select(quoted(row_id).alias("row_id"), *made)


def load_rejects(
    df: DataFrame, row_id: str, columns: Sequence[Row | dict]
) -> DataFrame:
    """Values that do not fit: ``(row_id, column_name, value, rule)``."""
    judged = [
        F.struct(
            F.lit(c["name"]).alias("column_name"),
            text.alias("value"),
            broken_rule(text, c).alias("rule"),
        )
        for c, text in _texts(columns)
    ]
    long = df.select(quoted(row_id).alias("row_id"), F.inline(F.array(*judged)))
    return long.filter("rule IS NOT NULL")


def hashed_projection(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Row number and one BIGINT hash per column; a missing value has none."""
    names = list(columns or scalar_columns(df))
    hashes = []
    for c in names:
        text = F.nullif(quoted(c).cast("string"), F.lit(""))
        hashes.append(F.when(text.isNotNull(), F.xxhash64(text)).alias(f"h_{c}"))
    return df.select(quoted(row_id).alias("row_id"), *hashes)
