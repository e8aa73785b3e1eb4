"""Value classes and match keys of single cells.

A cell is compared only with cells of the same *category*: one letter for the
value class followed by the byte length of the text.

``P`` / ``N``  the text is a 64-bit integer, zero or positive / negative
``F``          the text is a 64-bit float
``S``          anything else

Within a category cells are equal when their *match key* is equal. The key of an
integer is its canonical decimal text, so ``07`` and ``+7`` agree. The key of a float
is its text, and that of any other text its SHA-256, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of the integer and float texts that are recognised.
INTEGER_TEXT = r"\A[+-]?[0-9]+\z"
FLOAT_TEXT = r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
SPECIAL_FLOAT_TEXT = r"\A(?i)([+-]?(inf|infinity)|nan)\z"


def integer_value(text: Column) -> Column:
    """The BIGINT a text denotes, NULL when it denotes none.

    The pattern guards the cast, which alone would accept surrounding blanks.
    """
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def float_value(text: Column) -> Column:
    """The DOUBLE a text denotes, NULL when it denotes none or is out of range."""
    number = text.try_cast("double")
    finite = text.rlike(FLOAT_TEXT) & (F.abs(number) < float("inf"))
    return F.when(finite | text.rlike(SPECIAL_FLOAT_TEXT), number)


def sign_class(number: Column) -> Column:
    return F.when(number < 0, "N").otherwise("P")


def text_class(text: Column) -> Column:
    """``F`` or ``S`` for a text already known not to be an integer."""
    return F.when(float_value(text).isNotNull(), "F").otherwise("S")


def value_category(text: Column) -> Column:
    """Class letter and byte length of a cell; NULL for a missing cell."""
    number = integer_value(text)
    letter = F.when(number.isNotNull(), sign_class(number)).otherwise(text_class(text))
    return F.when(text != "", F.concat(letter, F.octet_length(text)))


def text_key(text: Column) -> Column:
    """Key of a text that is no number: its digest."""
    return F.sha2(text, 256)


def match_key(text: Column) -> Column:
    """What must agree, next to the category, for two cells to match."""
    number = integer_value(text).cast("string")
    other = F.when(float_value(text).isNotNull(), text).otherwise(text_key(text))
    return F.when(text != "", F.coalesce(number, other))


def typed_category(value: Column, data_type: T.DataType) -> Column:
    """``value_category(cast(value AS STRING))`` with the class read off the type.

    Integers are always P or N, floats always F (their text carries a point, an
    exponent or a special name), dates and timestamps always S.
    """
    text = value.cast("string")
    if isinstance(data_type, T.IntegralType):
        return F.concat(sign_class(value), F.octet_length(text))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.concat(F.lit("F"), F.octet_length(text))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("S"), F.octet_length(text))
    return value_category(text)


def typed_match_key(value: Column, data_type: T.DataType) -> Column:
    """``match_key(cast(value AS STRING))`` with the class read off the type."""
    text = value.cast("string")
    if isinstance(data_type, (T.IntegralType, T.FloatType, T.DoubleType)):
        return text
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return text_key(text)
    return match_key(text)


def bucket_of(key: Column) -> Column:
    """Low eight bits of a BIGINT key as upper-case hexadecimal."""
    return F.hex(key.bitwiseAND(F.lit(255)))


def text_bucket_of(key: Column) -> Column:
    """Bucket of a text key, taken from its 64-bit hash."""
    return bucket_of(F.xxhash64(key))
