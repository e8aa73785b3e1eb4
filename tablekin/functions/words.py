"""Sixty-four-bit words: the position of an element and the bits within."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SHIFT = 6
WORD_BITS = 1 << WORD_SHIFT


def word_offset(element: Column) -> Column:
    """Number of the word that holds an element."""
    return F.shiftright(element, WORD_SHIFT)


def word_bit(element: Column) -> Column:
    """Position of an element within its word."""
    return element.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")


def bit_mask(bit: Column) -> Column:
    """Word with the one given bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def set_bit(word: Column, bit: Column) -> Column:
    return word.bitwiseOR(bit_mask(bit))


def clear_bit(word: Column, bit: Column) -> Column:
    return word.bitwiseAND(F.bitwise_not(bit_mask(bit)))


def flip_bit(word: Column, bit: Column) -> Column:
    return word.bitwiseXOR(bit_mask(bit))


def test_bit(word: Column, bit: Column) -> Column:
    return F.getbit(word, bit) == 1


def popcount(word: Column) -> Column:
    return F.bit_count(word)


def trailing_zeros(word: Column) -> Column:
    """Number of zero bits below the lowest set bit; NULL for a zero word."""
    digits = F.bin(word)
    return F.when(word != 0, F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))


def word_elements(offset: Column, word: Column) -> Column:
    """Array of the elements a word holds."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda bit: test_bit(word, bit)
    )
    base = F.shiftleft(offset, WORD_SHIFT)
    return F.transform(bits, lambda bit: base + bit)
