"""Shards of rows by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: an offset
and a step, both from a hash of its name, which visit each slot once. Shards take turns,
each claiming the first slot of its order that is free, until the table is full. So
shards hold equal numbers of slots up to one, and when a shard goes, nearly all slots of
the others stay where they were. A row's key is hashed to a slot: placement is one look
into a table whose size is a parameter, whatever the data.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime, and shards of the registered query.
SLOTS, SHARDS = 5_003, 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=16)
def fill(shards: tuple[str, ...], slots: int) -> tuple[int, ...]:
    """The shard number of each slot. Names must differ, and slots outnumber them."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("needs different shard names and a prime number of slots, no fewer than shards")
    at = [_number(f"offset:{name}") % slots for name in shards]
    step = [_number(f"step:{name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return tuple(table)


#: Bits of the numbers of :func:`key_number`, four a hexadecimal digit.
KEY_BITS = 60


def key_number(key: Column) -> Column:
    """60 bits of the MD5 of a key's text; a missing key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def lookup(table: tuple[int, ...]) -> Column:
    """The table as one constant array."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")


def place(
    rows: DataFrame, key: str, shards: tuple[str, ...], slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard"
) -> DataFrame:
    """``rows`` with the slot and the shard number of each row; all rows stay.

    No shuffle: the table goes to the tasks as a constant of ``slots`` numbers. Rows of
    one key go to one shard; rows without a key go where the empty text goes. Columns
    that have the names of the two new ones are replaced, all others stay.
    """
    new = {slot_name.lower(), shard_name.lower()}
    slot = F.pmod(key_number(F.col(f"`{key}`")), F.lit(slots))
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in new]
    shard = F.get(lookup(fill(tuple(shards), slots)), slot.cast("int"))
    return rows.select(*kept, slot.alias(slot_name), shard.alias(shard_name))


def names(shards: int) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(shards))
