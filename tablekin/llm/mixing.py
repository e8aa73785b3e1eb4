"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 and
1, normalised: 1 keeps the natural mix, 0 makes all sources equal. The exponent is
bisected on a grid to the smallest one that repeats no source more often than a limit,
or to the largest one whose mix reaches a target entropy.

Weights become numbers of copies: a source that is owed several passes is taken whole
that often, and for the rest of its budget along a permutation. The permutation is one
of blocks: documents fall into blocks of bounded size by the hash of their doc_id,
blocks stand in hashed order, and so do documents inside a block. Where a source's
budget ends is found in three steps: among ranges of that order, 4,096 at most, then
among the blocks of one range, then among the documents of one block. Only those are
ever sorted together, so of a source with a third of all rows a task sorts one block in
4,096.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekin.llm.common import is_small, n_words
from tablekin.llm.placement import KEY_BITS, key_number
from tablekin.session import settle

#: Steps of the exponent's grid, documents of a block, and sources that are broadcast.
GRID, BLOCK, FEW = 1 << 20, 1024, 50_000

_FAN = 32

#: Log2 of the ranges into which the order of a source's blocks is cut.
RANGE_BITS = 12


@dataclass(frozen=True)
class Target:
    """What to mix to.

    ``budget`` is what to give out, as a share of all tokens there are; without one it
    is the least that takes every source whole at least once. ``repeats`` limits how often a source's
    tokens are used on average; ``entropy`` is a share of the largest entropy there
    can be. Exactly one of the two is given. If no exponent meets the limit, the
    natural mix is used, and if none meets the entropy, equal weights.
    """

    repeats: float | None = None
    entropy: float | None = None
    budget: float | None = None

    def __post_init__(self):
        if (self.repeats is None) == (self.entropy is None):
            raise ValueError("give either a repetition limit or an entropy")


def _power(share: Column, step: Column) -> Column:
    """Share to the power of an exponent less one: copies, up to a common factor."""
    return F.pow(share, step / GRID - 1)


def _fits(shares: DataFrame, target: Target, steps: list[int]) -> list[bool]:
    """Whether each exponent meets the target, by one aggregate over the sources."""
    tried = shares.select("share", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    f = _power(F.col("share"), F.col("step"))
    weight = F.col("share") * f
    rows = tried.groupBy("step").agg(
        F.min(f).alias("low"), F.max(f).alias("high"), F.sum(weight).alias("z"),
        F.sum(weight * F.log(weight)).alias("wlog"), F.count("*").alias("n"),
    ).collect()
    out = {}
    for r in rows:
        if target.repeats is not None:
            unit = r["low"] if target.budget is None else r["z"] / target.budget
            out[r["step"]] = r["high"] / unit <= target.repeats
        else:
            out[r["step"]] = math.log(r["z"]) - r["wlog"] / r["z"] >= target.entropy * math.log(r["n"]) - 1e-12
    return [out.get(k, True) for k in steps]


def exponent(shares: DataFrame, target: Target) -> int:
    """Grid step of the exponent; each round of the search cuts the range by ``_FAN``."""
    low, high = 0, GRID
    rising = target.repeats is not None
    # The answer lies in [low, high]; with a limit the fitting steps are the upper ones.
    while low < high:
        cuts = sorted({low + (high - low) * i // _FAN for i in range(_FAN + 1)})
        fits = _fits(shares, target, cuts)
        if rising:
            good = next((i for i, ok in enumerate(fits) if ok), None)
            if good is None:
                return high
            low, high = (cuts[good - 1] + 1, cuts[good]) if good else (low, low)
        else:
            good = next((i for i in range(len(fits) - 1, -1, -1) if fits[i]), None)
            if good is None:
                return low
            low, high = (cuts[good], cuts[good + 1] - 1) if good + 1 < len(cuts) else (high, high)
    return low


def _key(doc_id: Column, seed: int) -> Column:
    return key_number(F.concat_ws(":", F.lit(f"mix-{seed}"), doc_id.cast("string")))


def _order(block: Column, seed: int) -> Column:
    return key_number(F.concat_ws(":", F.lit(f"block-{seed}"), block.cast("string")))


def plan(docs: DataFrame, target: Target, seed: int = 7) -> DataFrame:
    """One row per source: passes over all of it, and where the last, partial pass ends.

    Columns ``source, tokens, wanted, passes, blocks, end_order, end_block, end_key``.
    Sources without words are taken once.
    """
    slim = settle(
        docs.select("source", _key(F.col("doc_id"), seed).alias("key"), n_words(F.col("text")).alias("words")),
        "mix-rows",
    )
    sources = settle(
        slim.groupBy("source").agg(F.sum("words").alias("tokens"), F.count("*").alias("rows")), "mix-sources"
    )
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    step = exponent(shares, target) if total else GRID
    f = _power(F.col("share"), F.lit(step))
    unit = F.min(f) if target.budget is None else F.sum(F.col("share") * f) * F.lit(1 / target.budget)
    unit_value = shares.agg(unit).first()[0] if total else 1.0
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("long")
    wanted = F.when(F.col("tokens") == 0, F.lit(0)).otherwise(F.floor(F.col("tokens") * f / F.lit(unit_value)))
    planned = (
        sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
        .withColumn("wanted", wanted.cast("long"))
        .withColumn("passes", F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.floor(F.col("wanted") / F.col("tokens"))).cast("long"))
        .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", blocks)
        .select("source", "tokens", "wanted", "passes", "rest", "blocks")
    )
    planned = settle(planned, "mix-plan")
    few = is_small(planned, FEW)
    hint = F.broadcast if few else (lambda x: x)
    p, s = planned.alias("p"), slim.alias("s")
    placed = s.join(hint(p), F.col("s.source").eqNullSafe(F.col("p.source"))).where("p.rest > 0")
    placed = placed.select("p.source", "p.rest", "s.words", "s.key", F.pmod(F.col("s.key"), F.col("p.blocks")).alias("block"))
    per_block = placed.groupBy("source", "block").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    per_block = per_block.withColumn("order", _order(F.col("block"), seed))
    per_block = per_block.withColumn("range", F.shiftright("order", KEY_BITS - RANGE_BITS))
    per_block = settle(per_block, "mix-blocks")
    # The last range that the rest reaches into, and what it leaves for that one.
    per_range = per_block.groupBy("source", "range").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("range")
    per_range = per_range.withColumn("left", F.col("rest") - F.sum("words").over(w) + F.col("words"))
    reached = per_range.where("left > 0").groupBy("source").agg(F.max_by(F.struct("range", "left"), "range").alias("end"))
    b, r = per_block.alias("b"), hint(reached.select("source", "end.*")).alias("r")
    same = F.col("b.source").eqNullSafe(F.col("r.source")) & (F.col("b.range") == F.col("r.range"))
    per_block = b.join(r, same).select("b.source", "b.block", "b.order", "b.words", F.col("r.left").alias("rest"))
    w = Window.partitionBy("source").orderBy("order", "block")
    per_block = per_block.withColumn("before", F.sum("words").over(w) - F.col("words"))
    # The last block that the rest reaches into; it is taken in part.
    last = settle(
        per_block.where("before < rest").groupBy("source").agg(
            F.max_by(F.struct("block", "order", (F.col("rest") - F.col("before")).alias("left")), F.struct("order", "block")).alias("end")
        ).select("source", "end.*"),
        "mix-ends",
    )
    e = last.alias("e")
    inside = placed.alias("r").join(
        hint(e), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.block") == F.col("e.block"))
    ).select("e.source", "e.left", "r.key", "r.words")
    upto = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") <= F.col("left"))
    cut = cut.groupBy("source").agg(F.max("key").alias("end_key")).alias("c")
    joined = p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").join(
        cut, F.col("p.source").eqNullSafe(F.col("c.source")), "left"
    )
    return settle(
        joined.select(
            "p.source", "p.tokens", "p.wanted", "p.passes", "p.blocks",
            F.col("e.order").alias("end_order"), F.col("e.block").alias("end_block"), F.coalesce("c.end_key", F.lit(-1)).alias("end_key"),
        ),
        "mix-cuts",
    )


def copies(docs: DataFrame, planned: DataFrame, seed: int = 7, name: str = "copies") -> DataFrame:
    """``docs`` with the number of copies of each row, from 0 up; no row is left out.

    The plan has a row per source and is broadcast while it is small, so texts are not
    shuffled. A column that has the name of the new one is replaced.
    """
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    p = planned.select(F.struct(*planned.columns).alias("__mix"))
    p = F.broadcast(p) if is_small(p, FEW) else p
    key = _key(F.col("doc_id"), seed)
    block = F.pmod(key, F.col("__mix.blocks"))
    order = _order(block, seed)
    end = F.struct(F.col("__mix.end_order"), F.col("__mix.end_block"), F.col("__mix.end_key"))
    more = F.coalesce(F.struct(order, block, key) <= end, F.lit(False))
    more = F.when(F.col("__mix.end_order").isNull(), False).otherwise(more)
    joined = d.join(p, d["source"].eqNullSafe(F.col("__mix.source")))
    return joined.select(*[d[f"`{c}`"] for c in d.columns], (F.col("__mix.passes") + more.cast("long")).alias(name))


def mix(docs: DataFrame, target: Target, seed: int = 7) -> DataFrame:
    """``docs`` with ``copies``: how often each row is used to meet the target.

    Tokens are words. Rows without a source form a source of their own, and so do rows
    with an empty one; rows without a doc_id share one place in the permutation, as do
    rows that repeat a doc_id, and go in or stay out together. A missing or empty text
    has no tokens and costs nothing. Of the budget at most the document that would
    overrun it in each source stays unspent. An empty table gives no rows.
    """
    return copies(docs, plan(docs, target, seed), seed)


def realise(mixed: DataFrame, name: str = "copies") -> DataFrame:
    """Every row as often as its copies say, without that column."""
    kept = [f"`{c}`" for c in mixed.columns if c != name]
    rows = mixed.where(F.col(name) > 0)
    return rows.select(*kept, F.explode(F.sequence(F.lit(1), F.col(name).cast("int"))).alias("__copy")).select(*kept)
