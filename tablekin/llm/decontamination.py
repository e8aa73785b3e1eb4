"""Documents that hold benchmark text, by spaced seeds.

A document is contaminated by a benchmark item if some ``WINDOW`` consecutive words of
both agree in all but ``MISSES`` places; items of fewer words, down to the span of the
first mask, must occur whole and unchanged.

The masks are built from blocks of three words and ignore all between them. Cut a
window of 13 words into blocks of 3, 3, 3 and 4: two substitutions leave two blocks
whole, and whichever two these are, they lie as the two blocks of one of the masks do. So
every contaminated window holds a seed whose hash is equal on both sides: joining the
hashes misses nothing. Around each hit, the words themselves decide.

Everything is DataFrame code: seeds come from arrays in one pass over a document's words
without a shuffle, and only hits leave that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import is_small
from tablekin.session import settle

#: Words of a window, substitutions allowed in it, and distances of a mask's two blocks.
WINDOW, MISSES, GAPS = 13, 2, (3, 6, 9)

_BLOCK = 3

#: Positions handled in one row, whatever the length of a text.
PIECE = 2048

#: Seeds of the benchmark that are broadcast; more of them are joined by a shuffle.
MOST_SEEDS = 1_000_000

_REACH = WINDOW - 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a missing text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), F.array().cast("array<string>"))


def _pieces(rows: DataFrame, key: str) -> DataFrame:
    """``(key, piece, begin, words)``: bounded parts of each text with context around.

    ``begin`` is the position of the part's first word; a part holds the seeds that
    start at its ``PIECE`` positions and the words that a window around them can reach.
    """
    held = rows.select(F.col(key).alias("id"), words(F.col("text")).alias("all"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("all") / PIECE).cast("int") - 1, F.lit(0)))
    cut = held.where(F.size("all") >= 2 * _BLOCK).select("id", "all", F.explode(parts).alias("piece"))
    begin = F.greatest(F.col("piece") * PIECE - _REACH, F.lit(0))
    return cut.select(
        "id", "piece", begin.alias("begin"), F.slice("all", begin + 1, F.lit(PIECE + 3 * WINDOW)).alias("words"),
    )


def _seeds(pieces: DataFrame, *carried: str) -> DataFrame:
    """One row ``(id, piece, at, seed, ...)`` per seed; ``at`` counts within the part."""
    triple = F.transform(
        "words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    )
    blocks = pieces.select(*pieces.columns, triple.alias("t"))
    # The last two entries lack a word or two.
    blocks = blocks.select(*pieces.columns, F.slice("t", 1, F.size("t") - _BLOCK + 1).alias("t"))
    side = F.arrays_zip(F.col("t").alias("t0"), *[F.slice("t", g + 1, F.size("t")).alias(f"t{g}") for g in GAPS])
    each = blocks.select(*pieces.columns, F.posexplode(side).alias("at", "z"))
    first = F.when(F.col("piece") > 0, _REACH).otherwise(0)
    own = (F.col("at") >= first) & (F.col("at") < first + PIECE)
    seeds = F.array(
        *[F.when(F.col(f"z.t{g}").isNotNull(), F.xxhash64(F.lit(g), "z.t0", f"z.t{g}")) for g in GAPS]
    )
    return each.where(own).select("id", "piece", "at", *carried, F.explode(seeds).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, matched, first_word)`` of each document and item it holds.

    ``matched`` is the largest number of agreeing words in one window, ``first_word``
    the position at which the first contaminated window starts, both over words as
    :func:`words` gives them. Missing, empty and too short texts on either side are in
    no pair, nor are items or documents without an identifier. Rows that repeat a
    doc_id count as one document, rows that repeat an item_id as one item. Without
    documents or items there are no rows. Further columns are ignored.
    """
    items = settle(
        benchmark.where("item_id is not null").select("item_id", "text", F.xxhash64("item_id", "text").alias("item_row")).distinct(),
        "items",
    )
    whole = items.select("item_row", "item_id", words(F.col("text")).alias("item_words")).where(
        F.size("item_words") >= 2 * _BLOCK
    )
    placed = _seeds(_pieces(items, "item_row"), "begin")
    wanted = settle(
        placed.select(F.col("id").alias("item_row"), (F.col("at") + F.col("begin")).alias("q"), "seed"), "item-seeds"
    )
    pieces = _pieces(docs.where("doc_id is not null"), "doc_id")
    if is_small(wanted, MOST_SEEDS):
        hits = _seeds(pieces, "begin", "words").join(F.broadcast(wanted), "seed")
        whole = F.broadcast(whole)
    else:
        found = _seeds(pieces).join(wanted, "seed").select("id", "piece", "at", "item_row", "q")
        hits = found.join(pieces, ["id", "piece"])
    low = F.least(F.lit(_REACH), F.col("at"), F.col("q"))
    hits = hits.select(
        "id", "item_row", "q", low.alias("low"), (F.col("begin") + F.col("at") - low).alias("from_word"),
        F.slice("words", F.col("at") - low + 1, F.lit(2 * _REACH + 1)).alias("doc_part"),
    )
    near = hits.join(whole, "item_row").select(
        "id", "item_id", "from_word", "doc_part",
        F.slice("item_words", F.col("q") - F.col("low") + 1, F.lit(2 * _REACH + 1)).alias("item_part"),
        F.least(F.lit(WINDOW), F.size("item_words")).alias("width"),
    )
    n = F.least(F.size("doc_part"), F.size("item_part"))
    same = F.zip_with(
        F.slice("doc_part", 1, n), F.slice("item_part", 1, n), lambda a, b: F.when(a == b, 1).otherwise(0)
    )
    near = near.select("id", "item_id", "from_word", "width", same.alias("same")).where(F.size("same") >= F.col("width"))
    starts = F.sequence(F.lit(0), F.size("same") - F.col("width"))
    counts = F.transform(
        starts, lambda i: F.aggregate(F.slice("same", i + 1, F.col("width")), F.lit(0), lambda s, x: s + x)
    )
    near = near.select("id", "item_id", "from_word", "width", counts.alias("counts"))
    least = F.when(F.col("width") < WINDOW, F.col("width")).otherwise(WINDOW - MISSES)
    near = near.select(
        "id", "item_id", "from_word", F.array_max("counts").alias("matched"), "counts", least.alias("least")
    ).where("matched >= least")
    start = F.col("from_word") + F.array_position(F.transform("counts", lambda c: c >= F.col("least")), True).cast("int") - 1
    return (
        near.select(F.col("id").alias("doc_id"), "item_id", "matched", start.alias("first_word"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.min("first_word").alias("first_word"))
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with all their columns.

    Rows without a doc_id stay; of rows that repeat a doc_id all go if one is
    contaminated.
    """
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("__contaminated")).distinct()
    # Contaminated documents grow with the table: joined by a shuffle at every size.
    return docs.join(bad.hint("merge"), docs["doc_id"] == F.col("__contaminated"), "left_anti")
