"""Column pairs against column pairs: evidence for keys of several columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions import values as V
from tablekin.operators.cells import quoted, value_sets
from tablekin.operators.overlap import shared_values, truth_flag
from tablekin.operators.rows import Side, side_rows
from tablekin.session import lies_with, settle

PEER = ["l_col", "r_col", "peer_l_col", "peer_r_col"]


def peer_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that have neither their left nor their right column in common.

    Each two of them come once, the alphabetically first left column leading.
    """
    first = pairs.select("l_col", "r_col")
    second = pairs.select(
        F.col("l_col").alias("peer_l_col"), F.col("r_col").alias("peer_r_col")
    )
    apart = (F.col("l_col") < F.col("peer_l_col")) & (
        F.col("r_col") != F.col("peer_r_col")
    )
    return first.join(second, apart)


#: Keys that are broadcast to look cells up; more are joined by a shuffle.
FEW_KEYS = 500_000
#: A key that stands in more than one of so many rows of a table comes often.
SHARE = 5_000
#: Most passes over the rows of two tables, each for a part of their keys.
PASSES = 8
_NEVER_WHOLE = (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _key(df: DataFrame, name: str) -> tuple[Column, Column]:
    value, data_type = quoted(name), df.schema[name].dataType
    return V.typed_category(value, data_type), V.typed_match_key(value, data_type)


def _is_whole() -> Column:
    """Whether a key is the canonical text of an integer."""
    letter, size = F.substring("category", 1, 1), F.substring("category", 2, 20).cast("int")
    return letter.isin("P", "N") & (F.octet_length("match_key") == size)


def _whole_number(df: DataFrame, name: str) -> Column:
    """The number of a cell's key, if that is a whole one."""
    value = quoted(name)
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return value.cast("bigint")
    text = value.cast("string")
    return F.when(V.integer_value(text).cast("string") == text, V.integer_value(text))


def _common_keys(l_sets: DataFrame, r_sets: DataFrame, l_rows: int, r_rows: int) -> DataFrame:
    """Keys that both tables have, by one grouping: ``(category, match_key, whole, number, often)``.

    The number of a ``whole`` key, which is the canonical text of an integer, is that integer;
    the others are numbered and alone keep their category and text. ``often`` tells the keys
    that stand in more than one of ``SHARE`` rows in a column of either table.
    """
    tagged = l_sets.select("category", "match_key", F.col("n").alias("l_n"), F.lit(0).cast("bigint").alias("r_n")).unionByName(
        r_sets.select("category", "match_key", F.lit(0).cast("bigint").alias("l_n"), F.col("n").alias("r_n"))
    )
    both = tagged.groupBy("category", "match_key").agg(F.max("l_n").alias("l_n"), F.max("r_n").alias("r_n")).filter("l_n > 0 AND r_n > 0")
    return both.withColumn("whole", _is_whole()).select(
        *[F.when(~F.col("whole"), F.col(c)).alias(c) for c in ("category", "match_key")],
        "whole",
        F.when(F.col("whole"), F.col("match_key").try_cast("bigint")).otherwise(F.monotonically_increasing_id()).alias("number"),
        ((F.col("l_n") * SHARE > l_rows) | (F.col("r_n") * SHARE > r_rows)).alias("often"),
    )


def _slots(df: DataFrame, names: list[str]) -> list[tuple[int, bool]]:
    """The places of a row's keys: its column's, and whether whole keys or others lie there.

    A text column may hold both and has two.
    """
    slots = []
    for place, name in enumerate(names):
        data_type = df.schema[name].dataType
        if not isinstance(data_type, _NEVER_WHOLE):
            slots.append((place, True))
        if not isinstance(data_type, T.IntegralType):
            slots.append((place, False))
    return slots


def _coded(df: DataFrame, names: list[str], keys: DataFrame) -> DataFrame:
    """Rows as two lists of keys, ``seldom`` and ``often``, in the order of the keys.

    The order is the same in both tables. A key is told by ``whole`` and ``number``, ``slot``
    being twice its column's place, and one more for a whole key.

    Lists of keys to look up are broadcast if they are short. Where there are many, whole
    keys need no look-up but for those that come often, and others are joined by a shuffle.
    """
    whole, others = keys.filter("whole"), keys.filter("NOT whole")
    few = whole.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    known = F.broadcast((whole if few else whole.filter("often")).select("number", "often"))
    others = others.select("category", "match_key", "number", "often")
    others = F.broadcast(others) if others.limit(FEW_KEYS + 1).count() <= FEW_KEYS else others
    slots, rows, codes = _slots(df, names), df, []
    for at, (place, is_whole) in enumerate(slots):
        if is_whole:
            number = _whole_number(df, names[place])
            found = known.toDF(f"__n{at}", f"__o{at}")
            rows = rows.join(found, number == found[f"__n{at}"], "left")
            code = F.col(f"__n{at}") if few else number
        else:
            category, key = _key(df, names[place])
            found = others.toDF(f"__c{at}", f"__v{at}", f"__n{at}", f"__o{at}")
            rows = rows.join(found, (category == found[f"__c{at}"]) & (key == found[f"__v{at}"]), "left")
            code = F.col(f"__n{at}")
        codes += [code.alias(f"__k{at}"), F.coalesce(F.col(f"__o{at}"), F.lit(False)).alias(f"__o{at}")]
    rows = rows.select(*codes).filter(" + ".join(f"int(__k{at} IS NOT NULL)" for at in range(len(slots))) + " > 1")
    return rows.select(_listed(slots, "NOT __o").alias("seldom"), _listed(slots, "__o").alias("often"))


def _listed(slots: list[tuple[int, bool]], which: str) -> Column:
    """The keys of a row that are ``which``, sorted."""
    there = [F.expr(f"__k{at} IS NOT NULL AND {which}{at}") for at in range(len(slots))]
    cells = [
        F.when(t, F.struct(F.lit(whole).alias("whole"), F.col(f"__k{at}").alias("number"), F.lit(2 * place + whole).alias("slot")))
        for at, ((place, whole), t) in enumerate(zip(slots, there))
    ]
    # What is missing is sorted to the front.
    size = reduce(Column.__add__, [t.cast("int") for t in there])
    return F.slice(F.sort_array(F.array(*cells)), F.lit(len(slots) + 1) - size, size)


def _pairs_at(rows: DataFrame, own: str, behind: Column, chosen: Column | None = None) -> DataFrame:
    """The keys of the list ``own`` that are ``chosen``, each with the keys of its row behind it."""
    rows = rows.select("*", F.posexplode(own).alias("at", "low"))
    rows = rows if chosen is None else rows.filter(chosen)
    rows = rows.select(F.col("low.slot").alias("low"), F.col("low.number").alias("low_key"), behind.alias("behind")).filter(F.size("behind") > 0)
    # Two lists take much less of a shuffle than one of structs.
    return rows.select("low", "low_key", F.col("behind.slot").alias("high"), F.col("behind.number").alias("high_key"))


def _after(own: str) -> Column:
    return F.slice(own, F.col("at") + 2, F.size(own))


def _apart(pairs: DataFrame) -> DataFrame:
    return pairs.select("low", "low_key", F.inline(F.arrays_zip("high", "high_key")))


def _both_often(rows: DataFrame) -> DataFrame:
    """Every two keys of a row that come often."""
    return _apart(_pairs_at(rows, "often", _after("often")))


def _at_keys(rows: DataFrame, part: int, parts: int) -> DataFrame:
    """Every two keys of a row of which one does not come often, in the task of that one.

    A row goes once to each such key of a ``part`` of all keys, with the keys that come
    often and those behind it, and is taken apart there.
    """
    chosen = F.pmod(F.xxhash64("low.number", "low.whole"), F.lit(parts)) == part
    return _apart(_pairs_at(rows, "seldom", F.concat(_after("seldom"), "often"), chosen).repartition("low_key"))


def _met(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
    """How often two keys of a left row are two of a right one, by the places they have:
    ``(l_low, l_high, r_low, r_high, n)``.

    With ``once`` the right ones are grouped before the join, not only counted after it.
    """
    keys = ["low_key", "high_key", "low_whole", "high_whole"]

    def grouped(pairs: DataFrame, prefix: str) -> DataFrame:
        whole = [(F.col(c) % 2).alias(f"{c}_whole") for c in ("low", "high")]
        places = [F.shiftright(c, 1).alias(f"{prefix}_{c}") for c in ("low", "high")]
        placed = pairs.select("low_key", "high_key", *whole, *places)
        if prefix == "r" and not once:
            return placed.withColumn("r_n", F.lit(1))
        return placed.groupBy(*keys, f"{prefix}_low", f"{prefix}_high").agg(F.count(F.lit(1)).alias(f"{prefix}_n"))

    l_pairs, r_pairs = grouped(left, "l"), grouped(right, "r")
    # Two columns with the same key agree with two others both ways round.
    same = (F.col("low_key") == F.col("high_key")) & (F.col("low_whole") == F.col("high_whole"))
    ways = [F.struct(F.col(a).alias("l_low"), F.col(b).alias("l_high")) for a, b in (("l_low", "l_high"), ("l_high", "l_low"))]
    l_pairs = l_pairs.select(*keys, "l_n", F.inline(F.array_compact(F.array(ways[0], F.when(same, ways[1])))))
    products = F.col("l_n").cast("decimal(19,0)") * F.col("r_n").cast("decimal(18,0)")
    met = r_pairs.join(l_pairs.hint("shuffle_hash"), keys)
    return met.groupBy("l_low", "l_high", "r_low", "r_high").agg(F.sum(products).cast("decimal(38,0)").alias("n"))


def peer_row_overlap(
    left: DataFrame,
    right: DataFrame,
    pairs: DataFrame,
    l_sets: DataFrame | None = None,
    r_sets: DataFrame | None = None,
) -> DataFrame:
    """Row pairs that agree on both column pairs, for every two peers.

    Takes the two tables themselves, and their value sets where these are stored;
    ``pairs`` should be read from files. Row pairs are counted, never listed. A row is the
    numbers of its keys, and every two of them are a key of two numbers. Such keys are
    grouped in the left table, and equal ones of the right table add up.

    Two keys are counted where the first of them lies that does not come often, so a row is
    sent once per such key and never once per two. Keys that come often are at most ``SHARE``
    a column; two of those are grouped before anything is sent. Keys are dealt with in up
    to ``PASSES`` passes, each of which leaves its counts in files and drops what it shuffled.
    """
    peers = settle(peer_pairs(pairs), "peers")
    none = F.lit(0).cast("decimal(38,0)").alias("row_pairs")
    # Column names of the two tables, which their schemas bound.
    ends = peers.select(F.explode(F.array(*[F.struct(F.lit(c[-5]).alias("side"), F.col(c).alias("name")) for c in PEER])).alias("end"))
    named = ends.select("end.*").distinct().collect()
    names = {side: sorted(r["name"] for r in named if r["side"] == side) for side in ("l", "r")}
    if not named:
        return peers.select(*PEER, none)
    if l_sets is None or r_sets is None:
        l_sets, r_sets = value_sets(left, names["l"]), value_sets(right, names["r"])
    l_sets = l_sets.filter(F.col("column_name").isin(names["l"]))
    r_sets = r_sets.filter(F.col("column_name").isin(names["r"]))
    common = _common_keys(l_sets, r_sets, left.count(), right.count())
    keys = settle(common, "keys")
    l_rows, r_rows = (settle(_coded(df, names[side], keys), "rows") for df, side in ((left, "l"), (right, "r")))
    met = [settle(_met(_both_often(l_rows), _both_often(r_rows), True), "met")]
    passes = max(1, min(PASSES, r_rows.rdd.getNumPartitions() // 4))
    with lies_with(peers.sparkSession):
        for part in range(passes):
            found = _met(_at_keys(l_rows, part, passes), _at_keys(r_rows, part, passes), False)
            met.append(settle(found, "met"))
    # The pair whose left column comes first leads, whichever key is the smaller.
    first = F.col("l_low") < F.col("l_high")
    turned = {
        "l_col": F.when(first, F.col("l_low")).otherwise(F.col("l_high")),
        "r_col": F.when(first, F.col("r_low")).otherwise(F.col("r_high")),
        "peer_l_col": F.when(first, F.col("l_high")).otherwise(F.col("l_low")),
        "peer_r_col": F.when(first, F.col("r_high")).otherwise(F.col("r_low")),
    }
    place = {side: F.array(*[F.lit(n) for n in names[side]]) for side in ("l", "r")}
    counted = (
        reduce(DataFrame.unionByName, met)
        .groupBy(*[F.get(place[c[-5]], at).alias(c) for c, at in turned.items()])
        .agg(F.sum("n").cast("decimal(38,0)").alias("row_pairs"))
    )
    return peers.join(counted, PEER, "left").select(*PEER, F.coalesce("row_pairs", none).alias("row_pairs"))


def _marked_keys(shared: DataFrame, own: str, other: str, others: list[str]) -> DataFrame:
    """Keys of each column that some column of the other table has, with the places of those as ``mark``:
    ``(column_name, whole, number, category, match_key, mark)``, number or text being there."""
    place = F.array_position(F.array(*[F.lit(n) for n in others]), F.col(other)) - 1
    mark = F.array_join(F.sort_array(F.collect_set(place)).cast("array<string>"), ",")
    marked = shared.groupBy(own, "category", "match_key").agg(mark.alias("mark")).withColumn("whole", _is_whole())
    whole = F.col("whole")
    return marked.select(
        F.col(own).alias("column_name"),
        "whole",
        F.when(whole, F.col("match_key").try_cast("bigint")).alias("number"),
        *[F.when(~whole, F.col(c)).alias(c) for c in ("category", "match_key")],
        "mark",
    )


def _marked_rows(df: DataFrame, row_id: str | None, names: list[str], keys: DataFrame) -> DataFrame:
    """Rows with the marks of their keys, ``(row, marks)``: of each cell that has one, its place and mark.

    Lists of keys that are short are broadcast, all at once. For each other one the rows are
    shuffled by their key, with what has been found and the columns still to be looked up only.
    """
    sizes = {(r["column_name"], r["whole"]): r["n"] for r in keys.groupBy("column_name", "whole").agg(F.count(F.lit(1)).alias("n")).collect()}
    lists = sorted(sizes, key=lambda one: (sizes[one], one))
    short = [one for one in lists if sizes[one] <= FEW_KEYS]
    row = F.lit(None) if row_id is None else quoted(row_id)
    rows = df.select("*", row.cast("string" if row_id is None else df.schema[row_id].dataType).alias("__row"), F.lit("").alias("__marks"))
    steps = [short, *[[one] for one in lists if one not in short]]
    for done, step in enumerate(steps, 1):
        marks = [F.expr("nullif(__marks, '')")]
        for at, (name, whole) in enumerate(step):
            listed = keys.filter((F.col("column_name") == name) & (F.col("whole") == whole))
            if whole:
                found = listed.select("number", "mark").toDF(f"__n{at}", f"__m{at}")
                on = _whole_number(df, name) == found[f"__n{at}"]
            else:
                category, key = _key(df, name)
                found = listed.select("category", "match_key", "mark").toDF(f"__c{at}", f"__v{at}", f"__m{at}")
                on = (category == found[f"__c{at}"]) & (key == found[f"__v{at}"])
            rows = rows.join(F.broadcast(found) if step is short else found.hint("merge"), on, "left")
            marks.append(F.concat(F.lit(f"{names.index(name)}:"), F.col(f"__m{at}")))
        ahead = sorted({name for later in steps[done:] for name, _ in later})
        rows = rows.select("__row", F.concat_ws("|", *marks).alias("__marks"), *[quoted(n) for n in ahead])
        if len(step) == 1 and step is not short and ahead:
            rows = settle(rows, "marked")
    return rows.filter("__marks <> ''").toDF("row", "marks")


def _pair_lists(table: Side, shared: DataFrame, side: str) -> DataFrame:
    """Lists of the pairs that rows of one table take part in, with the number of such rows: ``(pairs, rows)``."""
    count = F.count(F.lit(1)).alias("rows")
    if table.source is None:
        rows = side_rows(table.index, shared, table.heavy, side)
        pairs = F.sort_array(F.collect_list(F.struct("l_col", "r_col"))).alias("pairs")
        return rows.groupBy("row_id").agg(pairs).groupBy("pairs").agg(count)
    own, other = ("l_col", "r_col") if side == "l" else ("r_col", "l_col")
    names, others = (sorted(r[0] for r in shared.select(c).distinct().collect()) for c in (own, other))
    df, row_id = table.source
    rows = _marked_rows(df, row_id, names, settle(_marked_keys(shared, own, other, others), "marks"))
    if row_id is not None:
        rows = rows.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list("marks")), "|").alias("marks"))
    lists = settle(rows.groupBy("marks").agg(count), "lists")

    def named(of: list[str], place: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in of]), place.cast("int"))

    def pairs_of(cell: Column) -> Column:
        place, mark = F.split_part(cell, F.lit(":"), F.lit(1)), F.split_part(cell, F.lit(":"), F.lit(2))
        return F.transform(F.split(mark, ","), lambda m: F.struct(named(names, place).alias(own), named(others, m).alias(other)))

    pairs = F.flatten(F.transform(F.split("marks", "[|]"), pairs_of))
    return lists.select(pairs.alias("pairs"), "rows")


def _rows_in_both(lists: DataFrame, alias: str) -> DataFrame:
    """Rows of one table that take part in two peers, counted per peers.

    Rows that take part in the same pairs come counted together. There are few
    such sets of pairs, so the square of a set is made once and not once per row.
    """
    first, second = F.col("first"), F.col("second")
    apart = (first["l_col"] < second["l_col"]) & (first["r_col"] != second["r_col"])
    return (
        lists.select("rows", "pairs", F.explode("pairs").alias("first"))
        .select("rows", "first", F.explode("pairs").alias("second"))
        .filter(apart)
        .groupBy(
            first["l_col"].alias("l_col"),
            first["r_col"].alias("r_col"),
            second["l_col"].alias("peer_l_col"),
            second["r_col"].alias("peer_r_col"),
        )
        .agg(F.sum("rows").alias(alias))
    )


def peer_containment(left: Side, right: Side) -> DataFrame:
    """How the rows behind two peers relate, on the left and on the right side.

    Only peers that have rows in common on both sides are kept. Sizes and flags
    are named for the pair and for the peer, per side.
    """
    shared = settle(shared_values(left.sets, right.sets), "shared")
    l_rows, r_rows = _pair_lists(left, shared, "l"), _pair_lists(right, shared, "r")
    sizes = shared.groupBy("l_col", "r_col").agg(
        F.count(F.lit(1)).alias("shared"),
        F.sum("l_n").alias("l_rows"),
        F.sum("r_n").alias("r_rows"),
    )
    peer_sizes = sizes.select(
        F.col("l_col").alias("peer_l_col"),
        F.col("r_col").alias("peer_r_col"),
        F.col("shared").alias("peer_shared"),
        F.col("l_rows").alias("peer_l_rows"),
        F.col("r_rows").alias("peer_r_rows"),
    )
    related = (
        _rows_in_both(l_rows, "l_overlap")
        .join(_rows_in_both(r_rows, "r_overlap"), PEER)
        .join(sizes, ["l_col", "r_col"])
        .join(peer_sizes, ["peer_l_col", "peer_r_col"])
    )
    flags = {}
    for side in ("l", "r"):
        overlap = F.col(f"{side}_overlap")
        flags[f"peer_contains_pair_{side}"] = overlap == F.col(f"{side}_rows")
        flags[f"pair_contains_peer_{side}"] = overlap == F.col(f"peer_{side}_rows")
    return related.withColumns(flags)


def peer_score(contained: DataFrame) -> DataFrame:
    """Score of two peers, once seen from the pair and once from the peer.

    Fixed weights: one point when the peer contains the pair on both sides, one
    for the reverse, one for both, one when as many left rows as right rows are
    common, and six more when that number is also the shared values of the pair.
    """

    def points(condition, weight):
        return F.when(condition, weight).otherwise(0)

    outer = F.col("peer_contains_pair_l") & F.col("peer_contains_pair_r")
    inner = F.col("pair_contains_peer_l") & F.col("pair_contains_peer_r")
    even = F.col("l_overlap") == F.col("r_overlap")
    common = points(outer, 1) + points(inner, 1) + points(outer & inner, 1)
    common = common + points(even, 1)

    def seen_from(size: str):
        return common + points(even & (F.col("l_overlap") == F.col(size)), 6)

    return contained.select(
        *PEER,
        "l_overlap",
        "r_overlap",
        seen_from("shared").alias("score"),
        seen_from("peer_shared").alias("peer_score"),
    )


def evidence_report(
    left: Side, right: Side, truth: Iterable[tuple[str, str]] = ()
) -> DataFrame:
    """What speaks for each column pair: its rows and, per peer, containment and score.

    One row per pair and peer, from the pair's side, and one for a pair without peers.
    ``truth`` names the pairs known to be true matches, which are marked on both.
    """
    spark = left.sets.sparkSession
    shared = settle(shared_values(left.sets, right.sets), "shared")
    sizes = shared.groupBy("l_col", "r_col").agg(
        F.count(F.lit(1)).alias("shared"),
        F.sum("l_n").alias("l_rows"),
        F.sum("r_n").alias("r_rows"),
    )
    marked = settle(truth_flag(spark, sizes, truth), "marked")
    contained = settle(peer_containment(left, right), "contained")
    scored = contained.join(
        peer_score(contained).select(*PEER, "score", "peer_score"), PEER
    )
    kept = ["l_overlap", "r_overlap"]
    sides = ("l", "r")
    from_pair = scored.select(
        *PEER, *kept, "score",
        *[f"peer_contains_pair_{s}" for s in sides],
        *[f"pair_contains_peer_{s}" for s in sides],
    )
    from_peer = scored.select(
        F.col("peer_l_col").alias("l_col"), F.col("peer_r_col").alias("r_col"),
        F.col("l_col").alias("peer_l_col"), F.col("r_col").alias("peer_r_col"),
        *kept, F.col("peer_score").alias("score"),
        *[F.col(f"pair_contains_peer_{s}").alias(f"peer_contains_pair_{s}") for s in sides],
        *[F.col(f"peer_contains_pair_{s}").alias(f"pair_contains_peer_{s}") for s in sides],
    )
    peer_marks = marked.select(
        F.col("l_col").alias("peer_l_col"),
        F.col("r_col").alias("peer_r_col"),
        F.col("true_positive").alias("peer_true_positive"),
    )
    evidence = from_pair.unionByName(from_peer).join(peer_marks, PEER[2:])
    return marked.join(evidence, ["l_col", "r_col"], "left")
