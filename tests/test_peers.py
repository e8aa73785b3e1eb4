import re
import time
from itertools import combinations

import pytest
from conftest import rows

from tablekin.operators import cells as C
from tablekin.operators import overlap as O
from tablekin.operators import peers as P
from tablekin.operators import rows as R

LEFT = [(i, i % 5, i % 3, 2) for i in range(40)]
RIGHT = [(i + 50, i % 5, (i + 1) % 3) for i in range(30)]
L_NAMES, R_NAMES = ("a", "b", "c", "d"), ("x", "y", "z")


def tables(spark, part_rows):
    left, right = frames(spark)
    return (
        R.Side.of(left, "a", part_rows=part_rows),
        R.Side.of(right, "x", part_rows=part_rows),
    )


def listed():
    found = {}
    for i, a in enumerate(L_NAMES):
        for j, b in enumerate(R_NAMES):
            pairs = {(l[0], r[0]) for l in LEFT for r in RIGHT if l[i] == r[j]}
            if pairs:
                found[a, b] = pairs
    return found


def peers_of(pairs):
    return [
        (p, q)
        for p, q in combinations(sorted(pairs), 2)
        if p[0] != q[0] and p[1] != q[1]
    ]


def frames(spark):
    return (
        spark.createDataFrame(LEFT, "a bigint, b bigint, c bigint, d bigint"),
        spark.createDataFrame(RIGHT, "x bigint, y bigint, z bigint"),
    )


@pytest.mark.parametrize("few", [0, 500_000])
def test_overlap_equals_listed_row_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(P, "FEW_KEYS", few)
    left, right = frames(spark)
    pairs = O.pair_overlap(C.value_sets(left), C.value_sets(right))
    found = P.peer_row_overlap(left, right, pairs).collect()
    by_pair = listed()
    expected = {(*p, *q): len(by_pair[p] & by_pair[q]) for p, q in peers_of(by_pair)}
    assert {tuple(r)[:4]: int(r["row_pairs"]) for r in found} == expected
    assert rows(P.peer_pairs(pairs)) == sorted(expected)


def test_no_pairs_no_peers(spark):
    left, right = frames(spark)
    none = spark.createDataFrame([], "l_col string, r_col string")
    assert P.peer_row_overlap(left, right, none).collect() == []


def test_empty_cells_agree_with_nothing(spark):
    left = spark.createDataFrame([(1, ""), (1, "q"), (None, "q")], "a int, b string")
    right = spark.createDataFrame([(1, ""), (1, "q"), (None, "q")], "x int, y string")
    pairs = O.pair_overlap(C.value_sets(left), C.value_sets(right))
    found = P.peer_row_overlap(left, right, pairs)
    assert [tuple(r) for r in found.collect()] == [("a", "x", "b", "y", 1)]


def test_containment_and_score(spark):
    left, right = tables(spark, 4)
    found = {tuple(r[c] for c in P.PEER): r for r in P.peer_containment(left, right).collect()}
    scores = {
        tuple(r[c] for c in P.PEER): (r["score"], r["peer_score"])
        for r in P.peer_score(P.peer_containment(left, right)).collect()
    }
    by_pair, expected = listed(), {}
    values = {
        (a, b): {l[i] for l in LEFT} & {r[j] for r in RIGHT}
        for i, a in enumerate(L_NAMES)
        for j, b in enumerate(R_NAMES)
    }
    for p, q in peers_of(by_pair):
        lp, lq = ({l for l, _ in by_pair[k]} for k in (p, q))
        rp, rq = ({r for _, r in by_pair[k]} for k in (p, q))
        if not (lp & lq and rp & rq):
            continue
        outer, inner = lp <= lq and rp <= rq, lq <= lp and rq <= rp
        even = len(lp & lq) == len(rp & rq)
        base = outer + inner + (outer and inner) + even
        expected[(*p, *q)] = tuple(
            base + (6 if even and len(lp & lq) == len(values[k]) else 0) for k in (p, q)
        )
        row = found[(*p, *q)]
        assert (row["l_overlap"], row["r_overlap"]) == (len(lp & lq), len(rp & rq))
        assert row["peer_contains_pair_l"] == (lp <= lq)
        assert row["pair_contains_peer_l"] == (lq <= lp)
        assert row["peer_contains_pair_r"] == (rp <= rq)
        assert row["pair_contains_peer_r"] == (rq <= rp)
    assert scores == expected
    assert set(found) == set(expected)


@pytest.mark.parametrize("few", [0, 500_000])
def test_overlap_of_all_kinds_of_values(spark, few, monkeypatch):
    monkeypatch.setattr(P, "FEW_KEYS", few)
    left = [("7", 7, 1.5, None), ("07", 7, 1.5, "x"), ("", 8, -0.0, "y"), ("-3", -3, 0.0, "x"), (None, None, None, "x")] * 3
    right = [(7, "7", "1.5", "x"), (7, "+7", "0.0", "x"), (-3, "-3", "-0.0", None), (8, "", "1.5", "y")] * 2
    l = spark.createDataFrame(left, "a string, b bigint, c double, d string")
    r = spark.createDataFrame(right, "w int, x string, y string, z string")
    pairs = O.pair_overlap(C.value_sets(l), C.value_sets(r))
    found = {tuple(v)[:4]: int(v["row_pairs"]) for v in P.peer_row_overlap(l, r, pairs).collect()}

    def key(v):
        if v is None or v == "":
            return None
        text = str(v)
        return (len(text), int(text)) if re.fullmatch("[+-]?[0-9]+", text) else text

    names = "abcd", "wxyz"
    match = [[{(n, m) for n in range(4) for m in range(4) if key(p[n]) is not None and key(p[n]) == key(q[m])} for q in right] for p in left]
    known = {tuple(v) for v in pairs.select("l_col", "r_col").collect()}
    expected = {}
    for (a, w), (b, x) in peers_of(known):
        one, two = (names[0].index(a), names[1].index(w)), (names[0].index(b), names[1].index(x))
        expected[a, w, b, x] = sum(one in m and two in m for row in match for m in row)
    assert found == expected and any(expected.values())


def test_only_numbers_of_keys_are_grouped(spark):
    left, right = frames(spark)
    pairs = P.settle(O.pair_overlap(C.value_sets(left), C.value_sets(right)), "pairs")
    plan = P.peer_row_overlap(left, right, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "match_key" not in plan.split("Relation")[0]


@pytest.mark.parametrize("share, few", [(0, 0), (4, 500_000)])
def test_overlap_where_keys_come_seldom(spark, share, few, monkeypatch):
    """No key comes often, so rows are sent to each of them; and a mixture."""
    monkeypatch.setattr(P, "SHARE", share)
    test_overlap_equals_listed_row_pairs(spark, few, monkeypatch)
    test_overlap_of_all_kinds_of_values(spark, few, monkeypatch)


def test_rows_are_sent_once_and_not_again_for_the_join(spark):
    row = "seldom array<struct<whole boolean, number bigint, slot int>>, often array<struct<whole boolean, number bigint, slot int>>"
    rows = spark.createDataFrame([([(False, 1, 0), (True, 5, 3)], [(True, 9, 5)])] * 3, row)
    with P.lies_with(spark):
        found = P._met(P._at_keys(rows, 0, 1), P._at_keys(rows, 0, 1), False)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 0, 1, 9), (0, 2, 0, 2, 9), (1, 2, 1, 2, 9)]
    assert len(re.findall(r"Exchange hashpartitioning\(low_key#\d+L, \d+\), REPARTITION", plan)) == 2
    assert plan.count("Exchange") == 3


def test_settled_results_leave_no_shuffle_behind(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return sum("shuffle" in blocks.apply(k).name() for k in range(blocks.size()))

    before = shuffled()
    settled = P.settle(spark.range(1000).repartition(4, "id"), "numbers")
    until = time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() <= before
    assert settled.count() == 1000


@pytest.mark.parametrize("few", [0, 500_000])
def test_containment_row_by_row_equals_that_of_the_index(spark, few, monkeypatch):
    """Keys of rows come twice and are missing; such rows count as one, unless they are known to be unique."""
    monkeypatch.setattr(P, "FEW_KEYS", few)
    left = [(1, "7", 1.5, "07"), (1, "7", 1.5, "x"), (2, "07", -0.0, None), (None, "7", 0.0, "x"), (None, "", 1.5, "x|y:z")]
    right = [(7, "7", "1.5", "x"), (7, "+7", "0.0", "x"), (1, "x|y:z", "-0.0", None), (2, "07", "1.5", "")] * 2
    l = spark.createDataFrame(left, "a int, `b c` string, d double, e string")
    r = spark.createDataFrame([(k, *v) for k, v in enumerate(right)], "line bigint, w int, x string, y string, z string")
    sides = [R.Side.of(l, "a"), R.Side.of(r, "line", ["w", "x", "y", "z"], unique=True)]
    found = P.peer_containment(*sides)
    for side in sides:
        side.source = None
    expected = P.peer_containment(*sides)
    assert found.dtypes == expected.dtypes
    assert rows(found) == rows(expected) != []


def test_containment_shuffles_rows_once_per_long_list(spark, monkeypatch):
    settled, settle = [], P.settle

    def told(df, label):
        settled.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, label)

    monkeypatch.setattr(P, "settle", told)
    P.peer_containment(*tables(spark, 4))
    lists = [plan for label, plan in settled if label == "lists"]
    # Short lists are broadcast; rows are shuffled to be counted and never cell by cell.
    assert len(lists) == 2
    assert all("Expand" not in p and "SortMergeJoin" not in p and p.count("Exchange hashpartitioning") == 2 for p in lists)
