import random

import numpy as np
import pytest
import xxhash
from helpers import corpus, frame

from tablekin.llm import simhash
from tablekin.llm.graph import components



def words(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def shingles(text, width):
    w = words(text)
    if len(w) >= width:
        return [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)]
    return [b" ".join(w)] if w else []


def print_of(text, width=3):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, linked):
    """Smallest identifier that each one reaches."""
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups_by_brute_force(spark):
    docs = corpus()
    found = simhash.near_duplicates(frame(spark, docs)).collect()
    assert len(found) == len(docs)
    prints = {i: print_of(t) for i, t, _ in docs if i is not None}
    expected = grouped(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None
        else:
            assert row["fp"] & (2**64 - 1) == prints[row["doc_id"]]
            assert row["component_id"] == expected[row["doc_id"]]
    zero = {r["component_id"] for r in found if r["fp"] == 0}
    assert zero == {100}


def test_empty_table(spark):
    none = frame(spark, corpus()).where("false")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.deduplicate(none).collect() == []


@pytest.mark.parametrize("radius,leaf", [(3, 1024), (3, 4), (6, 16)])
def test_trees_lose_no_group(spark, radius, leaf):
    rng = random.Random(radius + leaf)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            noise = 0
            for _ in range(rng.randrange(8)):
                noise |= 1 << rng.randrange(64)
            fps.append(base ^ noise)
    fps = sorted(set(fps))
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node bigint, fp bigint")
    found = components(simhash.links(nodes, radius, leaf)).collect()
    named = {r["node"]: r["component"] for r in found}
    expected = grouped(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius)
    assert {i: named.get(i, i) for i in range(len(fps))} == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(7, 7), (900, 901)], "u bigint, v bigint")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(401)} | {900: 900, 901: 900}
    assert components(links.where("false")).collect() == []


@pytest.mark.parametrize("leaf", [1024, 3])
def test_similar_by_brute_force(spark, leaf):
    docs = [d for d in corpus(n=80) if d[0] is not None]
    sets = {i: set(shingles(t, 5)) for i, t, _ in docs}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return not sets[a] and not sets[b] or both and both >= 0.8 * (len(sets[a] | sets[b]))

    expected = grouped(list(sets), linked)
    df = frame(spark, docs)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, leaf=leaf).collect()}
    assert found == expected
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(df).collect())
    assert kept == sorted(set(expected.values()))
    assert simhash.deduplicate(df).columns == df.columns


def test_rows_without_doc_id_stay(spark):
    df = frame(spark, [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", "s")])
    kept = [r["doc_id"] for r in simhash.deduplicate(df).collect()]
    assert sorted(kept, key=str) == [1, None, None]


@pytest.mark.parametrize("leaf", [1024, 3])
def test_similar_sets_of_unlike_texts(spark, leaf):
    """Lines that repeat in one text alone, and sets of four and five shingles."""
    rng = random.Random(12)
    docs, line = [], " ".join(f"line{k}" for k in range(20))
    for k in range(40):
        base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))
        docs += [(4 * k, f"{base} {line}", "s"), (4 * k + 1, f"{base}{f' {line}' * 60}", "s")]
        short = [f"u{rng.randrange(10**6)}" for _ in range(9)]
        docs += [(4 * k + 2, " ".join(short), "s"), (4 * k + 3, " ".join(short[:8]), "s")]
    for k in range(400, 1600, 2):
        short = [f"t{rng.randrange(10**6)}" for _ in range(9)]
        docs += [(k, " ".join(short), "s"), (k + 1, " ".join(short[1:]), "s")]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, docs), leaf=leaf).collect()}
    assert found == {i: i - i % 2 for i, _, _ in docs}


@pytest.mark.parametrize("leaf", [1024, 3])
def test_prefixes_lose_no_pair(spark, monkeypatch, leaf):
    """Pairs at the limit, found by the prefixes alone."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "_found", lambda part, radius: (np.empty(0, np.int64),) * 2)
    rng = random.Random(13)
    docs, passage = [], " ".join(f"p{k}" for k in range(30))
    for k in range(120):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        other = base[: len(base) - rng.randrange(1, 1 + len(base) // 5)] + ["z"] * rng.randrange(2)
        more = [passage] if k % 3 == 0 else []
        docs += [(2 * k, " ".join(more + base), "s"), (2 * k + 1, " ".join(more + other), "s")]
    sets = {i: set(shingles(t, 5)) for i, t, _ in docs}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    expected = grouped(list(sets), alike)
    assert 20 < sum(i != c for i, c in expected.items()) < 110
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(frame(spark, docs), leaf=leaf).collect()}
    assert found == expected
