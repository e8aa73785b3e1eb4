"""Whitening and near-duplicates of embeddings against plain computations."""

import math
from collections import Counter

import numpy as np
import pytest

from tablekin.llm import caps, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, number string, d int, v string, n string, id string, vec string"
EXTRA = ("x", 1, "x", "x", "x", "x")
NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA.replace("array<float>", f"array<{kind}>"))


def vectors(seed=1, d=24, groups=12, per=9):
    """``(vec_id, vector, label)``: near, equal and scaled copies, and lone vectors."""
    random = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = random.standard_normal(d)
        for k in range(per):
            noise = random.standard_normal(d) * np.linalg.norm(base) / math.sqrt(d)
            rows.append((base + noise * [0, 0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.02, 0.3][k], [g % 3, None][k == 7]))
        rows.append((rows[-per][0] * 4, g % 3))
    rows += [(random.standard_normal(d), int(random.integers(3))) for _ in range(60)]
    order = random.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in v], l) for i, (v, l) in zip(order, rows)]


AWKWARD = [
    (900, None, 1), (901, [], 1), (902, [0.0, 0.0], 1), (903, [1.0, None], 1), (904, [NAN, 1.0], 1), (905, [INF, 1.0], 1),
    (906, [1.0, 2.0], None), (907, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1),
    (None, [1.0, 2.0], 1), (910, [-0.0, 3.0], 1), (911, [0.0, 3.0], 1), (912, [1.0], 1), (913, [5.0], 1), (914, [-5.0], 1),
]


def plain_links(rows):
    """``vec_id -> (links, component)`` over all pairs, for identifiers that are unique."""
    fine = {}
    for i, v, l in rows:
        if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            m = max(map(abs, v))
            u = np.array(v, float) / m
            fine[i] = (u / np.linalg.norm(u), l)
    near = {i: [j for j, (w, k) in fine.items() if j != i and k == l and len(w) == len(u) and float(u @ w) >= 0.98] for i, (u, l) in fine.items()}
    out, seen = {i: (0, i) for i, *_ in rows}, set()
    for i in sorted(fine):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            if (j := todo.pop()) not in group:
                group.add(j)
                todo += near[j]
        seen |= group
        out |= {j: (len(near[j]), min(group)) for j in group}
    return out


def check_links(spark, rows, kind="float"):
    got = caps.near_duplicates(table(spark, rows, kind), "vec_id", "embedding", "label").collect()
    want = plain_links([r for r in rows if r[0] is not None])
    assert Counter(r["vec_id"] for r in got) == Counter({r[0] for r in rows})
    for r in got:
        links, component = want.get(r["vec_id"], (0, None))
        assert (r["n_links"], r["component_id"]) == (links, component), r
        assert r["kept"] == (r["vec_id"] == component or r["vec_id"] is None)
    return want


def test_caps_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 4)
    monkeypatch.setattr(caps, "ROWS", 200)
    want = check_links(spark, vectors() + AWKWARD)
    assert sum(n for n, _ in want.values()) > 300
    check_links(spark, vectors(2, d=64))


def test_caps_of_long_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    turn = [(i, [math.cos(i * 0.15), math.sin(i * 0.15), *[0.0] * 14], 0) for i in range(30)]
    random = np.random.default_rng(5)
    base = random.standard_normal(16)
    many = [(100 + i, (base + random.standard_normal(16) * 0.05).tolist(), 1) for i in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in turn + many]
    want = check_links(spark, rows)
    assert want[29][1] == 0 and want[150][0] == 149


def test_caps_of_extreme_sizes_and_empty_tables(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-200, 1e-200], 0), (4, [1e200, -1e200], 0), (5, [5e-324, 5e-324], 0)]
    want = check_links(spark, rows, "double")
    assert want[1] == (3, 1) and want[4] == (0, 4)
    assert caps.near_duplicates(table(spark, []), "vec_id", "embedding", "label").collect() == []
    alone = check_links(spark, AWKWARD[:6])
    assert all(n == 0 for n, _ in alone.values())


@pytest.mark.parametrize("d", [16, 64, 384])
def test_codes_keep_near_pairs_together(d):
    code = caps.code_for(d, 100_000)
    random = np.random.default_rng(77)
    u = random.standard_normal((1500, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = random.standard_normal((1500, d))
    v -= np.einsum("id,id->i", u, v)[:, None] * u
    v = 0.98 * u + math.sqrt(1 - 0.98**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    assert code.words**code.blocks > 10_000
    assert caps._recall(code, u, v) >= 0.998


def test_decoding_lists_every_filter_over_the_threshold():
    code = caps.Code(12, 3, 7, 5, 0.02)
    random = np.random.default_rng(4)
    u = random.standard_normal((50, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = u @ code.turn
    fits = [x[:, low:high] @ word.T for (low, high), word in zip(code.parts, code.book)]
    every = (fits[0][:, :, None, None] + fits[1][:, None, :, None] + fits[2][:, None, None, :]).reshape(50, -1)
    limit = np.minimum(code.threshold, np.sort(every, axis=1)[:, -5])
    want = {(i, j) for i, j in zip(*np.nonzero(every >= limit[:, None] - 1e-12))}
    assert set(zip(*(y.tolist() for y in code.decode(u)))) == want


def plain_whitening(rows):
    kept = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    far = x * n - sums
    y = far / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    return [i for i, _ in kept], (far**2).sum(axis=1), y @ directions / np.sqrt(values), values / (y**2).sum() * n


def test_whitening_by_numpy(spark):
    random = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in random.standard_normal(20) * np.linspace(1, 2, 20)], i % 3) for i in range(300)]
    rows += [(i, v, l) for i, v, l in AWKWARD if v is None or len(v) != 2 or None in v or not all(map(math.isfinite, v))]
    got = whitening.whiten(table(spark, rows).repartition(4), "vec_id", "embedding").collect()
    ids, deviations, white, explained = plain_whitening([r for r in rows if r[1] and len(r[1]) == 20])
    assert len(got) == len(ids) * 8
    place = {i: k for k, i in enumerate(ids)}
    made = np.zeros_like(white)
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (300, deviations[k])
        assert abs(r["explained"] / explained[c] - 1) < 1e-10
        assert r["identity_error"] < 1e-9
        made[k, c] = r["whitened"]
    for c in range(8):
        assert min(np.abs(made[:, c] - white[:, c]).max(), np.abs(made[:, c] + white[:, c]).max()) < 1e-9


def test_whitening_of_few_equal_and_repeated_rows(spark):
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)]), "vec_id", "embedding").collect()
    assert len(one) == 4 and {r["vec_id"] for r in one} == {1, None}
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    assert {r["deviation"] for r in one} == {0}
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)]), "vec_id", "embedding").collect()
    assert len(flat) == 6
    assert sorted({(r["component"], r["whitened"] is None, round(r["explained"], 12)) for r in flat}) == [(1, False, 1.0), (2, True, 0.0)]
    assert whitening.whiten(table(spark, []), "vec_id", "embedding").collect() == []
    assert whitening.whiten(table(spark, [(1, None, 0), (2, [NAN], 0)]), "vec_id", "embedding").collect() == []


def test_whitening_of_large_entries(spark):
    rows = [(1, [1e9, 1.0], 0), (2, [-1e9, 2.0], 0), (3, [1e200, 0.0], 0), (4, [0.5, 0.25], 0), (5, [2e15, 0.0], 0)]
    got = whitening.whiten(table(spark, rows, "double"), "vec_id", "embedding").collect()
    x = np.array([[int(1024 * c) + 100_000 for c in v] for i, v, _ in rows if i != 3], object)
    far = x * 4 - x.sum(axis=0)
    exact = [int(sum(y * y for y in row)) for row in far]
    want = {i: (y if y < 1 << 63 else None) for i, y in zip([1, 2, 4, 5], exact)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want


@pytest.mark.parametrize("case", ["random", "equal", "split", "low", "close", "one", "two"])
def test_components_by_numpy(case):
    random = np.random.default_rng(3)
    a = random.standard_normal((40, 40))
    q = np.linalg.qr(a)[0]
    matrix = {
        "random": a @ a.T,
        "equal": np.eye(30) * 5,
        "split": np.kron(np.eye(5), a[:6, :6] @ a[:6, :6].T),
        "low": a[:, :3] @ a[:, :3].T,
        "close": q @ np.diag(np.concatenate(([5, 5 - 1e-9, 5 - 1e-6, 4.9999], np.linspace(0, 4, 36)))) @ q.T,
        "one": np.array([[7.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    }[case]
    want = min(8, len(matrix))
    values, vectors = whitening.leading_components((matrix + matrix.T) / 2, want)
    top = np.abs(values).max()
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:want], atol=1e-12 * top)
    assert np.abs(vectors @ vectors.T - np.eye(want)).max() < 1e-9
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-11 * max(top, 1)
