"""Nearest neighbours by cosine from one navigable small-world graph per shard.

Equal vectors are one node that knows its smallest identifiers, so copies cost nothing
and lose nothing. Nodes are dealt over shards of bounded size. In a shard every node has
a random level; on each level it is linked to near and mutually distant ones among the
nodes that came before it, and they to it. A shard is one row: its vectors, identifiers
and, level by level, neighbours as flat arrays. A search goes greedily down the levels
and then keeps a beam of the best nodes on the lowest one; all queries of a block take
their steps together. The best of every shard are merged, with cosines in double
precision on the vectors as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekin.session import settle

#: Nodes of a shard at most on average, shards at least, queries of a block on average.
SHARD, SHARDS, QUERIES = 8192, 32, 4096

#: Links chosen by a node, links kept per node on the lowest level, nodes weighed when
#: linking, and beam of a search.
LINKS, KEPT, WEIGHED, BEAM = 16, 32, 48, 96

_STRIDE = 512


def usable(vector: Column) -> Column:
    """Not missing, not zero, all components present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which change no cosine, so that no square overflows
    or vanishes: the largest component of each is between 1/2 and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _packed(rows: DataFrame, id_name: str, vector: str) -> DataFrame:
    """``(id, vec)`` with the vector as bytes of doubles, unusable ones left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)) if len(column) else []
            vec = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(column) else []
            yield pa.record_batch([batch.column("id"), pa.array(vec, pa.binary())], ["id", "vec"])

    v = F.col(vector).cast("array<double>")
    known = rows.select(F.col(id_name).cast("long").alias("id"), v.alias("v"))
    return known.where(F.col("id").isNotNull() & usable(F.col("v"))).mapInArrow(work, "id long, vec binary")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``(vec, ids)``: each vector once, with its ``keep`` smallest identifiers.

    Tasks cut the lists down before they are shuffled, so a vector that a third of all
    rows share arrives as a few identifiers a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[bytes, list[int]] = {}
            for i, v in sorted(zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist())):
                held = least.setdefault(v, [])
                if len(held) < keep and (not held or held[-1] != i):
                    held.append(i)
            yield pa.record_batch(
                [pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.list_(pa.int64()))], ["vec", "ids"]
            )

    some = rows.mapInArrow(work, "vec binary, ids array<long>")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return some.groupBy("vec").agg(F.slice(ids, 1, keep).alias("ids"))


def _diverse(near: np.ndarray, sims: np.ndarray, x: np.ndarray, want: int) -> np.ndarray:
    """Up to ``want`` of each row's candidates, best first: those nearer to the row than
    to any chosen before, then the best of the others. -1 marks no candidate."""
    rows, width = near.shape
    between = np.einsum("rid,rjd->rij", x[near], x[near])
    chosen = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf, np.float32)
    for j in range(width):
        take = (near[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (chosen.sum(axis=1) < want)
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, j]), closest)
    rank = np.argsort(np.where(near < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :want]
    return np.take_along_axis(near, rank, axis=1)


def _layer(x: np.ndarray, kept: int) -> np.ndarray:
    """Neighbours of all nodes of one level; nodes stand in the order they came."""
    n = len(x)
    if n < 2:
        return np.full((n, kept), -1, np.int32)
    a, b, s = [], [], []
    width = min(WEIGHED, n - 1)
    for low in range(0, n, _STRIDE):
        high = min(low + _STRIDE, n)
        sims = x[low:high] @ x[:high].T
        sims[np.arange(high)[None, :] >= np.arange(low, high)[:, None]] = -np.inf
        take = min(width, high)
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        val = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-val, axis=1, kind="stable")
        near, val = np.take_along_axis(near, order, axis=1), np.take_along_axis(val, order, axis=1)
        near = np.where(np.isfinite(val), near, -1)
        links = _diverse(near, val, x, LINKS)
        row, _ = np.nonzero(links >= 0)
        to = links[links >= 0]
        a.append(row + low)
        b.append(to)
        s.append(np.einsum("id,id->i", x[row + low], x[to]))
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    a, b, s = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    most = min(int(place.max()) + 1, 3 * kept)
    # Beyond three times the links kept, a node's farthest links are not weighed.
    fits = place < most
    near, val = np.full((n, most), -1, np.int64), np.full((n, most), -np.inf, np.float32)
    near[a[fits], place[fits]], val[a[fits], place[fits]] = b[fits], s[fits]
    out = np.full((n, kept), -1, np.int32)
    for low in range(0, n, _STRIDE):
        part = _diverse(near[low : low + _STRIDE], val[low : low + _STRIDE], x, kept)
        out[low : low + _STRIDE, : part.shape[1]] = part
    return out


def build(vectors: np.ndarray, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and their neighbours of each level, the lowest level first."""
    vectors = _scaled(vectors)
    x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / math.log(LINKS)).astype(int)
    nodes, near = [], []
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level >= k)
        nodes.append(own.astype(np.int32))
        near.append(_layer(x[own], KEPT if k == 0 else LINKS))
    return nodes, near


def search(vectors: np.ndarray, nodes: list[np.ndarray], near: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Row numbers of the nodes in each query's beam, -1 where there are fewer."""
    x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    q = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
    m, n = len(q), len(x)
    at = np.full(m, nodes[-1][0], np.int64)
    for own, links in zip(nodes[:0:-1], near[:0:-1]):
        place = np.full(n, -1, np.int64)
        place[own] = np.arange(len(own))
        here = np.einsum("id,id->i", q, x[at])
        active = np.arange(m)
        while len(active):
            local = links[place[at[active]]]
            to = own[np.maximum(local, 0)]
            sims = np.einsum("id,ijd->ij", q[active], x[to])
            sims[local < 0] = -np.inf
            best = sims.argmax(axis=1)
            value = sims[np.arange(len(active)), best]
            better = value > here[active]
            active, best, value = active[better], best[better], value[better]
            at[active], here[active] = to[better, best], value
    beam = min(beam, n)
    held, value = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    held[:, 0], value[:, 0], open_[:, 0] = at, np.einsum("id,id->i", q, x[at]), True
    seen = np.zeros((m, n), bool)
    seen[np.arange(m), at] = True
    active = np.arange(m)
    while True:
        best = np.where(open_[active], value[active], -np.inf)
        pick = best.argmax(axis=1)
        more = np.isfinite(best[np.arange(len(active)), pick])
        active, pick = active[more], pick[more]
        if not len(active):
            return held
        open_[active, pick] = False
        to = near[0][held[active, pick]].astype(np.int64)
        new = (to >= 0) & ~seen[active[:, None], np.maximum(to, 0)]
        row, _ = np.nonzero(new)
        seen[active[row], to[new]] = True
        sims = np.full(to.shape, -np.inf, np.float32)
        sims[new] = np.einsum("id,id->i", q[active[row]], x[to[new]])
        every = np.concatenate((value[active], sims), axis=1)
        keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        value[active] = np.take_along_axis(every, keep, axis=1)
        held[active] = np.take_along_axis(np.concatenate((held[active], np.where(new, to, -1)), axis=1), keep, axis=1)
        open_[active] = np.take_along_axis(np.concatenate((open_[active], new), axis=1), keep, axis=1)


def index(rows: DataFrame, id_name: str, vector: str, keep: int) -> tuple[DataFrame, int]:
    """``(shard, dim, parts)``, one row per shard, and the number of shards.

    ``parts`` holds the vectors, identifiers and levels as bytes. All usable rows are
    in it; vectors of different lengths never share a graph.
    """
    nodes = settle(distinct_vectors(_packed(rows, id_name, vector), keep), "vectors")
    shards = max(SHARDS, math.ceil(nodes.count() / SHARD))

    def work(part: pa.Table) -> pa.Table:
        shard, dim = part.column("shard")[0].as_py(), part.column("dim")[0].as_py()
        # The order in which nodes come must not depend on how rows arrived.
        listed = sorted(zip(part.column("ids").to_pylist(), part.column("vec").to_pylist()))
        listed = [listed[i] for i in np.random.default_rng(shard).permutation(len(listed))]
        vectors = np.frombuffer(b"".join(v for _, v in listed), np.float64).reshape(len(listed), -1)
        own, near = build(vectors, shard)
        ids = np.array([i + [-1] * (keep - len(i)) for i, _ in listed], np.int64)
        parts = [vectors.tobytes(), ids.tobytes(), *(y.tobytes() for pair in zip(own, near) for y in pair)]
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "parts": pa.array([parts], pa.list_(pa.binary()))})

    dealt = nodes.select(
        F.pmod(F.xxhash64("vec"), shards).cast("int").alias("shard"), (F.octet_length("vec") / 8).cast("int").alias("dim"), "vec", "ids"
    )
    built = dealt.groupBy("shard", "dim").applyInArrow(work, "shard int, dim int, parts array<binary>")
    return settle(built, "graphs"), shards


def nearest(rows: DataFrame, queries: DataFrame, id_name: str, vector: str, k: int = 5, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows found.

    ``queries`` has the columns of ``rows``; a row of the same identifier is never its
    own neighbour. The score is the cosine, ties go to the smaller identifier, and
    queries with fewer candidates get all of them. Vectors that are missing, zero or
    hold a missing or non-finite component take no part on either side, nor do rows
    without an identifier; vectors of different lengths are no candidates of each
    other. A row that repeats identifier and vector counts once. Without rows or
    queries nothing is returned. Further columns are ignored.
    """
    graphs, shards = index(rows, id_name, vector, k + 1)
    asked = settle(_packed(queries, id_name, vector).distinct(), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERIES))

    def work(key: tuple, graph: pa.Table, asks: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not graph.num_rows or not asks.num_rows:
            return none
        dim = graph.column("dim")[0].as_py()
        parts = graph.column("parts")[0].as_py()
        vectors = _scaled(np.frombuffer(parts[0], np.float64).reshape(-1, dim))
        ids = np.frombuffer(parts[1], np.int64).reshape(len(vectors), -1)
        own = [np.frombuffer(y, np.int32) for y in parts[2::2]]
        near = [np.frombuffer(y, np.int32).reshape(len(o), -1) for o, y in zip(own, parts[3::2])]
        norms = np.linalg.norm(vectors, axis=1)
        out: list[tuple[np.ndarray, ...]] = []
        who = asks.column("id").to_numpy()
        what = _scaled(np.frombuffer(b"".join(asks.column("vec").to_pylist()), np.float64).reshape(len(who), dim))
        for low in range(0, len(who), _STRIDE):
            me, q = who[low : low + _STRIDE], what[low : low + _STRIDE]
            held = search(vectors, own, near, q, beam)
            safe = np.maximum(held, 0)
            score = np.einsum("id,ijd->ij", q, vectors[safe]) / (np.linalg.norm(q, axis=1)[:, None] * norms[safe])
            score[held < 0] = -np.inf
            # The whole beam is ranked, so that of equal scores the smallest identifier wins.
            ident = ids[safe].reshape(len(me), -1)
            value = np.repeat(score, ids.shape[1], axis=1)
            value = np.where((ident < 0) | (ident == me[:, None]), -np.inf, value)
            order = np.lexsort((ident, -value), axis=1)[:, :k]
            ident, value = np.take_along_axis(ident, order, axis=1), np.take_along_axis(value, order, axis=1)
            fine = np.isfinite(value)
            out.append((np.repeat(me, order.shape[1])[fine.ravel()], ident[fine], value[fine]))
        a, b, c = (np.concatenate(y) for y in zip(*out))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    dim = (F.octet_length("vec") / 8).cast("int").alias("dim")
    spread = asked.select("id", "vec", dim, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dim", "parts")
    found = copies.groupBy("shard", "block", "dim").cogroup(spread.groupBy("shard", "block", "dim")).applyInArrow(
        work, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
