"""Near-duplicate embeddings by spherical-cap filters.

A filter direction is one code word from each block of a product code: directions are as
many as words to the power of blocks, and none is ever listed. Vectors are turned by a
random rotation. A vector belongs to every filter whose direction it exceeds a threshold
with, that is, in whose cap of the sphere it lies. Block by block, only beginnings are
kept that the best words of the remaining blocks can still lift over the threshold, so
decoding costs about as much as there are filters found. Near vectors share most of their
caps, far ones hardly any. Vectors that no word of some block fits well would lie in few
caps or none; their threshold is lowered until they lie in enough.

Equal vectors are one node that knows how many identifiers it stands for. A first pass
shuffles filter numbers alone; nodes that share no filter are done. The others meet in
their shared filters and are verified in double precision there. A link counts in the
first filter that its two ends share, which their lists tell, so no pair is written or
sorted out later: a task gives sums per node and a spanning forest. A filter of many
nodes is dealt over pairs of blocks, so all tasks are of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.graph import components
from tablekin.session import settle

#: Least cosine of a link.
SIMILARITY = 0.98

#: Filters that a vector lies in at least, tried in turn, and the share of random pairs
#: at the least cosine that must have one in common.
LISTS, RECALL = (16, 24, 32, 48, 64, 96), 0.9995

#: Far vectors that a vector may meet on average, and most words of a block.
STRANGERS, WORDS = 2.0, 512

#: Nodes of a block of a large filter, rows of a task on average.
BLOCK, ROWS = 1024, 16384

_SLICE = 1024


class Code:
    """A random product code for vectors of one length."""

    def __init__(self, d: int, blocks: int, words: int, least: int, share: float, seed: int = 13):
        random = np.random.default_rng([seed, d])
        self.d, self.blocks, self.words, self.least = d, blocks, words, min(least, words**blocks)
        self.threshold = _threshold(d, share)
        turn, upper = np.linalg.qr(random.standard_normal((d, d)))
        self.turn = turn * np.sign(np.diag(upper))
        edges = np.linspace(0, d, blocks + 1).astype(int)
        self.parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.book = []
        for low, high in self.parts:
            word = random.standard_normal((words, high - low))
            self.book.append(word / np.linalg.norm(word, axis=1, keepdims=True) / math.sqrt(blocks))

    def _own(self, fits: list[np.ndarray]) -> np.ndarray:
        """The fit of each row's ``least``-th best direction; ``fits`` fall in each row."""
        best = fits[0][:, : self.least]
        for more in fits[1:]:
            # Only a place of at most so many better ones can be among the best sums.
            i, j = np.divmod(np.arange(self.least * self.least), self.least)
            near = ((i + 1) * (j + 1) <= self.least) & (i < best.shape[1]) & (j < more.shape[1])
            sums = best[:, i[near]] + more[:, j[near]]
            best = -np.sort(-sums, axis=1)[:, : self.least]
        return best[:, min(self.least, best.shape[1]) - 1]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of all filters that unit vectors exceed."""
        rows, filters = [], []
        for start in range(0, len(unit), _SLICE):
            x = unit[start : start + _SLICE] @ self.turn
            fits = [x[:, low:high] @ word.T for (low, high), word in zip(self.parts, self.book)]
            order = [np.argsort(-f, axis=1) for f in fits]
            fits = [np.take_along_axis(f, o, axis=1) for f, o in zip(fits, order)]
            best = np.cumsum([f[:, 0] for f in fits][::-1], axis=0)[::-1]
            row, told, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
            # Less by more than the rounding of sums taken in another order.
            limit = np.minimum(self.threshold, self._own(fits)) - 1e-12
            for k, (f, o) in enumerate(zip(fits, order)):
                lift = best[k + 1][row] if k + 1 < self.blocks else 0.0
                need = limit[row] - told - lift
                # Words stand by how well they fit, so the good ones are the first ones.
                many = (f[row] >= need[:, None]).sum(axis=1)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, told, name = (np.repeat(y, many) for y in (row, told, name))
                told = told + f[row, place]
                name = name * self.words + o[row, place]
            rows.append(row + start)
            filters.append(name)
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(filters)


def _threshold(d: int, share: float) -> float:
    """The inner product that a share of random unit vectors exceeds with a given one."""
    angle = np.linspace(0, math.pi, 200_001)
    told = np.cumsum(np.sin(angle) ** max(d - 2, 0))
    place = int(np.searchsorted(told / told[-1], min(share, 1.0)))
    return -2.0 if share >= 1 else float(np.cos(angle[place]))


def _recall(code: Code, u: np.ndarray, v: np.ndarray) -> float:
    """Share of pairs of rows that have a filter in common."""
    met, all_ = 0, np.int64(code.words**code.blocks)
    for low in range(0, len(u), 500):
        lists = []
        for side in (u, v):
            row, name = code.decode(side[low : low + 500])
            lists.append(row * all_ + name)
        met += len(np.unique(np.intersect1d(*lists, assume_unique=True) // all_))
    return met / len(u)


def code_for(d: int, rows: int, similarity: float = SIMILARITY) -> Code:
    """The finest code in which near pairs still share a filter.

    Finer ones let fewer far vectors meet; ``rows`` is how many vectors there are. Recall
    is tried on random pairs of exactly the least cosine: the rotation makes any given
    pair such a random one. In few dimensions caps cannot be both narrow and wider than
    the pairs; the code gets coarser then, down to one filter that holds everything.
    """
    random = np.random.default_rng(d)
    u, v = random.standard_normal((2, 4000, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= np.einsum("id,id->i", u, v)[:, None] * u
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    v = similarity * u + math.sqrt(1 - similarity**2) * v
    finest = LISTS[0] ** 2 * max(rows, 1) / STRANGERS
    room = max(1, min(5, d // 8)) if d > 2 else 0
    while room and finest > 4 * LISTS[0]:
        blocks = min(room, max(1, math.ceil(math.log(finest) / math.log(WORDS))))
        words = min(WORDS, math.ceil(finest ** (1 / blocks)))
        for least in LISTS:
            if least * 4 > words**blocks:
                break
            code = Code(d, blocks, words, least, least / 2 / words**blocks)
            found = _recall(code, u[:500], v[:500])
            if found >= 0.99 and _recall(code, u, v) >= RECALL:
                return code
            if found < 0.9:
                break
        finest = min(finest, float(words**blocks)) / 8
    return Code(d, 1, 1, 1, 1.0)


def _usable(vector: Column) -> Column:
    """Not missing, not zero, all components present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """The rows with ``vec`` as bytes of its own element type."""
    dtype = "<f4" if kind == "array<float>" else "<f8"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            # Minus zero is zero.
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype) + np.zeros(1, dtype)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)) if len(column) else [0]
            vec = pa.array([x.tobytes() for x in np.split(flat, ends[:-1])][: len(column)], pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), vec], ["vec_id", "label", "vec"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(work, f"vec_id {types['vec_id']}, label {types['label']}, vec binary")


def _units(vectors: list[bytes], dtype: str, d: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(vectors), dtype).reshape(-1, d).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component; ``linked`` is a symmetric matrix."""
    first = np.arange(len(linked))
    while True:
        least = np.where(linked, first[None, :], len(first)).min(axis=1, initial=len(first))
        now = np.minimum(first, least)
        now = now[now]
        if (now == first).all():
            return first
        first = now


def _met(nodes: np.ndarray, units: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], side: np.ndarray, own: int, similarity: float):
    """Links of one filter's nodes that no smaller filter of both has, per node, and the
    first node of each one's component.

    ``side`` tells the blocks apart where only nodes of different ones are compared.
    """
    linked = units @ units.T >= similarity
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    counted = linked.copy()
    some = np.flatnonzero(linked.any(axis=1))
    smaller = [lists[i][lists[i] < own] for i in some.tolist()]
    names, place = np.unique(np.concatenate(smaller), return_inverse=True)
    row = np.repeat(np.arange(len(some)), [len(x) for x in smaller])
    for low in range(0, len(names), 2 * _SLICE):
        holds = np.zeros((len(some), 2 * _SLICE), np.float32)
        here = (place >= low) & (place < low + 2 * _SLICE)
        holds[row[here], place[here] - low] = 1
        counted[np.ix_(some, some)] &= holds @ holds.T == 0
    return counted @ copies, nodes[_forest(linked)]


def near_duplicates(rows: DataFrame, id_name: str, vector: str, label: str, similarity: float = SIMILARITY) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Vectors link if their labels are equal and their cosine is ``similarity`` or more.
    ``n_links`` counts the identifiers linked directly, equal vectors included;
    ``component_id`` is the smallest identifier that links lead to, and ``kept`` tells
    that it is the row's own. Rows without a label, and those whose vector is missing,
    zero, empty or holds a missing or non-finite component, link with nothing, and
    neither do vectors of different lengths nor rows without an identifier; these rows
    come back alone, without links and kept. A row that repeats identifier, label and
    vector comes back once. The same identifier with another vector is another vector.
    No rows give none. Other columns are ignored.
    """
    kind = dict(rows.dtypes)[vector]
    dtype, width = ("<f4", 4) if kind == "array<float>" else ("<f8", 8)
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    known = rows.select(F.col(id_name).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))
    alone = known.where(~F.coalesce(fine, F.lit(False))).distinct()
    vectors = settle(_packed(known.where(fine), kind).distinct(), "vectors")
    nodes = vectors.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    # The same identifier may stand for several vectors, so nodes need a number of their own.
    nodes = settle(nodes.withColumn("number", F.monotonically_increasing_id()), "nodes")
    size = F.octet_length("vec")
    lengths = nodes.groupBy((size / width).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()
    codes = {r["d"]: code_for(r["d"], r["n"], similarity) for r in lengths}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(at))
                row, name = codes[d].decode(_units(part.column("vec").to_pylist(), dtype, d))
                picked = [part.column(c).take(pa.array(row)) for c in ("number", "label", "d")]
                yield pa.record_batch([*picked, pa.array(name, pa.int64())], ["number", "label", "d", "name"])

    label_kind = dict(nodes.dtypes)["label"]
    listed = nodes.select("number", "label", (size / width).cast("int").alias("d"), "vec")
    listed = listed.mapInArrow(decode, f"number long, label {label_kind}, d int, name long")
    # Filters of different labels that get the same number only meet in vain: see below.
    filters = settle(listed.select("number", F.xxhash64("label", "d", "name").alias("filter")), "filters")
    shared = filters.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    own = filters.join(shared, "filter").groupBy("number")
    own = own.agg(F.collect_list(F.struct("filter", "n")).alias("own"))
    meeting = settle(nodes.join(own, "number").withColumn("filters", F.transform("own", lambda x: x["filter"])), "meeting")
    many = F.ceil(F.col("one.n") / BLOCK).cast("int")
    dealt = meeting.select("number", "label", "vec", "copies", "filters", F.explode("own").alias("one"))
    dealt = dealt.select("*", many.alias("many"), F.pmod(F.xxhash64("number"), many).cast("int").alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
    pair = F.struct(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.select("number", F.xxhash64("label", size).alias("class"), "vec", "copies", "filters", F.col("one.filter").alias("filter"), pair.alias("pair"), "block")
    met = settle(dealt, "met")
    parts = max(1, math.ceil(met.count() / ROWS))

    def verify(rows: pa.Table) -> pa.Table:
        number, owner = rows.column("number").to_numpy(), rows.column("filter").to_numpy()
        key, block = rows.column("class").to_numpy(), rows.column("block").to_numpy()
        low, high = (rows.column("pair").combine_chunks().field(i).to_numpy() for i in (0, 1))
        copies = rows.column("copies").to_numpy()
        lists = rows.column("filters").combine_chunks()
        stops, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        stops = stops - stops[0]
        vec = rows.column("vec")
        order = np.lexsort((number, key, high, low, owner))
        names = np.stack((owner, low.astype(np.int64), high.astype(np.int64), key))[:, order]
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        found: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        for at in np.split(order, cuts):
            if len(at) < 2:
                continue
            held = [vec[i].as_py() for i in at.tolist()]
            units = _units(held, dtype, len(held[0]) // width)
            side = (block[at] != low[at]).astype(int) if low[at[0]] != high[at[0]] else np.zeros(len(at), int)
            told = _met(number[at], units, copies[at], [flat[stops[i] : stops[i + 1]] for i in at.tolist()], side, owner[at[0]], similarity)
            if told is None:
                continue
            for i, n, to in zip(number[at].tolist(), told[0].tolist(), told[1].tolist()):
                if n:
                    found[i] = found.get(i, 0) + n
                if i != to:
                    edges.add((i, to))
        out = [(i, n, None) for i, n in found.items()] + [(i, 0, to) for i, to in edges]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["number", "links", "to"])

    part = F.pmod(F.xxhash64("filter", "pair"), F.lit(parts)).alias("part")
    verified = met.groupBy(part).applyInArrow(verify, "number long, links long, to long")
    verified = settle(verified, "verified")
    links = verified.groupBy("number").agg(F.sum("links").alias("links"))
    groups = components(verified.where("to IS NOT NULL").select(F.col("number").alias("u"), F.col("to").alias("v")))
    named = groups.join(nodes.select(F.col("number").alias("node"), F.col("node").alias("least")), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = named.join(least, "component").select(F.col("node").alias("number"), "component_id")
    told = nodes.join(links, "number", "left").join(placed, "number", "left").where("copies > 1 OR links > 0")
    told = told.select(
        F.sha2("vec", 256).alias("digest"), "label",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    every = vectors.select("vec_id", "label", F.sha2("vec", 256).alias("digest")).join(told, ["label", "digest"], "left")
    every = every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return every.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
