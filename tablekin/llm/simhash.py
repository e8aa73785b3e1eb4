"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint has one bit per position of the 64-bit shingle hashes, set if over half
of the hashes set it. Two fingerprints link if they differ in at most ``radius`` bits;
documents of linked fingerprints form groups.

Two fingerprints within ``radius`` agree in one of ``radius + 1`` bands of bits, so
each (band, value) is a shard. Its fingerprints make a BK-tree: the children of a node
are keyed by their Hamming distance to it, and a search follows only the edges whose
key is within the radius of the distance found. Shards of more than ``leaf``
fingerprints are cut into blocks, and the tree of one block goes with each block of
searchers to a task of its own: no task holds more than two blocks of a shard, whatever
a third of all documents look like. Equal fingerprints are one from the start. Tasks
return a spanning forest of the links they find instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import is_small, shuffle_partitions, texts, word_blocks
from tablekin.llm.graph import components
from tablekin.session import settle

SEED = 42
LEAF = 1024

#: One text in so many tells which shingles are common, and how many of these are kept.
SAMPLE, MOST_COMMON = 8, 200_000


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a lower-cased text, repeats included, in parts.

    A text of fewer words than ``width`` has one shingle, all its words; a text
    without words has none.
    """
    digest, held, any_out = xxhash.xxh64_intdigest, [], False
    for words in word_blocks(text.lower()):
        words = held + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
            stops = ends[width - 1 :].tolist()
            yield np.fromiter(
                (digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)
            )
            any_out = True
        held = words[-(width - 1) :] if width > 1 else []
    if held and not any_out:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of a text; zero if it has no words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs``; ``fp`` holds the 64 bits as a long.

    Missing and empty texts have the fingerprint zero. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in texts(batch.column("text"))], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, fp long")


def bk_links(
    shard: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked rows: a BK-tree per shard, searched by all rows of the shard.

    All trees grow level by level at once: every key stands at one node of its tree;
    the first key to come to a (node, distance) becomes the child there, the rest go
    down to it. The rows that ask then search the trees of their shards in the same
    way. Equal keys hang in a chain, at distance 0 from each other.
    """
    members = np.flatnonzero(in_tree)
    n = len(fp)
    root_of: np.ndarray = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
    first = members[np.unique(shard[members], return_index=True)[1]]
    root_of[shard[first]] = first
    waiting = np.setdiff1d(members, first, assume_unique=True)
    at = root_of[shard[waiting]]
    up, key, child = [], [], []
    while len(waiting):
        gap = np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
        edge = at * 65 + gap
        edges, head, back = np.unique(edge, return_index=True, return_inverse=True)
        up.append(edges // 65)
        key.append(edges % 65)
        child.append(waiting[head])
        at = waiting[head][back]
        rest = np.ones(len(waiting), bool)
        rest[head] = False
        waiting, at = waiting[rest], at[rest]
    ups, keys, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (up, key, child))
    slots = ups * 65 + keys
    order = np.argsort(slots)
    slots, children = slots[order], children[order]
    who = np.flatnonzero(asks & (root_of[shard] >= 0))
    at = root_of[shard[who]]
    left, right = [], []
    while len(who):
        gap = np.bitwise_count(fp[who] ^ fp[at]).astype(np.int64)
        hit = (gap <= radius) & (who != at)
        left.append(who[hit])
        right.append(at[hit])
        low = np.searchsorted(slots, at * 65 + np.maximum(gap - radius, 0))
        high = np.searchsorted(slots, at * 65 + np.minimum(gap + radius, 64), side="right")
        count = high - low
        total = int(count.sum())
        within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        who, at = np.repeat(who, count), children[np.repeat(low, count) + within]
    return (np.concatenate(left), np.concatenate(right)) if left else (members[:0], members[:0])


class Groups:
    """Sets of identifiers that grow together."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.top(x) != self.top(y)

    def join(self, x: int, y: int) -> None:
        p, q = self.top(x), self.top(y)
        self.parent[max(p, q)] = min(p, q)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links join parts that the links before them left apart."""
    groups, keep = Groups(), np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if groups.apart(x, y):
            groups.join(x, y)
            keep[i] = True
    return keep


def _band(fp: Column, band: int, bands: int) -> Column:
    low, high = 64 * band // bands, 64 * (band + 1) // bands
    return F.shiftrightunsigned(F.shiftleft(fp, 64 - high), 64 - (high - low))


def dealt(keyed: DataFrame, by: list[str], leaf: int, groups: int, apart: str | None = None) -> DataFrame:
    """Rows of shards, with shards of more than ``leaf`` rows cut into pairs of blocks.

    Adds ``shard``, ``part`` (a bounded number of shards together), ``in_tree`` and
    ``asks``: block i searches the trees of the blocks j >= i, and each pair (i, j) is
    a shard of its own. Shards of a single row are left out, and those that have one
    value of ``apart`` if it is given. ``node`` decides the block.
    """
    sized = keyed.groupBy(*by).agg(F.count("*").alias("count"), *([F.min(apart) < F.max(apart)] if apart else []))
    sized = sized.toDF(*by, "count", *(["mixed"] if apart else [])).where("count > 1 and mixed" if apart else "count > 1")
    sized = sized.select(*by, F.ceil(F.col("count") / leaf).cast("int").alias("blocks"))
    placed = keyed.join(sized, by).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shard = F.xxhash64(*by, F.least("own", "other"), F.greatest("own", "other"))
    return placed.select(
        *keyed.columns, shard.alias("shard"), F.pmod(shard, groups).cast("int").alias("part"),
        (F.col("own") >= F.col("other")).alias("in_tree"), (F.col("own") <= F.col("other")).alias("asks"),
    )


def _found(part: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked rows of a part."""
    _, shard = np.unique(part.column("shard").to_numpy(), return_inverse=True)
    in_tree, asks = (part.column(c).to_numpy(zero_copy_only=False) for c in ("in_tree", "asks"))
    return bk_links(shard, part.column("fp").to_numpy().view(np.uint64), in_tree, asks, radius)


def links(nodes: DataFrame, radius: int = 3, leaf: int = LEAF) -> DataFrame:
    """``(u, v)`` links that connect every two nodes within ``radius`` bits, in steps.

    ``nodes`` has one row ``(node, fp)`` per different fingerprint. What is returned
    spans the same groups as all pairs would.
    """
    bands = radius + 1
    groups = max(4 * shuffle_partitions(nodes.sparkSession), math.ceil(nodes.count() * bands / 50_000))
    each = [F.struct(F.lit(b).alias("band"), _band(F.col("fp"), b, bands).alias("value")) for b in range(bands)]
    keyed = nodes.select("node", "fp", F.inline(F.array(*each)))

    def work(part: pa.Table) -> pa.Table:
        node = part.column("node").to_numpy()
        a, b = _found(part, radius)
        keep = spanning(node[a], node[b])
        return pa.table({"u": node[a][keep], "v": node[b][keep]})

    rows = dealt(keyed, ["band", "value"], leaf, groups).select("node", "fp", "shard", "part", "in_tree", "asks")
    return rows.groupBy("part").applyInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links, itself
    included. Texts that are missing, empty or without words share the fingerprint
    zero and are linked like any other. Rows without a doc_id get a fingerprint and no
    component; rows that repeat a doc_id each count with their own text. An empty
    table gives no rows. Further columns of ``docs`` are ignored.
    """
    prints = settle(fingerprints(docs, width), "fingerprints")
    nodes = settle(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes"
    )
    found = settle(components(links(nodes, radius)), "components")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


_FACTORS = tuple(2 * int(x) + 1 for x in np.random.default_rng(77).integers(0, 1 << 62, 5))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 32-bit hashes of the different shingles of a text."""
    parts = [(h >> np.uint64(32)).astype(np.uint32) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def _different(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles of one text in ``SAMPLE``, and how many
    of these have each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("text")):
                yield pa.record_batch([pa.array(_different(t, width).view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SAMPLE)) == 0).select("text")
    counted = some.mapInArrow(work, "token long").groupBy("token").count().where("count > 2")
    found = counted.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
    token, count = found.column("token").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def _prefix(held: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, as many as a set this similar cannot all lack.

    All sets are ordered by the same counts and then by hash, so that the first shingle
    two similar sets share is in the prefix of both. The counts only make it rare.
    """
    token, count = common
    often = np.zeros(len(held), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, held), len(token) - 1)
        often = np.where(token[at] == held, count[at], 0)
    keep = len(held) - math.ceil(similarity * len(held) - 1e-9) + 1 if len(held) else 0
    return held[np.lexsort((held, often))[:keep]]


def _sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(doc_id, digest, fp, least, size, prefix)``: a digest of the words, and of the set
    of shingles the fingerprint, the smallest hash under each of a few hash functions,
    the size and the rarest ones."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, width))

    def one(text: bytes) -> tuple[bytes, int, list[int], int, np.ndarray]:
        digest = xxhash.xxh3_128()
        for words in word_blocks(text.lower()):
            digest.update(b" ".join(words) + b" ")
        held = _different(text, width)
        ones, least = np.zeros(64, np.int64), [(1 << 64) - 1] * len(_FACTORS)
        for low in range(0, len(held), 1 << 16):
            h = held[low : low + (1 << 16)]
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            for k, factor in enumerate(_FACTORS):
                mixed = h * np.uint64(factor)
                least[k] = min(least[k], int(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).min()))
        fp = int.from_bytes(np.packbits(2 * ones > len(held)).tobytes(), "big")
        return digest.digest(), fp, least, len(held), _prefix(held, similarity, common.value)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t) for t in texts(batch.column("text"))]
            fps = np.array([r[1] for r in rows], np.uint64).view(np.int64)
            least = np.array([r[2] for r in rows], np.uint64).reshape(-1, len(_FACTORS)).view(np.int64)
            ends = np.cumsum([0] + [len(r[4]) for r in rows])
            prefix = np.concatenate([np.empty(0, np.uint64)] + [r[4] for r in rows]).view(np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array(fps),
                    pa.array(least.tolist(), pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix)),
                ],
                ["doc_id", "digest", "fp", "least", "size", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(work, "doc_id long, digest binary, fp long, least array<long>, size long, prefix array<long>")


def _shared(part: pa.Table, similarity: float) -> pa.Table:
    """``(u, v, p, q)``: pairs of nodes of different components p and q that share a
    shingle so early that their sets can be similar."""
    part = part.take(pa.array(np.argsort(part.column("shard").to_numpy(), kind="stable")))
    shard, node, top, size, pos = (part.column(c).to_numpy() for c in ("shard", "node", "top", "size", "pos"))
    tree, asks = (part.column(c).to_numpy(zero_copy_only=False) for c in ("in_tree", "asks"))
    after = np.searchsorted(shard, shard, side="right") - np.arange(len(shard)) - 1
    upto, low, out = np.concatenate(([0], np.cumsum(after))), 0, [np.empty((0, 4), np.int64)]
    while low < len(shard):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + (1 << 20), side="right")) - 1)
        a = np.repeat(np.arange(low, high), after[low:high])
        b = a + 1 + np.arange(len(a)) - (upto[a] - upto[low])
        need = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9)
        fits = (top[a] != top[b]) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need)
        fits &= (asks[a] & tree[b]) | (asks[b] & tree[a])
        a, b = a[fits], b[fits]
        a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
        out.append(np.unique(np.stack([node[a], node[b], top[a], top[b]], axis=1), axis=0))
        low = high
    found = np.unique(np.concatenate(out), axis=0)
    return pa.table(dict(zip(("u", "v", "p", "q"), found.T.copy())))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 20, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, component_id)`` of every row that has a doc_id.

    Two documents link if the sets of their shingles have at least this Jaccard
    similarity; a component is named by its smallest doc_id. Here shards are the
    documents that share the smallest hash of their shingles under one of five hash
    functions, which for a pair of similarity s is missed with a chance of (1 - s)^5.
    BK-trees find the pairs of a shard within a radius that pairs of similarity 0.8
    mostly reach, and the shingle sets of these decide. What this misses is found by the
    prefixes of the sets: pairs of documents that are in different components so far and
    share one of their rarest shingles, of which similar sets cannot lack all. Texts of
    equal words are one from the start; texts without words are equal.
    """
    sketches = settle(_sketches(docs, width, similarity), "sketches")
    nodes = settle(
        sketches.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("fp", "least", "size", "prefix")]),
        "nodes",
    )
    keyed = nodes.select("node", "fp", "least", F.posexplode("least").alias("slot", "value"))
    groups = max(4 * shuffle_partitions(docs.sparkSession), math.ceil(nodes.count() / 10_000))

    def near(part: pa.Table) -> pa.Table:
        a, b = _found(part, radius)
        rows = np.zeros(part.num_rows, bool)
        rows[a] = rows[b] = True
        return part.filter(pa.array(rows))

    slim = dealt(keyed, ["slot", "value"], leaf, groups)
    kept = ["node", "fp", "least", "slot", "shard", "part", "in_tree", "asks"]
    schema = "node long, fp long, least array<long>, slot int, shard long, part int, in_tree boolean, asks boolean"
    candidates = settle(slim.select(kept).groupBy("part").applyInArrow(near, schema), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).tobytes() for t in texts(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], ["id", "shingles"])

    wanted = candidates.select(F.col("node").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    # Of a doc_id that repeats with other texts, any one text stands for it.
    shingles = rows.mapInArrow(sets, "id long, shingles binary")

    def verify(part: pa.Table) -> pa.Table:
        node, slot = part.column("node").to_numpy(), part.column("slot").to_numpy()
        least = np.array(part.column("least").to_pylist(), np.int64)
        held = [np.frombuffer(x, np.uint32) for x in part.column("shingles").to_pylist()]
        fp = part.column("fp").to_numpy().view(np.uint64)
        a, b = _found(part, radius)
        # A pair that shares several keys is looked at under the first of them alone.
        first = (least[a] == least[b]).argmax(axis=1) == slot[a] if len(a) else np.empty(0, bool)
        sizes = np.array([len(x) for x in held], np.int64)
        could = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
        a, b = a[first & could & (node[a] != node[b])], b[first & could & (node[a] != node[b])]
        order = np.argsort(np.bitwise_count(fp[a] ^ fp[b]), kind="stable")
        joined, out = Groups(), []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            u, v = int(node[x]), int(node[y])
            if joined.apart(u, v):
                both = len(np.intersect1d(held[x], held[y], assume_unique=True))
                if both >= similarity * (sizes[x] + sizes[y] - both):
                    joined.join(u, v)
                    out.append((u, v))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    armed = candidates.join(shingles.hint("merge"), F.col("node") == F.col("id")).select(*kept, "shingles")
    found = armed.groupBy("part").applyInArrow(verify, "u long, v long")
    named = sketches.join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    # Rows of one doc_id belong together, whatever their texts.
    repeated = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    repeated = repeated.where("u <> v").select("u", "v")
    grouped = settle(components(found.unionByName(repeated)), "components")
    tops = nodes.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("top"), "size", "prefix")
    rare = tops.select("node", "top", "size", F.posexplode("prefix").alias("pos", "token"))
    rare = dealt(rare, ["token"], leaf, groups, "top")
    missed = rare.groupBy("part").applyInArrow(lambda part: _shared(part, similarity), "u long, v long, p long, q long")
    missed = settle(missed.distinct(), "missed")
    ends = missed.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    ends = F.broadcast(ends) if is_small(ends, 100_000) else ends.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ends, "doc_id", "left_semi")
    held = settle(rows.mapInArrow(sets, "id long, shingles binary"), "shingles")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in ("x", "y"))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            alike = [n >= similarity * (len(x) + len(y) - n) for x, y, n in zip(left, right, both)]
            yield pa.record_batch([batch.column("p"), batch.column("q")], ["u", "v"]).filter(pa.array(alike, pa.bool_()))

    pairs = missed.join(held.select(F.col("id").alias("u"), F.col("shingles").alias("x")), "u")
    pairs = pairs.join(held.select(F.col("id").alias("v"), F.col("shingles").alias("y")), "v")
    above = components(pairs.select("p", "q", "x", "y").mapInArrow(decide, "u long, v long"))
    above = settle(above.select(F.col("node").alias("component"), F.col("component").alias("above")), "components")
    named = named.join(grouped, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return named.join(above, "component", "left").select("doc_id", F.coalesce("above", "component").alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of similar ones left.

    The smallest doc_id of a group stays, and of rows that repeat it any one. Rows
    without a doc_id are in no group and stay. What goes grows with the table, so it is
    joined by a shuffle at every size.
    """
    grouped = settle(similar(docs, width, similarity), "similar")
    gone = grouped.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    rest = docs.join(gone.hint("merge"), docs["doc_id"] == F.col("__gone"), "left_anti")
    twice = settle(
        grouped.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")),
        "repeated",
    )
    if not twice.head(1):
        return rest
    single = rest.join(twice, rest["doc_id"] == F.col("__twice"), "left_anti")
    return single.unionByName(rest.join(twice, rest["doc_id"] == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"]))


def hexed(fp: Column) -> Column:
    """Sixteen lower-case hex digits of a 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
