"""Exact repeats of many words across documents, by fixed-block anchors.

A repeat of ``width`` words holds, wherever its text is cut into blocks of half that
size, one whole block. So only the non-overlapping blocks of each document are indexed,
every rolling window of a block's size is a probe, and a probe that meets a block of
another document marks the place. Marks are extended to windows of the full width,
whose hashes then find the smallest doc_id that has each of them; adjacent windows make
up the maximal repeats.

Documents travel in chunks of a few megabytes. A chunk sends each of its different
probes once, a row of two numbers, and gets those back that are hit; the same holds for
full windows. So a passage that a third of all documents share is one row a chunk in
every exchange, rows sent are at most as many as words, and no text leaves its chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.chunks import Chunk, bucket_of, numbered, pack, rolling, rows
from tablekin.llm.common import word_blocks
from tablekin.session import settle

WIDTH = 13

#: Bytes of text whose probes or windows meet in one bucket, and buckets at least.
PROBED, MATCHED, BUCKETS = 12 << 20, 24 << 20, 64


class _Repeats(Chunk):
    """Where windows of either size stand in a chunk."""

    def __init__(self, row: dict, width: int):
        super().__init__(row)
        self.width, self.block = width, (width + 1) // 2

    def probes(self, buckets: int) -> tuple[np.ndarray, ...]:
        """Different probes in rising order, each a bucket above 31 bits of a hash and the
        bit of blocks; the number of each position's probe, its position, and whether
        each probe is hit at home."""
        at = self.inside(self.block)
        hashes = rolling(self.words, self.block, 0)[at]
        bucket = bucket_of(hashes, buckets)
        short = (bucket << np.uint64(31)) | (hashes & np.uint64(0x7FFFFFFF))
        order, first, number = numbered(short)
        last = np.append(first[1:], len(order)) - 1
        is_block = np.zeros(len(first), bool)
        is_block[number[(at - self.starts[self.doc[at]]) % self.block == 0]] = True
        doc = self.doc[at][order]
        home = is_block & (doc[first] != doc[last])
        probe = (short[order][first] << np.uint64(1)) | is_block.astype(np.uint64)
        return probe.astype(np.int64), number, at, home

    def windows(self, hit: np.ndarray, number: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Windows of full width around hits: bucket, hash and smallest doc_id of each
        different one in the order they are sent, and number, position and doc_id of all."""
        marked = np.zeros(len(self.words) + self.width, np.int64)
        marked[at[hit[number]]] = 1
        total = np.concatenate(([0], np.cumsum(marked)))
        start = self.inside(self.width)
        start = start[total[start + self.width - self.block + 1] > total[start]]
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        named = np.array([i is not None for i in self.ids], bool)
        start = start[named[self.doc[start]]]
        hashes = rolling(self.words, self.width, 1)[start]
        bucket = bucket_of(rolling(self.words, self.width, 2)[start], buckets).astype(np.int64)
        doc_id = ids[self.doc[start]]
        order = np.lexsort((doc_id, hashes, bucket))
        b, h = bucket[order], hashes[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (h[1:] != h[:-1]))) if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return b[first], h[first], doc_id[order][first], number, start, doc_id

    def keep(self, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Words, removed words and the rest of the text of each document."""
        for t, at, n in zip(self.texts, self.starts.tolist(), self.counts.tolist()):
            off = gone[at : at + n]
            removed = int(off.sum())
            words = [w for block in word_blocks(t) for w in block] if n else []
            if removed:
                words = [words[i] for i in np.flatnonzero(~off).tolist()]
            yield n, removed, b" ".join(words)


def _replied(replies: pa.Table, kind: int) -> np.ndarray:
    """The entries of one kind that were sent back."""
    entry = replies.column("entry").to_numpy()
    return entry[replies.column("kind").to_numpy() == kind]


_REPLY = "chunk long, kind int, entry long"


def _reply(table: pa.Table, kind: int, entry: str, said: np.ndarray) -> pa.Table:
    """The rows of which something is to be said, back to their chunks."""
    kept = table.select(["chunk", entry]).filter(pa.array(said))
    kinds = pa.array(np.full(kept.num_rows, kind, np.int32))
    return pa.table({"chunk": kept.column("chunk"), "kind": kinds, "entry": kept.column(entry)})


def _hits(table: pa.Table) -> pa.Table:
    """Probes of a bucket that meet a block across two chunks."""
    probe, chunk = table.column("probe").to_numpy(), table.column("chunk").to_numpy()
    order, first, number = numbered(probe >> 1)
    block = np.maximum.reduceat((probe & 1)[order], first).astype(bool)
    source = chunk[order]
    hit = block & (np.minimum.reduceat(source, first) != np.maximum.reduceat(source, first))
    return _reply(table, 1, "probe", hit[number])


def _smaller(table: pa.Table) -> pa.Table:
    """Windows of a bucket that another chunk has under a smaller doc_id."""
    doc_id = table.column("doc_id").to_numpy()
    order, first, number = numbered(table.column("window").to_numpy())
    least = np.minimum.reduceat(doc_id[order], first)
    return _reply(table, 2, "entry", least[number] < doc_id)


def _probes(chunks: DataFrame, width: int, buckets: int) -> DataFrame:
    """``(chunk, bucket, probe)``: each different probe of each chunk once."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent, *_ = _Repeats(row, width).probes(buckets)
                bucket = (sent >> 32).astype(np.int32)
                yield from rows({"chunk": np.full(len(sent), row["chunk"]), "bucket": bucket, "probe": sent})

    return chunks.mapInArrow(probe, "chunk long, bucket int, probe long")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` of every row: the words of no repeat.

    A word goes if it lies in ``width`` consecutive words of its document that also
    start in a document of a smaller doc_id; all are judged on the input. The words
    left are joined by one space. Missing and empty texts have no words and an empty
    rest. Rows without a doc_id lose nothing and take nothing from others; rows that
    repeat a doc_id do not count as each other's repeats. An empty table gives no rows.
    Further columns are ignored.
    """
    chunks = settle(pack(docs), "chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    probed, matched = (max(BUCKETS, math.ceil(size / each)) for each in (PROBED, MATCHED))

    replies = settle(_probes(chunks, width, probed).groupBy("bucket").applyInArrow(_hits, _REPLY), "hits")

    def opened(group: pa.Table, said: pa.Table) -> tuple:
        row = group.to_pylist()[0]
        chunk = _Repeats(row, width)
        sent, number, at, hit = chunk.probes(probed)
        hit[np.searchsorted(sent, _replied(said, 1))] = True
        return row["chunk"], chunk, chunk.windows(hit, number, at, matched)

    def window(group: pa.Table, said: pa.Table) -> pa.Table:
        name, _, (bucket, hashes, doc_id, *_) = opened(group, said)
        return pa.table(
            {
                "chunk": pa.array(np.full(len(bucket), name, np.int64)),
                "bucket": pa.array(bucket.astype(np.int32)),
                "window": pa.array(hashes.view(np.int64)),
                "doc_id": pa.array(doc_id),
                "entry": pa.array(np.arange(len(bucket))),
            }
        )

    sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        window, "chunk long, bucket int, window long, doc_id long, entry long"
    )
    smaller = settle(sent.groupBy("bucket").applyInArrow(_smaller, _REPLY), "smaller")

    def remove(group: pa.Table, said: pa.Table) -> pa.Table:
        _, chunk, (bucket, _, least, number, start, doc_id) = opened(group, said)
        elsewhere = np.zeros(len(bucket), bool)
        elsewhere[_replied(said, 2)] = True
        taken = start[elsewhere[number] | (doc_id > least[number])]
        step = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(step, taken, 1)
        np.add.at(step, taken + width, -1)
        kept = list(chunk.keep(np.cumsum(step)[:-1] > 0))
        return pa.table(
            {
                "doc_id": pa.array(chunk.ids, pa.int64()),
                "n_words": pa.array([r[0] for r in kept], pa.int64()),
                "n_removed": pa.array([r[1] for r in kept], pa.int64()),
                "text": pa.array([r[2] for r in kept], pa.binary()).cast(pa.string()),
            }
        )

    both = replies.unionByName(smaller)
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, text string"
    )

