"""Documents in compressed chunks, and hashes of their words in buckets.

Operators that compare every word of a corpus with every other send each different hash
of a chunk once to the bucket that its upper bits name. How often a chunk repeats
something adds nothing. A hash may go as a row of its own (:func:`rows`), so that rows
grow with the text alone, or packed with those of the chunk and bucket (:func:`narrow`),
which takes less disk while buckets are few, but makes rows as many as chunks times
buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import texts, word_blocks

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 3 << 20


def pack(docs: DataFrame, mark: str | None = None) -> DataFrame:
    """``(ids, marks, lengths, texts, size, chunk)``: consecutive documents together.

    ``mark`` names a column of flags to keep. Chunk numbers hold only for one
    evaluation: write the chunks before they are used.
    """

    def chunk(ids: list, marks: list, held: list[bytes]) -> pa.RecordBatch:
        joined = b"".join(held)
        return pa.record_batch(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([marks], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in held]], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=6).compress(joined)], pa.binary()),
                pa.array([len(joined)], pa.int64()),
            ],
            ["ids", "marks", "lengths", "texts", "size"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, held, size = [], [], [], 0
        for batch in batches:
            columns = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), texts(batch.column("text"))
            for i, m, t in zip(*columns):
                ids.append(i)
                marks.append(m)
                held.append(t)
                size += len(t) + 64
                if size >= CHUNK:
                    yield chunk(ids, marks, held)
                    ids, marks, held, size = [], [], [], 0
        if ids:
            yield chunk(ids, marks, held)

    flag = F.coalesce(F.col(mark), F.lit(False)) if mark else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long"), "text", flag.alias("mark"))
    packed = rows.mapInArrow(work, "ids array<long>, marks array<boolean>, lengths array<long>, texts binary, size long")
    return packed.withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """The texts of a chunk and the hashes of their words, one after another."""

    def __init__(self, row: dict, lower: bool = False):
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(row["size"], 1))
        self.name, self.ids, self.marks = row["chunk"], row["ids"], np.array(row["marks"], bool)
        self.texts, at = [], 0
        for n in row["lengths"]:
            self.texts.append(data[at : at + n])
            at += n
        hashes, counts = [], []
        for t in self.texts:
            n = 0
            for words in word_blocks(t.lower() if lower else t):
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
                n += len(words)
            counts.append(n)
        self.counts = np.array(counts, np.int64)
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(counts)), self.counts)

    def inside(self, n: int) -> np.ndarray:
        """Positions at which ``n`` words of one document start."""
        end = (self.starts + self.counts)[self.doc]
        return np.flatnonzero(np.arange(len(self.words)) + n <= end)


def _factors(n: int, lane: int) -> np.ndarray:
    return np.random.default_rng(1000 + lane).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(words: np.ndarray, n: int, lane: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes; lanes hash independently."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k, factor in enumerate(_factors(n, lane)):
        out += words[k : len(words) - n + 1 + k] * factor
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash; the lower half tells apart within it."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each run of equal buckets."""
    if len(bucket):
        cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        yield from zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())


def rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Columns of equal length as batches of bounded size."""
    table = pa.table({name: pa.array(values) for name, values in columns.items()})
    yield from table.to_batches(max_chunksize=1 << 16)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, places in it where a new key begins, and the number
    of each key's group."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    new = np.concatenate(([True], held[1:] != held[:-1])) if len(keys) else np.empty(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def narrow(values: np.ndarray, low: int = 3) -> bytes:
    """Sorted numbers: how many have each high byte, then their ``low`` lower bytes."""
    high = np.bincount((values >> np.uint64(8 * low)).astype(np.int64), minlength=256).astype("<u4")
    return high.tobytes() + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def wide(data: bytes, low: int = 3) -> np.ndarray:
    """The numbers that :func:`narrow` wrote."""
    high = np.repeat(np.arange(256, dtype=np.uint64), np.frombuffer(data, "<u4", 256))
    out = np.zeros((len(high), 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, offset=1024).reshape(-1, low)
    return out.view("<u8").ravel() | (high << np.uint64(8 * low))
