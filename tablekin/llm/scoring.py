"""Documents by cross-entropy difference between two word bigram models.

The target model counts the documents marked as wanted, the background model counts all
documents. Both have the same order, smoothing and vocabulary, which is every word of the
corpus, so their losses differ by the data alone. A word's chance is a fixed mix of its
bigram's count by its predecessor's, which includes those that end a text, and of its
own smoothed share; the first word of a text has the latter alone. A document's score is its loss per
token under the target model less that under the background model; the lower, the more
it is like the target.

Nothing is cut off: all words and all bigrams of all documents are counted. Chunks send
each of their different words and bigrams once with its counts to the bucket of its
hash, and get the totals back where they differ from their own. The model so stays
spread over the buckets however large it is; no task holds more than a bucket's share.
A chunk sends a packed row to each bucket, so rows are as many as chunks times buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.chunks import Chunk, bucket_of, narrow, numbered, pack, rolling, runs, wide
from tablekin.llm.common import is_small
from tablekin.session import settle

#: Bytes of text whose n-grams meet in one bucket, and buckets of an order at least.
COUNTED, BUCKETS = 12 << 20, 64

#: Weight of the bigram share against the word share; count added to every word.
BIGRAM, ADDED = 0.6, 0.1

#: Marked documents that are broadcast; more of them are joined by a shuffle.
MOST_MARKED = 2_000_000

ORDERS = (1, 2)

#: Bits of a hash that tell n-grams of a bucket apart; a bucket's share of the text is
#: bounded, so about one n-gram in a million shares its count with another.
BITS = 40
TOLD_APART = np.uint64((1 << BITS) - 1)


class _Grams(Chunk):
    """Words and bigrams of a chunk; orders have buckets of their own."""

    def entries(self, buckets: int) -> list[tuple[np.ndarray, ...]]:
        """For each order: bucket, value, count and target count of the different
        n-grams in the order they are sent, positions of all, and the number of each.

        The places 2 and 3 are the counts of the background and the target model."""
        out = []
        for order in ORDERS:
            at = self.inside(order)
            hashes = rolling(self.words, order, 10 + order)[at]
            bucket = bucket_of(hashes, buckets)
            short = (bucket << np.uint64(BITS)) | (hashes & TOLD_APART)
            sort, first, number = numbered(short)
            marked = self.marks[self.doc[at]] if len(at) else np.empty(0, bool)
            own = short[sort][first]
            out.append(
                (
                    (own >> np.uint64(BITS)).astype(np.int64) + (order - 1) * buckets,
                    own & TOLD_APART,
                    np.bincount(number, minlength=len(first)),
                    np.bincount(number[marked], minlength=len(first)),
                    at,
                    number,
                )
            )
        return out


def _counts(values: np.ndarray) -> bytes:
    """Counts in one byte each; those above 254 follow in full."""
    large = values[values > 254]
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _counted(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


_REPLY = "chunk long, bucket int, every binary, target binary, different long, tokens long, wanted long"


def _totals(table: pa.Table) -> pa.Table:
    """Totals of each n-gram of a bucket, for each chunk as far as they differ from its
    own counts; the first row also has the sums of the bucket."""
    lists = [wide(x, BITS // 8 - 1) for x in table.column("grams").to_pylist()]
    sizes = [len(x) for x in lists]
    own = [
        np.concatenate([_counted(x, n) for x, n in zip(table.column(c).to_pylist(), sizes)]) for c in ("every", "target")
    ]
    _, first, number = numbered(np.concatenate(lists))
    answers = []
    for counts in own:
        total = np.bincount(number, counts, len(first))[number]
        differs = total != counts
        parts = []
        for low, n in zip(np.cumsum(sizes) - sizes, sizes):
            d = differs[low : low + n]
            parts.append(np.packbits(d).tobytes() + total[low : low + n][d].astype("<f4").tobytes())
        answers.append(pa.array(parts, pa.binary()))
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "every": answers[0],
            "target": answers[1],
            **{
                name: pa.array([int(value)] + [0] * (len(sizes) - 1), pa.int64())
                for name, value in (("different", len(first)), ("tokens", own[0].sum()), ("wanted", own[1].sum()))
            },
        }
    )


def _merge(own: np.ndarray, bucket: np.ndarray, said: dict[int, bytes]) -> np.ndarray:
    """Own counts, replaced by the totals that were sent back."""
    out = own.astype(np.float64)
    for b, low, high in runs(bucket):
        n, data = high - low, said[b]
        differs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8), count=n).astype(bool)
        part = out[low:high]
        part[differs] = np.frombuffer(data, "<f4", offset=(n + 7) // 8)
    return out


def losses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of every row.

    ``wanted`` holds the doc_ids of the target documents. Tokens are lower-cased words.
    Losses are nats per token; ``score`` is their difference. Missing and empty texts
    have no tokens, no losses and the score 0. Rows without a doc_id are background;
    rows that repeat a doc_id count each. If nothing is wanted, the target model knows
    no n-gram and gives every word the same chance. An empty table gives no rows.
    Further columns are ignored.
    """
    marked = wanted.select(F.col("doc_id").alias("__wanted")).where("__wanted is not null").distinct()
    hint = F.broadcast if is_small(marked, MOST_MARKED) else (lambda x: x)
    rows = docs.select("doc_id", "text")
    rows = rows.join(hint(marked), F.col("doc_id") == F.col("__wanted"), "left").withColumn("__mark", F.col("__wanted").isNotNull())
    chunks = settle(pack(rows, "__mark"), "chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, math.ceil(size / COUNTED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Grams(row, lower=True)
                for order, (bucket, value, every, target, *_) in zip(ORDERS, chunk.entries(buckets)):
                    parts = list(runs(bucket))
                    yield pa.record_batch(
                        [
                            pa.array([chunk.name] * len(parts), pa.int64()),
                            pa.array([b for b, _, _ in parts], pa.int32()),
                            pa.array([narrow(value[i:j], BITS // 8 - 1) for _, i, j in parts], pa.binary()),
                            pa.array([_counts(every[i:j]) for _, i, j in parts], pa.binary()),
                            pa.array([_counts(target[i:j]) for _, i, j in parts], pa.binary()),
                        ],
                        ["chunk", "bucket", "grams", "every", "target"],
                    )

    sent = chunks.mapInArrow(count, "chunk long, bucket int, grams binary, every binary, target binary")
    replies = settle(sent.groupBy("bucket").applyInArrow(_totals, _REPLY), "totals")
    words, tokens, wanted_tokens = (x or 0 for x in replies.where(F.col("bucket") < buckets).agg(
        F.sum("different"), F.sum("tokens"), F.sum("wanted")
    ).first())

    def score(group: pa.Table, said: pa.Table) -> pa.Table:
        chunk = _Grams(group.to_pylist()[0], lower=True)
        replied = {c: dict(zip(*(said.column(x).to_pylist() for x in ("bucket", c)))) for c in ("every", "target")}
        first, second = chunk.entries(buckets)
        n = chunk.counts
        columns: dict[str, pa.Array] = {"doc_id": pa.array(chunk.ids, pa.int64()), "n_tokens": pa.array(n)}
        loss = {}
        for name, place, total in (("target", 3, wanted_tokens), ("every", 2, tokens)):
            one = _merge(first[place], first[0], replied[name])[first[5]]
            two = _merge(second[place], second[0], replied[name])[second[5]]
            chance = (one + ADDED) / (total + ADDED * words) if words else one
            at = second[4]
            pair = np.where(one[at] > 0, two / np.maximum(one[at], 1), chance[at + 1])
            chance[at + 1] = BIGRAM * pair + (1 - BIGRAM) * chance[at + 1]
            loss[name] = -np.bincount(chunk.doc, np.log(chance), len(n)) / np.maximum(n, 1)
        columns["target_loss"] = pa.array(loss["target"], mask=n == 0)
        columns["background_loss"] = pa.array(loss["every"], mask=n == 0)
        columns["score"] = pa.array(loss["target"] - loss["every"])
        return pa.table(columns)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )
