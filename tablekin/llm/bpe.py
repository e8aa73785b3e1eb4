"""Token counts by byte-pair merging with a heap and a linked list.

The model is a public SentencePiece BPE file. Its pieces with their scores are all
that merging needs: the adjacent pair whose joined piece ranks best is merged first,
the leftmost one among equals, until no pair is a piece. A text has as many tokens as
it had symbols at the start, less the merges; characters that are no piece count as
their UTF-8 bytes, which is what byte fallback turns them into. No identifiers are made.

Texts are not merged as one: a merge can join neither a white-space mark to a
character before it nor anything across a character that occurs in no longer piece.
Such cuts leave short units that repeat, so each task remembers their counts in a
dictionary of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white-space mark and the piece types of the file format (fixed values).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Remembered units per task, and the longest unit that is worth remembering.
MEMORY, LONGEST = 300_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Ranks of the pieces of a SentencePiece BPE file, and token counts by them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        scores: dict[str, float] = {}
        self.byte_fallback, self.prefix, trim, normal, kind = False, True, True, b"", 1
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, NORMAL) in (NORMAL, USER_DEFINED, UNUSED):
                    scores[piece[1].decode()] = float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0])
                if piece.get(3) in (USER_DEFINED, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 2:
                trainer = dict(_fields(value))
                kind, self.byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                normal, self.prefix, trim = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if kind != 2 or normal or trim:
            raise ValueError("only BPE models that leave texts as they are")
        order = sorted(set(scores.values()), reverse=True)
        place = {score: i for i, score in enumerate(order)}
        self.rank = {piece: place[score] for piece, score in scores.items()}
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("a piece holds a white-space mark behind a character")
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece}
        #: White space without a longer piece stands alone, so texts can be cut there.
        self.alone = "".join(c for c in "\n\t\r\v\f" if c not in joined)
        cut = re.escape(self.alone)
        self.units = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if cut else ""))
        self.known: dict[str, int] = {}

    def merged(self, unit: str) -> int:
        """Tokens of one unit: its symbols less the merges."""
        rank, n = self.rank, len(unit)
        symbols = list(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := rank.get(unit[i : i + 2])) is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # Out of date if either side has merged since: then the pair's length differs.
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, h, len(pair)))
        return sum(1 if s in rank else self.unknown(s) for s in symbols if s)

    def unknown(self, symbol: str) -> int:
        return len(symbol.encode()) if self.byte_fallback else 1

    def count(self, text: str) -> int:
        """Tokens of a whole text, without begin, end or other added ones."""
        if not text:
            return 0
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        known, total = self.known, 0
        for found in self.units.finditer(text):
            unit = found[0]
            tokens = known.get(unit)
            if tokens is None:
                tokens = self.merged(unit)
                if len(unit) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[unit] = tokens
            total += tokens
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    ``path`` names the model file, which every executor must have. A missing text
    counts as empty: no bytes, no tokens. Rows with the same doc_id or text, or without
    a doc_id, each give a row; an empty table gives none. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            tokens = [model.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    counted = rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
