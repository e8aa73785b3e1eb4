"""How the tokens of two tokenizers lie over each other in the same text.

Tokenizer A is a byte-level BPE file of ``tokenizers``, B a SentencePiece BPE model. Of a
text encoded by both, A's character offsets and B's spans of its proto give the ends of
tokens. Where characters of several bytes are cut apart, or spelled byte by byte, these
are only coarse: such tokens get their ends from the lengths of their decoded bytes,
counted from the last sure end before them. Ends that both share cut the text into
groups, and every two neighbouring ends of either one enclose a pair of overlapping
tokens, a link.

Both tokenizers can be cut before a run of blanks or line feeds that follows any other
visible character: A's pattern starts anew there, and no piece of B holds such a mark
behind a character. The units between these cuts repeat. A task numbers the units it
meets, encodes each of them once while it remembers it, many in one text, and puts
documents together from units. A chunk is written with its units, so the second step,
which needs the counts of id pairs over the corpus, encodes nothing again. Counts are
joined to the different id pairs of each chunk, so what is shuffled follows chunks and
not tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.session import settle

#: Bytes of text in a chunk (a longer document is one of its own), characters encoded at
#: once, units a task remembers and their characters, and the longest unit that stays when
#: there are more. Both tokenizers are slower by the character in longer texts.
CHUNK, TEXT, MEMORY, LETTERS, LONGEST = 4 << 20, 1 << 12, 250_000, 4 << 20, 64

#: B's space mark, the form of its byte pieces, and what a text starts with that units
#: are put into (fixed values).
MARK, BYTE_PIECE, LEAD = "▁", re.compile(r"<0x([0-9A-F]{2})>"), " a"

_UNIT, _ODD = re.compile(r"[ \n]+[^ \n]*"), re.compile(rf"[^\S \n][ \n]|{MARK}[ \n]")
_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f"
_B_BITS = 24


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the others are numbered from 256.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def units_of(text: str) -> list[str]:
    """A space and the text, cut where both tokenizers may be cut.

    A unit that ends in white space of another kind, or in B's mark, stays joined to the
    one behind it.
    """
    units = _UNIT.findall(" " + text)
    # ASCII texts without other white space, which most are, need no search.
    if text.isascii() and not any(c in text for c in _SPACES) or not _ODD.search(text):
        return units
    joined, held = [], ""
    for u in units:
        held += u
        if not (held[-1].isspace() or held[-1] == MARK):
            joined.append(held)
            held = ""
    return joined + [held] if held else joined


class Places(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        return place


#: What is known of a unit: its tokens on each side, its groups and links, and whether
#: both tokenizers give it back.
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_KNOWN = [*_NUMBERS, "same"]


class Aligner:
    """Both tokenizers and their units; made once a task.

    Units are numbered as they are met. A unit's row of ``known`` holds its numbers,
    ``written`` its groups as text, and ``pairs`` the id pairs of its links, which follow
    one another in the order of units.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in table for c in token)
            self.a_bytes[i] = bytes(table[c] for c in token) if known else token.encode()
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in pieces):
            raise ValueError("a piece holds a space mark or a line feed behind a character")
        found = [BYTE_PIECE.fullmatch(p) for p in pieces]
        self.b_bytes = [
            bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for m, p in zip(found, pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id as text, with what follows it inside a group and at the end of its side.
        self.a_text = [f"{i}{c}".encode() for i in range(len(self.a_bytes)) for c in "|,"]
        self.b_text = [f"{i}{c}".encode() for i in range(len(self.b_bytes)) for c in ";,"]
        self.a_length = np.array([len(x) for x in self.a_text], np.int64)
        self.b_length = np.array([len(x) for x in self.b_text], np.int64)
        self.place = Places()
        self.known = np.empty((0, len(_KNOWN)), np.int64)
        self.written: list[bytes] = []
        self.pairs = np.empty(0, np.int64)
        self.letters = 0

    @staticmethod
    def _ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Byte ends of tokens from the byte spans of their characters and their lengths.

        A span is a sure end unless it is empty or reaches into the next token's: these
        tokens are parts of a character. They end so many bytes behind the last sure end
        as decoded bytes have come since.
        """
        sure = end > begin
        sure[:-1] &= begin[1:] >= end[:-1]
        sure[-1] = True
        told = np.cumsum(size)
        last = np.maximum.accumulate(np.where(sure, np.arange(len(end)), -1))
        base = np.where(last >= 0, end[last] - told[last], 0)
        return np.where(sure, end, told + base)

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte ends of A's tokens and of B's; the text starts with a space."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))
        encoding = self.a.encode(text, add_special_tokens=False)
        a_ids = np.array(encoding.ids, np.int64)
        spans = at[np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)]
        a_ends = self._ends(spans[:, 0], spans[:, 1], self.a_size[a_ids])
        # The proto's spans are byte places in the text that B is given, without the space.
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b_ids = np.array([x.id for x in pieces], np.int64)
        begin, end = np.array([x.begin for x in pieces]) + 1, np.array([x.end for x in pieces]) + 1
        begin[0] -= 1
        return a_ids, a_ends, b_ids, self._ends(begin, end, self.b_size[b_ids])

    def _encode(self, units: list[str]) -> list[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """What is known of units that may stand behind one another, all in one text."""
        text = LEAD + "".join(units)
        data = text.encode()
        a_ids, a_ends, b_ids, b_ends = self._encoded(text)
        whole = b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) == data
        if not (whole and b"".join(map(self.b_bytes.__getitem__, b_ids.tolist())) == data):
            if len(units) > 1:
                # Halved until a unit that is not given back is alone.
                half = len(units) // 2
                return self._encode(units[:half]) + self._encode(units[half:])
            return [(np.zeros((1, len(_KNOWN)), np.int64), [b""], np.empty(0, np.int64))]
        sizes = map(len, units) if len(data) == len(text) else (len(u.encode()) for u in units)
        stops = np.cumsum([len(LEAD), *sizes])
        ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        both = ends[1:] == ends[:-1]
        cuts, ends = ends[1:][both], ends[np.concatenate((~both, [True]))]
        pairs = (a_ids[np.searchsorted(a_ends, ends)] << _B_BITS) | b_ids[np.searchsorted(b_ends, ends)]
        if not (cuts[np.minimum(np.searchsorted(cuts, stops), len(cuts) - 1)] == stops).all():
            raise ValueError("a token crosses the border of two units")
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        same_a = np.concatenate((a_group[1:] == a_group[:-1], [False]))
        same_b = np.concatenate((b_group[1:] == b_group[:-1], [False]))
        a_words, b_words = 2 * a_ids + same_a, 2 * b_ids + same_b
        words = list(map(self.a_text.__getitem__, a_words.tolist()))
        words += map(self.b_text.__getitem__, b_words.tolist())
        told = np.concatenate(([0], np.cumsum(np.concatenate((self.a_length[a_words], self.b_length[b_words]))[order])))
        written = b"".join(map(words.__getitem__, order.tolist()))
        a_at, b_at, cut_at, link_at = (np.searchsorted(x, stops, "right") for x in (a_ends, b_ends, cuts, ends))
        known = np.column_stack([*map(np.diff, (a_at, b_at, cut_at, link_at)), np.ones(len(units), np.int64)])
        # The mark behind a unit's last group is left out.
        word_at = told[a_at + b_at].tolist()
        groups = [written[i : j - 1] for i, j in zip(word_at, word_at[1:])]
        return [(known, groups, pairs[link_at[0] :])]

    def look_up(self) -> None:
        """Encodes the units that were numbered since the last call."""
        found, held, size = [], [], 0
        for u in islice(self.place, len(self.written), None):
            self.letters += len(u)
            if MARK in u and held:
                # B does not give it back, and with it not its neighbours.
                found += self._encode(held)
                held, size = [], 0
            held.append(u)
            size += len(u)
            # Nothing may stand behind white space.
            if size >= TEXT or u[-1].isspace() or MARK in u:
                found += self._encode(held)
                held, size = [], 0
        if held:
            found += self._encode(held)
        if found:
            known, written, pairs = zip(*found)
            self.known = np.concatenate((self.known, *known))
            self.written.extend(chain.from_iterable(written))
            self.pairs = np.concatenate((self.pairs, *pairs))

    def links(self, units: np.ndarray) -> np.ndarray:
        """The id pairs of the links of some units, one unit behind the other."""
        size = self.known[:, 3]
        begin, size = (np.cumsum(size) - size)[units], size[units]
        return self.pairs[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def forget(self, used: np.ndarray) -> None:
        """Keeps only the short ones of these units, once there are too many."""
        if len(self.written) <= MEMORY and self.letters <= LETTERS:
            return
        names = list(self.place)
        kept = np.array([i for i in used.tolist() if len(names[i]) <= LONGEST], np.int64)
        self.pairs, self.known = self.links(kept), self.known[kept]
        self.written = [self.written[i] for i in kept.tolist()]
        self.place = Places((names[i], k) for k, i in enumerate(kept.tolist()))
        self.letters = sum(map(len, self.place))


_CHUNK = (
    "ids array<long>, "
    + ", ".join(f"{c} array<long>" for c in _NUMBERS)
    + ", hashes array<string>, n_units array<long>, codes binary, unit_links array<long>, links binary, "
    "pairs array<long>, counts array<long>"
)


def _chunk(aligner: Aligner, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """One row for the documents of a chunk; see :func:`alignment` for its use."""
    number = aligner.place.__getitem__
    codes = [np.array(list(map(number, units_of(text) if text else [])), np.int32) for text in texts]
    aligner.look_up()
    same = aligner.known[:, 4] > 0
    # A text that either tokenizer does not give back has no tokens.
    codes = [c if same[c].all() else c[:0] for c in codes]
    hashes = [hashlib.sha256(b";".join(map(aligner.written.__getitem__, c.tolist()))).hexdigest() if len(c) else "" for c in codes]
    n_units = np.array([len(c) for c in codes], np.int64)
    every = np.concatenate(codes) if codes else np.empty(0, np.int32)
    stops = np.concatenate(([0], np.cumsum(n_units)))
    # In a chunk, only its own units are numbered.
    times = np.bincount(every, minlength=len(aligner.written))
    used = np.flatnonzero(times)
    within = np.zeros(len(times), np.int32)
    within[used] = np.arange(len(used))
    known, every = aligner.known[used], within[every]
    sums = {}
    for k, name in enumerate(_NUMBERS):
        told = np.concatenate(([0], np.cumsum(known[every, k])))
        sums[name] = told[stops[1:]] - told[stops[:-1]]
    pairs, links = np.unique(aligner.links(used), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, links, np.repeat(times[used], known[:, 3]))
    aligner.forget(used)
    press = zstandard.ZstdCompressor(level=3).compress
    lists = {
        "ids": pa.array(ids, pa.int64()),
        **sums,
        "hashes": pa.array(hashes, pa.string()),
        "n_units": n_units,
        "codes": press(every.astype("<i4").tobytes()),
        "unit_links": known[:, 3],
        "links": press(links.astype("<i4").tobytes()),
        "pairs": pairs,
        "counts": counts,
    }
    arrays = [
        pa.array([v]) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
        for v in lists.values()
    ]
    return pa.record_batch(arrays, list(lists))


def _unpress(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    One row per row of ``docs``, also for rows with the same doc_id or text or without a
    doc_id. ``n_links`` counts pairs of an A and a B token whose bytes overlap. An id
    pair counts as often as links of the whole corpus hold it; ``count_sum`` adds that
    up over the links, and ``n_best`` counts links whose pair has the highest count of
    all pairs of its B id, equal ones included. ``groups_sha256`` hashes the ids by
    groups, as in ``1,2|3;4|5,6``. Missing and empty texts, and texts that the decoded
    tokens do not give back, have no tokens: zeros and an empty hash, and they count
    nowhere. Other columns are ignored; no rows give none. Every executor must have both
    files. A chunk holds :data:`CHUNK` bytes of text, or one longer document.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 64
                if size >= CHUNK:
                    yield _chunk(aligner, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _chunk(aligner, ids, texts)

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        total, best = (np.zeros(found.num_rows, np.int64) for _ in range(2))
        at = found.column("place").to_numpy()
        total[at], best[at] = found.column("total").to_numpy(), found.column("best").to_numpy()
        for row in chunk.to_pylist():
            links, codes = _unpress(row["links"]), _unpress(row["codes"])
            unit_stop = np.concatenate(([0], np.cumsum(np.array(row["unit_links"], np.int64))))
            doc_stop = np.concatenate(([0], np.cumsum(np.array(row["n_units"], np.int64))))
            columns = {"doc_id": pa.array(row["ids"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in _NUMBERS}}
            for name, values in (("n_best", best), ("count_sum", total)):
                told = np.concatenate(([0], np.cumsum(values[links])))
                told = np.concatenate(([0], np.cumsum((told[unit_stop[1:]] - told[unit_stop[:-1]])[codes])))
                columns[name] = pa.array(told[doc_stop[1:]] - told[doc_stop[:-1]], pa.int64())
            out.append(pa.table({**columns, "groups_sha256": pa.array(row["hashes"], pa.string())}))
        return pa.concat_tables(out) if out else result.empty_table()

    names = ["doc_id", *_NUMBERS, "n_best", "count_sum"]
    result = pa.schema([(c, pa.int64()) for c in names] + [("groups_sha256", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    packed = rows.mapInArrow(encode, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    chunks = settle(packed, "chunks")
    told = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "told"))
    told = told.select(F.col("chunk").alias("holder"), "place", F.col("told.pairs").alias("pair"), F.col("told.counts").alias("n"))
    totals = settle(told.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b_id")
    # One row per B id, so the vocabulary bounds what is broadcast.
    most = totals.groupBy(b_id).agg(F.max("total").alias("most"))
    judged = totals.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")
    judged = judged.select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    found = told.join(judged, "pair").select("holder", "place", "total", "best")
    held = chunks.drop("pairs", "counts")
    schema = ", ".join(f"{c} long" for c in names) + ", groups_sha256 string"
    return held.groupBy("chunk").cogroup(found.groupBy("holder")).applyInArrow(finish, schema)
