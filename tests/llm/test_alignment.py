"""Token alignment against a plain computation over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from helpers import corpus, frame, prose
from tokenizers import Tokenizer

from tablekin.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    "a  b   c ", " lead", "  two", "\n", "x\n", "x\n\ny \n z", "\t", "tab\tand blank x", "a  b", "don't 'll x",
    "日本語のテキスト 漢字", "🙂🙃 👩‍👩‍👧 x", "<s> </s> <unk> <|endoftext|>", "<0x41> a", "mark ▁ here", "▁", "é́ ß",
    "a\x00b \x01", "\x1c x\x1d y", "x \r\n y\r z", "ሀለሐ መ ሠ", "word" * 3000, " ".join("ab" for _ in range(5000)),
    "\u0085 x\u0085y  z", "𐍈 𐍈𐍈", "1234 56,789.0 3.5e-7", "-- ((a)) [b]; {c}\n\n\n\nd",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = alignment.byte_level()
    a_bytes = {i: bytes(table[c] for c in t) for t, i in a.get_vocab().items() if all(c in table for c in t)}

    def b_bytes(i):
        p = b.IdToPiece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        one = [(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, b_bytes(i)) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (one, two)):
            return [], []
        return one, two

    return encode


def plain(texts, encode):
    """Groups, links and counts straight from the definition."""
    held, counts = [], Counter()
    for text in texts:
        sides = []
        for side in encode(text):
            at, spans = 0, []
            for i, data in side:
                spans.append((at, at + len(data), i))
                at += len(data)
            sides.append(spans)
        groups, links, inside, x, y = [], [], ([], []), 0, 0
        while x < len(sides[0]) and y < len(sides[1]):
            # Spans are sorted and without gaps: those that overlap are met in turn.
            (_, p, i), (_, q, k) = sides[0][x], sides[1][y]
            links.append((i, k))
            if p <= q:
                inside[0].append(str(i))
                x += 1
            if q <= p:
                inside[1].append(str(k))
                y += 1
            if p == q:
                groups.append("|".join(",".join(g) for g in inside))
                inside = ([], [])
        if len(sides[0]) < 50:
            assert sorted(links) == sorted((i, k) for s, e, i in sides[0] for t, f, k in sides[1] if t < e and s < f)
        counts.update(links)
        held.append((len(sides[0]), len(sides[1]), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in held:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        good = sum(counts[p] == best[p[1]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), good, sum(counts[p] for p in links), digest))
    return out


def texts_of():
    rng = random.Random(3)
    return [t for _, t, _ in corpus()] + ODD + [" ".join(rng.choice(ODD[:20]) for _ in range(30)) for _ in range(5)]


def test_alignment_by_brute_force(spark, tools, monkeypatch):
    # Small chunks and texts: the same units meet in several of them.
    monkeypatch.setattr(alignment, "CHUNK", 4000)
    monkeypatch.setattr(alignment, "TEXT", 1000)
    monkeypatch.setattr(alignment, "MEMORY", 500)
    texts = texts_of()
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in alignment.alignment(docs, A, B).select(*COLUMNS).collect()}
    want = plain(texts, tools)
    assert len(got) == len(texts)
    for i, (text, row) in enumerate(zip(texts, want)):
        assert got[i] == row, repr((text or "")[:80])
    assert got[texts.index("mark ▁ here")] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_given_texts(spark, small, tools):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in alignment.alignment(docs, A, B).select(*COLUMNS).collect())
    want = plain([r["text"] for r in rows], tools)
    assert got == [(r["doc_id"], *w) for r, w in zip(rows, want)]


def test_alignment_of_awkward_rows(spark):
    docs = frame(spark, [(None, "a b", "s"), (1, None, "s"), (2, "", "s"), (3, "a b", None), (3, "a b", None)])
    rows = alignment.alignment(docs, A, B).collect()
    found = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in rows)
    # Two tokens, each linked once in three rows.
    assert found == [(0, 2, 6), (1, 0, 0), (2, 0, 0), (3, 2, 6), (3, 2, 6)]
    assert alignment.alignment(docs.limit(0), A, B).collect() == []
    assert {r["groups_sha256"] for r in rows if not r["n_a"]} == {""}


def test_unit_borders_are_cuts(tools):
    for text in texts_of():
        units = alignment.units_of(text or "")
        assert "".join(units) == " " + (text or "")
        one, two = tools(text)
        if one:
            for side in (one, two):
                at, ends = 0, set()
                for _, data in side:
                    at += len(data)
                    ends.add(at)
                told = 0
                for u in units:
                    told += len(u.encode())
                    assert told in ends
    assert prose(random.Random(1), 3).count(" ") == 2


class Recorder:
    """A tokenizer that notes the length of each text it is given."""

    def __init__(self, tool):
        self.tool, self.lengths = tool, []

    def encode(self, text, **options):
        self.lengths.append(len(text))
        return self.tool.encode(text, **options)


def test_tokenizers_get_short_texts_once():
    words = [f"w{i}" for i in range(6000)]
    texts = [" ".join(words[:4000]), " ".join(words[2000:])]
    aligner = alignment.Aligner(A, B)
    aligner.a, aligner.b = a, b = Recorder(aligner.a), Recorder(aligner.b)
    alignment._chunk(aligner, [1, 2], texts)
    for tool in (a, b):
        # Each unit once, and a few characters that every text starts with.
        assert max(tool.lengths) < 5000
        assert sum(tool.lengths) < sum(len(w) + 1 for w in words) + 3 * len(tool.lengths)
        tool.lengths.clear()
    alignment._chunk(aligner, [3], [texts[0]])
    assert not a.lengths and not b.lengths


def test_an_odd_unit_costs_its_neighbours_little():
    aligner = alignment.Aligner(A, B)
    aligner.a = a = Recorder(aligner.a)
    texts = [" ".join(f"w{i}" for i in range(400)), "a \u2581x b", " ".join(f"v{i}" for i in range(400))]
    row = alignment._chunk(aligner, [1, 2, 3], texts).to_pylist()[0]
    assert row["n_units"] == [400, 0, 400] and row["hashes"][1] == ""
    assert len(a.lengths) < 40
    # If it is not known for odd, the text is halved until it is alone, not taken apart.
    a.lengths.clear()
    found = aligner._encode([f" u{i}" for i in range(200)] + [" \u2581x"] + [f" t{i}" for i in range(200)])
    assert [n for known, _, _ in found for n in known[:, 4]] == [1] * 200 + [0] + [1] * 200
    assert len(a.lengths) < 40


def test_forgotten_units_are_encoded_anew(tools, monkeypatch):
    texts = texts_of()
    want = plain(texts, tools)
    chunks = [list(range(k, min(k + 9, len(texts)))) for k in range(0, len(texts), 9)] * 2
    for memory, letters in ((250_000, 4 << 20), (40, 4 << 20), (250_000, 300), (0, 0)):
        monkeypatch.setattr(alignment, "MEMORY", memory)
        monkeypatch.setattr(alignment, "LETTERS", letters)
        monkeypatch.setattr(alignment, "TEXT", 200)
        aligner = alignment.Aligner(A, B)
        for ids in chunks:
            row = alignment._chunk(aligner, ids, [texts[i] for i in ids]).to_pylist()[0]
            got = list(zip(row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["hashes"]))
            assert got == [(*want[i][:4], want[i][6]) for i in ids]
            told = Counter(dict(zip(row["pairs"], row["counts"])))
            assert sum(told.values()) == sum(want[i][3] for i in ids)
            if len(aligner.place) and memory < 250_000:
                assert max(map(len, aligner.place)) <= alignment.LONGEST
            assert len(aligner.place) == len(aligner.written) == len(aligner.known)
            assert sum(aligner.known[:, 3]) == len(aligner.pairs)
