import collections
import hashlib
import math
import random

import public_tokenizers
import pytest
import sentencepiece
from helpers import corpus, frame, prose

from tablekin.llm import bpe, decontamination, scoring, substrings, toxicity
from tablekin.llm.chunks import pack

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def split(text):
    return (text or "").encode().split()


def test_repeats_by_brute_force(spark, monkeypatch):
    docs = corpus(n=50)
    monkeypatch.setattr("tablekin.llm.chunks.CHUNK", 2000)
    first = {}
    for i, text, _ in docs:
        if i is not None:
            w = split(text)
            for k in range(len(w) - 12):
                key = b" ".join(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    expected = collections.Counter()
    for i, text, _ in docs:
        w, gone = split(text), set()
        for k in range(len(w) - 12):
            if i is not None and first[b" ".join(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        rest = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expected[(i, len(w), len(gone), rest.decode())] += 1
    found = substrings.without_repeats(frame(spark, docs)).collect()
    assert collections.Counter(tuple(r) for r in found) == expected
    assert sum(r["n_removed"] for r in found) > 300
    assert substrings.without_repeats(frame(spark, docs).where("false")).collect() == []


def test_rows_sent_grow_with_the_words_alone(spark, monkeypatch, tmp_path):
    """Not with chunks times buckets, of which both grow with the input."""
    monkeypatch.setattr("tablekin.llm.chunks.CHUNK", 2000)
    for n in (40, 80, 160):
        docs = corpus(n=n)
        words = sum(len(split(text)) for _, text, _ in docs)
        pack(frame(spark, docs)).write.parquet(str(tmp_path / f"{n}"))
        chunks = spark.read.parquet(str(tmp_path / f"{n}"))
        rows = [substrings._probes(chunks, 13, buckets).count() for buckets in (n // 10, 4 * n)]
        assert rows[0] == pytest.approx(rows[1], rel=1e-3)
        assert 0.3 * words < rows[1] <= words


def test_token_counts_equal_the_library(spark):
    rng = random.Random(5)
    odd = "  ▁▁ab the \n\n\t\réß日本𓀀x.,</s><0x0A>\u200b \x00ing"
    docs = corpus() + [
        (200 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(80))), "s") for i in range(300)
    ]
    docs += [(900, "a" * 30_000, "s"), (901, " " * 3000, "s"), (902, "ab" * 9000, "s")]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = bpe.token_counts(frame(spark, docs), MODEL, limit=50).collect()
    expected = collections.Counter(
        (i, len((t or "").encode()), n, n > 50)
        for (i, t, _), n in zip(docs, (len(library.encode(t or "")) for _, t, _ in docs))
    )
    assert collections.Counter(tuple(r) for r in found) == expected
    assert bpe.token_counts(frame(spark, docs).where("false"), MODEL).collect() == []


def test_losses_by_brute_force(spark, monkeypatch):
    docs = corpus(n=40)
    monkeypatch.setattr("tablekin.llm.chunks.CHUNK", 3000)
    good = {i for i, _, _ in docs if i is not None and i % 3 == 0}
    wanted = spark.createDataFrame([(i, 1) for i in good] + [(None, 1), (0, 1)], "doc_id bigint, quality int")
    counts = [[collections.Counter(), collections.Counter()] for _ in range(2)]
    for i, text, _ in docs:
        w = [x.lower() for x in split(text)]
        for k in (0, 1) if i in good else (0,):
            counts[k][0].update(w)
            counts[k][1].update(zip(w, w[1:]))
    size, total = len(counts[0][0]), [sum(c[0].values()) for c in counts]
    found = collections.defaultdict(list)
    for r in scoring.losses(frame(spark, docs), wanted).collect():
        found[r["doc_id"]].append(r)
    assert sum(map(len, found.values())) == len(docs)
    for i, text, _ in docs:
        w = [x.lower() for x in split(text)]
        loss = []
        for one, two in ((counts[k][0], counts[k][1]) for k in (1, 0)):
            n = total[1] if one is counts[1][0] else total[0]
            share = [(one[x] + scoring.ADDED) / (n + scoring.ADDED * size) for x in w]
            mixed = share[:1]
            for v, x, s in zip(w, w[1:], share[1:]):
                pair = two[v, x] / one[v] if one[v] else s
                mixed.append(scoring.BIGRAM * pair + (1 - scoring.BIGRAM) * s)
            loss.append(-sum(map(math.log, mixed)))
        for r in found[i]:
            assert r["n_tokens"] == len(w)
            if w:
                assert r["target_loss"] == pytest.approx(loss[0] / len(w))
                assert r["score"] == pytest.approx((loss[0] - loss[1]) / len(w))
            else:
                assert (r["target_loss"], r["score"]) == (None, 0.0)
    none = frame(spark, docs).where("false")
    assert scoring.losses(none, wanted).collect() == []
    assert scoring.losses(frame(spark, docs), wanted.where("false")).count() == len(docs)


def overlap_brute(docs, items):
    import regex

    def tokens(text):
        return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())

    out = {}
    for i, text, _ in docs:
        d = tokens(text)
        for item, passage in items:
            q = tokens(passage)
            if i is None or item is None or len(q) < 6:
                continue
            n = min(13, len(q))
            least = n if n < 13 else 11
            best, first = 0, None
            for a in range(len(d) - n + 1):
                for b in range(len(q) - n + 1):
                    same = sum(x == y for x, y in zip(d[a : a + n], q[b : b + n]))
                    if same >= least:
                        best, first = max(best, same), a if first is None else min(first, a)
            if best:
                m, f = out.get((i, item), (0, 10**9))
                out[i, item] = (max(m, best), min(f, first))
    return out


@pytest.mark.parametrize("most,piece", [(10**6, 2048), (0, 16)])
def test_overlaps_by_brute_force(spark, monkeypatch, most, piece):
    monkeypatch.setattr(decontamination, "MOST_SEEDS", most)
    monkeypatch.setattr(decontamination, "PIECE", piece)
    rng = random.Random(8)
    items = [(k, prose(rng, n, 400)) for k, n in enumerate([40, 25, 13, 12, 7, 5, 1])]
    items += [(20, None), (21, ""), (None, prose(rng, 30)), (0, items[0][1])]
    docs = [d for d in corpus(n=25) if d[0] != 104]
    for k in range(40):
        source = items[k % 7][1].split()
        low = rng.randrange(max(len(source) - 13, 0) + 1)
        part = source[low : low + 13 + rng.randrange(8)]
        for _ in range(rng.randrange(5)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((300 + k, f"{prose(rng, rng.randrange(40))} {', '.join(part).upper()}! {prose(rng, 5)}", "s"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = frame(spark, docs)
    found = decontamination.overlaps(df, bench).collect()
    expected = overlap_brute(docs, items)
    assert {(r[0], r[1]): (r[2], r[3]) for r in found} == expected
    assert 10 < len(expected) < 60
    clean = decontamination.clean(df, bench)
    bad = {i for i, _ in expected}
    assert clean.columns == df.columns
    assert clean.count() == sum(i not in bad for i, _, _ in docs)
    assert decontamination.overlaps(df.where("false"), bench).collect() == []
    assert decontamination.overlaps(df, bench.where("false")).collect() == []


def labelled(rng, n):
    """Texts of made-up words, one in four with rude words in some spelling."""
    stems = ["grumpf", "blarzig", "vextoid"]
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["ta", "ne", "ri", "so", "lu", "mi"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            stem = rng.choice(stems)
            w[rng.randrange(len(w))] = stem + rng.choice(["", "s", "ed", "o", "y"]) + rng.choice(["", "!", "."])
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 0, toxic))
    return docs, labels


def test_toxicity_on_held_out_texts(spark):
    import zlib

    docs, labels = labelled(random.Random(3), 1200)
    awkward = [d for d in corpus(n=0)]
    df = frame(spark, docs + [(i and i + 10_000, t, s) for i, t, s in awkward])
    marks = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None), (5, 0, 9)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert len(rows) == len(docs) + len(awkward)
    truth = {i: t for i, _, t in labels}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)
    # Texts of words that no label covers are let pass, whatever their length.
    foreign = [r for r in rows if r["doc_id"] is None or r["doc_id"] >= 10_000]
    assert len(foreign) == len(awkward) and not any(r["predicted"] for r in foreign)
    kept = toxicity.accepted(df, marks)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r["predicted"] for r in rows)


def test_toxicity_of_a_misspelt_word(spark):
    docs, labels = labelled(random.Random(4), 800)
    model = toxicity.fit([(t.encode(), y) for (_, t, _), (_, _, y) in zip(docs, labels)])
    unseen, plain = b"tane risolu grumppf milu sotane grumpfa", b"tane risolu mitane milu sotane risone"
    worst = [toxicity.worst(t, model.weight, model.bias) for t in (unseen, plain)]
    assert worst[0] > worst[1] + 2


def test_toxicity_without_labels_or_texts(spark):
    df = frame(spark, corpus(n=5))
    marks = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (marks, marks.where("false")):
        scores = {r["score"] for r in toxicity.toxicity(df, labels).collect()}
        assert len(scores) == 1 and scores.pop() < 0.3
    assert toxicity.toxicity(df.where("false"), marks).collect() == []


def test_digest_of_the_rest(spark):
    from tablekin.llm.queries import QUERIES

    row = QUERIES["op3_substrings"](spark, "/root/testdata/sf0.001").where("n_removed = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()


def test_toxicity_learns_from_texts_beyond_the_sample_size(spark):
    docs, labels = labelled(random.Random(6), 300)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    long = [(i, f"{t} {t} {t} {t}", s) for i, t, s in docs]
    model = toxicity.learn(frame(spark, long), marks, size=60)
    assert model.slope > 0 and model.weight.any()
