"""Each stage of the pipeline on planted documents, held against plain Python."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from helpers import corpus, frame, prose
from test_near_duplicates import grouped, shingles
from test_text_operators import labelled, overlap_brute

from tablekin.llm import mixing, placement
from tablekin.session import settle

STAGE = dict(corpus_pipeline.STAGES)
LABELS = "doc_id bigint, quality int, toxic int"
ITEMS = "item_id bigint, text string"


def planted(rng):
    """Documents and labels; copies, near copies and benchmark passages; awkward rows."""
    docs, labels = labelled(rng, 700)
    docs = [(i, t, f"s{min(i % 5, 2)}") for i, t, _ in docs]
    items = [(k, prose(rng, 22, 10**6)) for k in range(2)] + [(7, None), (None, "a b"), (8, "")]
    clean = [d for d, (_, _, toxic) in zip(docs, labels) if not toxic]
    for k in range(60):
        i, text, source = clean[k]
        words = text.split()
        if k % 3:
            words[-1] = f"ta{'ne' * (k % 4)}"
        docs.append((1000 + k, " ".join(words), source))
    for k in range(40):
        words = items[k % 2][1].split()[k % 9 : k % 9 + 13]
        for at in rng.sample(range(13), k % 4):
            words[at] = "tane"
        docs.append((2000 + k, f"{clean[100 + k][1]} {' '.join(words)} {clean[200 + k][1]}", "s1"))
    awkward = [d for d in corpus(n=0) if d[0] != 104]
    return docs + [(i and i + 10_000, t, s) for i, t, s in awkward], labels, items


def tables(spark, folder, docs, labels, items):
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def ids(docs):
    return Counter(d[0] for d in docs)


def test_stages_by_brute_force(spark, tmp_path):
    docs, labels, items = planted(random.Random(21))
    folder = str(tmp_path)
    tables(spark, folder, docs, labels, items)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns

    def step(name, df):
        out = settle(STAGE[name](spark, df, folder), name)
        if name != "sharding":
            assert out.columns == columns
        return out, rows(out)

    now, kept = step("toxicity", now)
    truth = {i: toxic for i, _, toxic in labels}
    gone = ids(docs) - ids(kept)
    assert not ids(kept) - ids(docs)
    wrong = sum(truth[i] != (i in gone) for i in truth)
    assert wrong <= 0.02 * len(truth) and sum(truth.values()) > 100
    # What is no labelled text is clean and stays, but see the next test.
    wordless = {i for i, t, _ in docs if not (t or "").split()}
    assert [i for i in gone if i not in truth and i not in wordless] == []

    named = [d for d in kept if d[0] is not None]
    sets = {i: set(shingles(t, 5)) for i, t, _ in named}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return not sets[a] and not sets[b] or both and both >= 0.8 * len(sets[a] | sets[b])

    single = set(grouped(list(sets), alike).values())
    before = kept
    now, kept = step("near_duplicates", now)
    assert ids(kept) == Counter({i: 1 for i in single}) + Counter({None: ids(before)[None]})
    assert len(before) - len(kept) > 30

    bad = {i for i, _ in overlap_brute(kept, items)}
    assert 20 <= len(bad) < 40
    before = kept
    now, kept = step("decontamination", now)
    assert ids(kept) == Counter(d[0] for d in before if d[0] not in bad)

    before, target = now, mixing.Target(repeats=corpus_pipeline.REPEATS)
    planned = {r["source"]: r["wanted"] for r in mixing.plan(before, target).collect()}
    single = kept
    now, kept = step("mixing", now)
    assert set(kept) == set(single)
    used, longest = Counter(), Counter()
    for _, text, source in kept:
        used[source] += len((text or "").split())
    for _, text, source in single:
        longest[source] = max(longest[source], len((text or "").split()))
    for source, n in longest.items():
        assert planned[source] - n - 1 < used[source] <= planned[source] or not n
    assert len(kept) > len(single)

    placed, last = step("sharding", now)
    assert placed.columns == [*[c for c in columns if c not in ("slot", "shard")], "slot", "shard"]
    assert ids(last) == ids(kept)
    table = placement.fill(placement.names(placement.SHARDS), placement.SLOTS)
    for r in placed.select("doc_id", "slot", "shard").distinct().collect():
        slot = placement._number(str(r["doc_id"] if r["doc_id"] is not None else "")) % placement.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])


@pytest.mark.xfail(strict=True, reason="learnt from so few labels, the curve gives texts without words 0.37")
def test_texts_without_words_stay(spark, tmp_path):
    docs, labels, items = planted(random.Random(21))
    tables(spark, str(tmp_path), docs, labels, items)
    kept = rows(STAGE["toxicity"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)))
    assert {i for i, t, _ in docs if not (t or "").split()} <= set(ids(kept))


def test_pipeline_of_tables_that_are_empty(spark, tmp_path):
    docs, labels, items = planted(random.Random(22))
    few = docs[:30] + docs[-9:]
    for k, (d, l, b) in enumerate([([], labels, items), (few, [], []), (few, labels[:1], items), ([], [], [])]):
        folder = str(tmp_path / str(k))
        tables(spark, folder, d, l, b)
        out = corpus_pipeline.run(spark, folder)
        assert set(out.columns) >= {"doc_id", "text", "slot", "shard"}
        found = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert found <= {i for i, _, _ in d} and bool(found) == bool(d)
