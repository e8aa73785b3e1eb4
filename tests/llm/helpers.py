"""A small corpus with the awkward rows every operator must bear."""

import random

CLASHING = ["score", "fp", "component", "copies", "slot", "shard", "chunk", "piece", "seed"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"{c} string" for c in CLASHING
)


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """``(doc_id, text, source)`` with copies, near copies, shared passages, nulls,
    empty, blank, very long and odd texts, repeated rows and rows without a doc_id."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    docs = []
    for i in range(n):
        text = prose(rng, rng.randrange(1, 120))
        if i % 5 == 0:
            text = f"{prose(rng, 20)} {passage} {prose(rng, 10)}"
        if i % 7 == 3:
            text = docs[-1][1]
        if i % 11 == 6:
            words = docs[0][1].split()
            words[rng.randrange(len(words))] = f"x{i}"
            text = " ".join(words)
        docs.append((i, text, f"s{min(rng.randrange(6), 3)}"))
    docs += [
        (100, None, "s0"),
        (101, "", None),
        (102, " \t\n ", ""),
        (103, "ÄÖÜ ß é\u00a0 日本 \u200b 🙂", "s1"),
        (104, prose(rng, 9000, 5000), "s1"),
        (105, "one", "s0"),
        (105, "one", "s0"),
        (106, "One\vTWO", "s2"),
        (None, passage, "s0"),
        (107, "a " * 400, "s0"),
    ]
    return docs


def frame(spark, docs):
    rows = [(i, t, "en", s, None, *CLASHING) for i, t, s in docs]
    return spark.createDataFrame(rows, SCHEMA)
