"""Toxicity scores from character n-gram embeddings under a linear softmax.

Every byte n-gram of a word, with its ends marked, has a row in one hashed embedding
table. A segment of one or more words is the mean of the rows of its n-grams, and a linear
softmax over two classes reads that mean; table and softmax are trained together in
numpy. A misspelt word shares most of its n-grams with the right one and is scored
alike.

Labels belong to whole texts, of which a few words may be toxic. So a text is judged by
its most toxic segments: training picks these in each text labelled 1, at first by
n-gram frequencies, later by the model of the round before, against segments of the
texts labelled 0, the worst ones included. At last a logistic curve turns the mean of
the largest segment logits of a text into its probability. That mean is larger by chance
the more segments there are, so the curve also looks at the number of these. It learns
from whole labelled texts of every length, and from made-up texts whose n-grams meet
rows of the table by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.llm.common import texts, word_blocks

#: n-gram lengths in bytes, table rows, width, and words per segment and step.
NGRAMS, ROWS, DIM, SEGMENT, STEP = (3, 4, 5, 6), 1 << 18, 8, 1, 1

#: Segments of a text that its score looks at, and that training picks of it.
TOP, PICKS = 3, 3

#: Bounds of the training sample: rows of each class, and bytes of a text in it.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 20_000

#: Standard errors that part the classes' shares of an n-gram before it first counts.
SURE = 4.0

#: Weight of the unknown text in the curve, as a share of all texts of class 0.
UNKNOWN = 0.25

#: Segments of the unknown texts, how many there are of each, and n-grams of a segment.
LENGTHS, DRAWS, GRAMS = (1, 10, 100, 1000, 10_000, 100_000), 4, 10

#: Share that every step takes off all parameters.
DECAY = 0.002

_SPACE = 32


@dataclass
class Model:
    """Logit of each n-gram, logit without any, and the curve for whole texts."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    tilt: float = 0.0


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all n-grams of the words, the word each belongs to; and of each segment
    its first word."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = joined == _SPACE
    word_at = np.cumsum(space) - 1
    wide = joined.astype(np.uint32)
    rows, owner = [], []
    code = wide.copy()
    inside = np.concatenate(([0], np.cumsum(space)))
    for n in range(2, max(NGRAMS) + 1):
        if len(joined) < n:
            break
        code = code[: len(joined) - n + 1] * np.uint32(16777619) ^ wide[n - 1 :]
        if n in NGRAMS:
            # Only the first and the last byte of an n-gram may be the mark of an end.
            fits = np.flatnonzero(inside[n - 1 : len(joined)] == inside[1 : len(joined) - n + 2])
            mixed = (code[fits] + np.uint32(n)) * np.uint32(2654435761)
            rows.append((mixed >> np.uint32(14)).astype(np.int64) & (ROWS - 1))
            owner.append(word_at[fits])
    first = np.arange(0, max(len(words) - SEGMENT + STEP, 1), STEP)
    none = np.empty(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(owner or [none]), first


def _logits(found: tuple, n: int, weight: np.ndarray, bias: float) -> np.ndarray:
    rows, owner, first = found
    total = np.concatenate(([0.0], np.cumsum(np.bincount(owner, weight[rows], n))))
    number = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    last = np.minimum(first + SEGMENT, n)
    return (total[last] - total[first]) / np.maximum(number[last] - number[first], 1) + bias


def segment_logits(words: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each segment of a list of words."""
    return _logits(grams(words), len(words), weight, bias)


def _highest(logits: np.ndarray) -> np.ndarray:
    return logits if len(logits) <= TOP else np.partition(logits, -TOP)[-TOP:]


def measures(text: bytes, weight: np.ndarray, bias: float) -> tuple[float, int]:
    """Mean of the ``TOP`` largest segment logits of a whole text, the bias alone if it
    has no words; and the number of its segments."""
    top, n = np.empty(0), 0
    for words in word_blocks(text.lower(), 1 << 16):
        found = segment_logits(words, weight, bias)
        top, n = _highest(np.concatenate((top, found))), n + len(found)
    return (float(top.mean()) if len(top) else bias), n


def worst(text: bytes, weight: np.ndarray, bias: float) -> float:
    """Mean of the ``TOP`` largest segment logits of a whole text."""
    return measures(text, weight, bias)[0]


def _chance(weight: np.ndarray, bias: float, rng) -> list[tuple[float, int]]:
    """What :func:`measures` gives for unknown texts of several lengths, whose n-grams
    share rows of the table with others by chance."""
    out = [(bias, 0)]
    for n in LENGTHS:
        for _ in range(DRAWS):
            found = np.concatenate(
                [weight[rng.integers(0, ROWS, (min(n - low, 4096), GRAMS))].mean(axis=1) for low in range(0, n, 4096)]
            )
            out.append((float(_highest(found).mean()) + bias, n))
    return out


def probability(logit: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _train(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int, rng) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adam on batches; returns n-gram logits and bias."""
    table = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    base = np.zeros(2, np.float32)
    params = [table, soft, base]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    lengths = np.array([len(b) for b in bags])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for cut in range(0, len(order), 1024):
            pick = order[cut : cut + 1024]
            ids = np.concatenate([bags[i] for i in pick])
            size = lengths[pick]
            starts = np.cumsum(size) - size
            mean = np.add.reduceat(table[ids], starts, axis=0) / size[:, None]
            logit = mean @ soft + base
            chance = np.exp(logit - logit.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(pick)), label[pick]] -= 1
            off = chance * (weight[pick] / weight[pick].sum())[:, None]
            pull = np.repeat((off @ soft.T) / size[:, None], size, axis=0)
            to_table = np.stack([np.bincount(ids, pull[:, d], ROWS) for d in range(DIM)], axis=1)
            step += 1
            for p, m, v, g in zip(params, first, second, (to_table, mean.T @ off, off.sum(axis=0))):
                m += 0.1 * (g.astype(np.float32) - m)
                v += 0.01 * (g.astype(np.float32) ** 2 - v)
                p *= 1 - DECAY
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    logits = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    met = np.zeros(ROWS, bool)
    met[np.concatenate(bags)] = True
    # What no text of the sample showed says nothing either way.
    return np.where(met, logits, 0).astype(np.float32), float(base[1] - base[0])


def fit(
    sample: list[tuple[bytes, int]], prior: tuple[float, float] = (1, 1), rounds: int = 3, epochs: int = 6, seed: int = 11,
    whole: Callable[[np.ndarray, float], list[tuple[float, int, int]]] | None = None,
) -> Model:
    """Train on labelled texts. With one class only, the score is that class's share.

    ``prior`` weighs a text of class 0 and 1 in the curve, where the sample does not
    have the classes in their natural shares. ``whole`` gives mean, number of segments
    and label of each text for the curve where the sample holds parts of some.
    """
    rng = np.random.default_rng(seed)
    docs = [(t.lower(), int(y)) for t, y in sample if t.split()]
    label = np.array([y for _, y in docs], np.int64)
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        return Model(np.zeros(ROWS, np.float32), 0.0, 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    seen = np.zeros((2, ROWS))
    for text, y in docs:
        seen[y, np.unique(grams(text.split())[0])] += 1
    n1, n0 = label.sum(), (1 - label).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    share = seen.sum(axis=0) / (n1 + n0)
    gap = seen[1] / n1 - seen[0] / n0
    sure = np.abs(gap) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12) >= SURE
    weight, bias = np.where(sure, odds, 0).astype(np.float32), 0.0
    for _ in range(rounds):
        bags, y, w = [], [], []
        for text, kind in docs:
            words = text.split()
            found = grams(words)
            if len(found[0]):
                logits = _logits(found, len(words), weight, bias)
                picks = np.argsort(-logits, kind="stable")[:PICKS].tolist()
                if not kind:
                    picks += rng.integers(0, len(logits), PICKS).tolist()
                for k in picks:
                    inside = (found[1] >= found[2][k]) & (found[1] < found[2][k] + SEGMENT)
                    if inside.any():
                        bags.append(found[0][inside].astype(np.int32))
                        y.append(kind)
                        w.append(1.0)
        weight, bias = _train(bags, np.array(y), np.array(w), epochs, rng)
    if whole:
        known = whole(weight, bias)
    else:
        known = [(*measures(text, weight, bias), y) for text, y in docs]
    label = np.array([y for _, _, y in known], np.int64)
    share = np.where(label == 1, prior[1], prior[0])
    # A text of which nothing is known is no toxic one, whatever its length.
    chance = _chance(weight, bias, rng)
    unknown = UNKNOWN * share[label == 0].sum() / len(chance)
    top, n = (np.array(x, float) for x in zip(*[k[:2] for k in known], *chance))
    curve = np.append(label, np.zeros(len(chance))), np.append(share, np.full(len(chance), unknown))
    slope, tilt, shift = _curve(np.stack([top, np.log1p(n)], axis=1), *curve)
    if tilt > 0:
        # Length alone is no evidence.
        (slope, shift), tilt = _curve(top[:, None], *curve), 0.0
    return Model(weight, bias, slope, shift, tilt)


def _curve(at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[float]:
    """Factors and shift of a logistic curve, by Newton steps with a weak prior."""
    spread, middle = np.maximum(at.std(axis=0), 1e-6), at.mean(axis=0)
    x = np.column_stack([(at - middle) / spread, np.ones(len(at))])
    beta, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(50):
        p = probability(x @ beta)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(hess, x.T @ (weight * (label - p)) - 0.05 * beta), -2, 2)
    factors = beta[:-1] / spread
    return [*factors.tolist(), float(beta[-1] - factors @ middle)]


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, rows: int, size: int
) -> tuple[list[tuple[bytes, int]], tuple[float, float]]:
    """At most ``rows`` texts of each class by hash order, of a longer one a stretch of
    ``size`` bytes; and how many labels one of them stands for."""
    out, prior = [], [1.0, 1.0]
    for kind, found, known in _picked(docs, labels, rows):
        prior[kind] = max(known / rows, 1.0)
        text, spare = F.encode("text", "utf-8"), F.greatest(F.octet_length("text") - size, F.lit(0))
        part = F.substring(text, F.pmod(F.xxhash64("id"), spare + 1).cast("int") + 1, F.lit(size))
        kept = found.select("id", part.alias("text"), (spare > 0).alias("cut")).orderBy("id", "text").limit(rows)
        for r in kept.collect():
            # The first and the last word of a stretch may be halves.
            held = bytes(r["text"])
            out.append((b" ".join(held.split()[1:-1]) or held if r["cut"] else held, kind))
    return out, tuple(prior)


def whole_texts(docs: DataFrame, labels: DataFrame, rows: int, model: tuple[np.ndarray, float]) -> list[tuple[float, int, int]]:
    """:func:`measures` and label of the texts the sample is taken from, at full length."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t, *kept.value) for t in texts(batch.column("text"))]
            top, n = pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.int64())
            yield pa.record_batch([batch.column("id"), top, n], ["id", "top", "n"])

    out = []
    for kind, found, _ in _picked(docs, labels, rows):
        rated = found.select("id", "text").mapInArrow(work, "id long, top double, n long").where("n > 0")
        out += [(r["top"], r["n"], kind) for r in rated.orderBy("id", "top", "n").limit(rows).collect()]
    return out


def _picked(docs: DataFrame, labels: DataFrame, rows: int) -> Iterator[tuple[int, DataFrame, int]]:
    """Class, texts of the first ``rows`` labels of it by hash, and number of its labels."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    for kind in (1, 0):
        of = known.where(F.col("toxic") == kind)
        picked = of.orderBy(F.xxhash64("id"), "id").limit(rows)
        found = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).where(F.octet_length("text") > 0)
        yield kind, found.select(F.col("id").cast("long"), "text"), of.count()


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; a missing one is scored as empty.

    A column that has the name of the new one is replaced.
    """
    curve = (model.bias, model.slope, model.shift, model.tilt)
    kept = docs.sparkSession.sparkContext.broadcast(model.weight)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, (bias, slope, shift, tilt) = kept.value, curve
        for batch in batches:
            rated = [measures(t, weight, bias) for t in texts(batch.column("text"))]
            top, n = np.array(rated, np.float64).reshape(-1, 2).T
            found = pa.array(probability(slope * top + tilt * np.log1p(n) + shift), pa.float64())
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, name])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled texts that are not held out.

    The sample is bounded by ``rows`` of each class and ``size`` bytes of a text, so
    its size does not grow with the tables; the curve looks at these texts as a whole. Only ``doc_id`` and ``toxic`` of ``labels``
    are read; rows where either is missing or no class are left out, and of several
    labels of a doc_id the higher one counts.
    """
    return fit(*training_sample(docs, labels, rows, size), whole=lambda *model: whole_texts(docs, labels, rows, model))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Scores depend on nothing but the text. Missing texts score as empty ones, which
    score as a text without a toxic segment; a row without a doc_id is not held out.
    Repeated rows each give a row, an empty table gives none. Without labels of both
    classes all scores are the share of the one there is.
    """
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all columns."""
    scored = score(docs, learn(docs, labels), "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")
