"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into a table of
embeddings, so that misspellings share most of a word's vectors. A window of
words is the average of their embeddings, put through a linear softmax.
Embeddings and softmax are trained together in numpy on whole texts: the window
that a text is judged by is its most toxic one, in training as in scoring, so
that a few words count in a text of any length. Before there is a model, that is
the window whose n-grams are the most frequent among toxic texts, against others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mix64, powers

#: Table rows, embedding size, n-gram lengths, words in a window.
BUCKETS, DIM, GRAMS, WINDOW = 1 << 18, 8, (3, 4, 5, 6), 2
#: The most training rows of a label; their texts are whole.
SAMPLE = 1500
#: Table rows that fewer training texts touch keep the zero vector; texts of each
#: label that a row is counted in beyond those that touch it, in its first odds.
LEAST_TEXTS, SMOOTH = 6, 2.0
THRESHOLD = 0.7
#: Words held at once, and words whose sums are kept for the next texts.
HELD = 200_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¡¿"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, word of each) of words: each word itself and its n-grams, with
    its edges marked, hashed for all words at once. Rows of a word need not be
    together."""
    text = "".join([f"<{w}>" for w in words])
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    code = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - (ends - sizes)[word]
    power, _ = powers(int(sizes.max(initial=1)))
    rows, owner = [mix64(np.add.reduceat(code * power[place], ends - sizes))], [np.arange(len(words))]
    left, gram = ends[word] - np.arange(len(code)), np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):  # the hash of n from that of n - 1
        gram = gram[: len(code) - n + 1] * _BASE + code[n - 1 :]
        if n in GRAMS:
            whole = left[: len(gram)] >= n
            rows.append(mix64(gram[whole] + np.uint64(n)))
            owner.append(word[: len(gram)][whole])
    return (np.concatenate(rows) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owner)


def words_of(text: str | None) -> list[str]:
    return [w.strip(_EDGE) for w in (text or "").lower().split()]


def windows(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over each window of WINDOW words; a shorter text is one window."""
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    w = min(WINDOW, len(sums))
    return (s[w:] - s[:-w]) / np.maximum(1, c[w:] - c[:-w])


def train(texts: list[str], labels: np.ndarray, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """(weight of each table row, scale, offset): the score of a text is
    sigmoid(scale * greatest window mean of the weights + offset)."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    some = [i for i, d in enumerate(docs) if len(d)]
    docs, labels = [docs[i] for i in some], labels[some]
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS), 0.0, float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    flat, of_word = subwords(list(vocabulary))
    flat = flat[np.argsort(of_word, kind="stable")]
    sizes = np.bincount(of_word)
    first = np.concatenate([[0], np.cumsum(sizes)])
    touched = np.zeros((2, BUCKETS), np.int64)
    for d, label in zip(docs, labels):
        touched[label, np.unique(np.concatenate([flat[first[w] : first[w + 1]] for w in np.unique(d)]))] += 1
    live = (touched.sum(0) >= LEAST_TEXTS)[:, None]
    share = (touched + SMOOTH) / (np.bincount(labels, minlength=2)[:, None] + 2 * SMOOTH)
    odds = np.where(live[:, 0], np.log(share[1] / share[0]), 0.0)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)) * live
    soft = np.zeros((DIM, 2))
    grown_t, grown_s = np.full((BUCKETS, 1), 1e-6), np.full((DIM, 2), 1e-6)

    def means(row: np.ndarray) -> list[np.ndarray]:
        word = np.add.reduceat(row[flat], first[:-1])
        return [windows(word[d], sizes[d]) for d in docs]

    for turn in range(rounds):
        starts = [int(m.argmax()) for m in means(odds if turn < 2 else table @ (soft[:, 1] - soft[:, 0]))]
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
            bag = [docs[i][starts[i] : starts[i] + WINDOW] for i in batch]
            at = np.concatenate([flat[first[w] : first[w + 1]] for b in bag for w in b])
            n = np.array([sizes[b].sum() for b in bag])
            of = np.repeat(np.arange(len(bag)), n)
            mean = np.add.reduceat(table[at], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            z = mean @ soft
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(bag)), labels[batch]] -= 1
            grad_s, grad_m = mean.T @ p, (p @ soft.T) / n[:, None]
            rows, back = np.unique(at, return_inverse=True)
            grad_t = np.zeros((len(rows), DIM))
            np.add.at(grad_t, back, grad_m[of])
            grown_s += grad_s**2
            soft -= 0.5 * grad_s / np.sqrt(grown_s)
            grown_t[rows] += (grad_t**2).mean(1, keepdims=True)
            table[rows] -= live[rows] * (0.3 * grad_t / np.sqrt(grown_t[rows]) + 1e-3 * table[rows])
    row = table @ (soft[:, 1] - soft[:, 0])
    scale, offset = calibrate(np.array([m.max() for m in means(row)]), labels)
    return row, scale, offset


def calibrate(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable, by Newton steps with a weak prior."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    middle, spread = x.mean(), x.std() + 1e-9
    v = np.stack([(x - middle) / spread, np.ones(len(x))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ b, -30, 30)))
        h = (v * (p * (1 - p))[:, None]).T @ v + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, v.T @ (p - target) + 1e-3 * b), -2, 2)
    return float(b[0] / spread), float(b[1] - b[0] * middle / spread)


def scorer(weights: np.ndarray, scale: float, offset: float):
    """A column function of a text column: its score from 0 to 1."""
    weights = weights.astype(np.float32)
    empty = 1 / (1 + float(np.exp(-np.clip(offset, -30, 30)))) if not scale else 0.0
    known: dict[str, complex] = {}  # weight sum and number of rows of a word

    def looked_up(texts: list[list[str]]) -> None:
        if len(known) > HELD:
            known.clear()
        if new := list({w for t in texts for w in t} - known.keys()):
            at, of = subwords(new)
            known.update(zip(new, (np.bincount(of, weights[at], len(new)) + 1j * np.bincount(of, minlength=len(new))).tolist()))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for i, t in enumerate(text):
            held.append(words_of(t.as_py()))
            size += len(held[-1])
            if size > HELD or i == len(text) - 1:
                looked_up(held)
                for words in held:
                    if not words:
                        out.append(empty)
                        continue
                    v = np.fromiter(map(known.__getitem__, words), complex, len(words))
                    x = scale * windows(v.real, v.imag).max() + offset
                    out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))
                held, size = [], 0
        return pa.array(np.array(out, float).round(9))

    return score


def held_out(doc_id) -> F.col:
    """Rows whose labels are never learned from; null ids are among the rest."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Up to ``sample`` texts of each label, chosen by hash among labelled rows
    that aren't held out, whole. Of a repeated id the greatest text counts."""
    told = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    ids = [told.where(F.col("_toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = ids[0].unionAll(ids[1]).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = rows.groupBy("doc_id").agg(F.max(F.struct("text", "_toxic")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    return found["text"].tolist(), found["_toxic"].to_numpy(np.int64)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; null and
    empty texts score 0. Repeated rows score alike; texts of any length are read
    whole; other columns of ``docs``, whatever their names, are not read."""
    score = scorer(*train(*training_rows(docs, labels)))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
