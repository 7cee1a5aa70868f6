"""Quality by importance resampling.

Texts are bags of hashed byte n-grams. Two generative models, one of labelled
good texts and one of all texts, give each n-gram a log ratio of likelihoods. A
text counts as a passage of one length: its log weight is PASSAGE times the mean
log ratio of its n-grams, PRIOR n-grams of ratio 1 added, so that long texts do
not outweigh short ones. Documents are drawn without replacement in proportion to
their weights: the k greatest sums of log weight and Gumbel noise. ``k`` is the
number of good documents that the labels lead to expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, free_name, materialize, slices, text_buffers, word_hashes

#: Hash buckets, the n-gram's bytes, pseudo-counts a bucket gets, and the
#: greatest number of labelled rows that the target model is fitted on.
HASHED, GRAM, SMOOTH, SAMPLE = 1 << 16, 4, 16.0, 20_000
#: Two more buckets: for a word that repeats the one before it, or doesn't.
BUCKETS = HASHED + 2
#: The n-grams that a text counts as, and those of ratio 1 that are mixed in.
PASSAGE, PRIOR = 100.0, 50.0
#: Seed of the Gumbel noise, and steps of a log weight's unit in which weights
#: are counted to estimate ``k``.
SEED, STEPS = 7, 10


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each byte; the last positions have none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.zeros(n, np.uint32)
    for i in range(GRAM):
        x = x << np.uint32(8) | data[i : n + i]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x >> np.uint32(16)).astype(np.int64)


def all_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of what the texts hold, and the text of each: the byte n-grams
    within a text, and its pairs of neighbouring words."""
    at = gram_buckets(data)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[: len(at)] == of[GRAM - 1 :][: len(at)] if len(at) else np.zeros(0, bool)
    words, owner = word_hashes(data, offsets)
    pair = owner[1:] == owner[:-1]
    again = np.where(words[1:] == words[:-1], HASHED, HASHED + 1)[pair]
    return np.concatenate([at[inside], again]), np.concatenate([of[: len(at)][inside], owner[1:][pair]])


def count_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets over the rows (text, good) that are good, and over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, SLICE):
                at, of = all_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts[0] += np.bincount(at, minlength=BUCKETS)
                if good[a:b].any():
                    counts[1] += np.bincount(at[good[a:b][of]], minlength=BUCKETS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "every", "good"])

    found = docs.mapInArrow(run, "bucket long, every long, good long").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[:, found["bucket"]] = found[["good", "every"]].to_numpy().T
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The log ratio of each bucket. ``labels`` (doc_id, good): the target model
    takes up to ``sample`` good ids, chosen by hash; the other model all rows.
    Without good rows every ratio is 0."""
    chosen = labels.where("good and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    good, every = count_grams(rows.select("text", F.col("_id").isNotNull().alias("good")))
    if not good.sum():
        return np.zeros(BUCKETS)
    # Pseudo-counts on both sides pull the ratio of a rare bucket towards 1.
    return np.log((good + SMOOTH) / (every * (good.sum() / every.sum()) + SMOOTH))


def log_weight(table: np.ndarray):
    """A column function of a text column: its log weight; null for a text
    without n-grams, null texts among them."""
    table = table.astype(np.float32)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = text_buffers(text)
        out, n = np.zeros(len(text)), np.zeros(len(text), np.int64)
        for a, b in slices(offsets, SLICE):
            at, of = all_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n[a:b] = np.bincount(of, minlength=b - a)
            out[a:b] = np.bincount(of, table[at], minlength=b - a) / (n[a:b] + PRIOR)
        return pa.array((PASSAGE * out).round(6), mask=n == 0)

    return score


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key.cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(df: DataFrame, value: str, k: int) -> float | None:
    """The kth greatest of a column of finite doubles, by four rounds of counts
    over 16 bits of its order-preserving bits: no sort, 65,536 counts a round."""
    if k <= 0:
        return None
    scaled = F.round(F.col(value) * 1e6).cast("long") + F.lit(1 << 62)
    rows, prefix = df.select(scaled.alias("_v")), 0
    for shift in (48, 32, 16, 0):
        at = F.shiftrightunsigned("_v", shift).bitwiseAND(F.lit(0xFFFF))
        here = rows.where(F.shiftrightunsigned("_v", shift + 16) == prefix) if shift < 48 else rows
        for part, n in sorted(here.groupBy(at.alias("p")).count().collect(), reverse=True):
            if n >= k:
                prefix = prefix << 16 | part
                break
            k -= n
        else:
            return float("-inf")
    return (prefix - (1 << 62)) / 1e6


def expected_good(counts: list[tuple[int, int | None, int]]) -> float:
    """The share of good rows, from (step of the weight, label or null, rows).

    Labelled rows need not be a fair sample of good and bad ones. So the weights
    are cut where the labels part best (greatest difference of the shares of good
    and of bad rows above), and the share of all rows above is corrected for the
    good rows below and the bad ones above. Without labels of both kinds: 1."""
    steps = sorted({s for s, _, _ in counts})
    at = {s: i for i, s in enumerate(steps)}
    rows = np.zeros((3, len(steps) + 1))  # bad, good, all; no row is at or above the last
    for s, label, n in counts:
        rows[2, at[s]] += n
        if label is not None:
            rows[label, at[s]] += n
    if not rows[0].sum() or not rows[1].sum():
        return 1.0
    bad, good, every = (np.cumsum(r[::-1])[::-1] / r.sum() for r in rows)
    best = int((good - bad).argmax())
    if good[best] <= bad[best]:
        return 1.0
    return float(np.clip((every[best] - bad[best]) / (good[best] - bad[best]), 0, 1))


class Resampler:
    """Fitted on documents and labels (doc_id, good). ``scored`` has every row:
    ``columns`` of the documents, log_weight, draw and, in ``kept``, the choice."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, columns: tuple[str, ...] = ("doc_id",), seed: int = SEED):
        table = fit(docs, labels, sample)
        self.weight, self.draw, self.kept = (free_name(c, docs.columns) for c in ("log_weight", "draw", "kept"))
        rows = docs.select(*columns, log_weight(table)(F.col("text")).alias(self.weight))
        rows = materialize(rows.withColumn(self.draw, F.round(F.col(self.weight) + gumbel(F.col("doc_id"), seed), 6)))
        self.k, self.least = 0, None
        if table.any():
            told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("good").cast("int")).alias("_good"))
            some = rows.select("doc_id", F.floor(F.col(self.weight) * STEPS).alias("_step")).where("_step is not null")
            counts = some.join(told, F.col("doc_id") == F.col("_id"), "left").groupBy("_step", "_good").count().collect()
            self.k = round(expected_good([tuple(r) for r in counts]) * sum(r["count"] for r in counts))
            self.least = kth_greatest(rows.where(F.col(self.draw).isNotNull()), self.draw, self.k)
            chosen = F.lit(False) if self.least is None else F.coalesce(F.col(self.draw) >= F.lit(self.least) - 5e-7, F.lit(False))
        else:  # nothing tells good from bad
            chosen = F.lit(True)
        self.scored = rows.withColumn(self.kept, chosen)


def good_labels(labels: DataFrame) -> DataFrame:
    """Rows of ``labels`` without a quality of 0 or 1 tell nothing."""
    return labels.where(F.col("quality").isin(0, 1)).select("doc_id", (F.col("quality") == 1).alias("good"))


def score_documents(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, draw, kept for every row of ``docs``.

    Texts without n-grams, null and empty ones among them, have no weight and no
    draw and are not kept, unless no label is good: then every row is kept. Ties
    at the least draw all stay, so rows that repeat an id and a text are kept or
    not together. Other columns of ``docs``, whatever their names, are not read;
    texts of any length are read whole."""
    return Resampler(docs, good_labels(labels), seed=seed).scored


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``score_documents`` that are kept."""
    return score_documents(docs, labels).where("kept")


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are scored
    once: rows are written with their draws and read again."""
    r = Resampler(docs, good_labels(labels), columns=tuple(docs.columns))
    return r.scored.where(F.col(r.kept)).select(*docs.columns)
