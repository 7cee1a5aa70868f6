"""Exact top-k search by Fagin's threshold algorithm.

Vectors are dealt into shards. A task sorts a shard once along every dimension
and lets the queries stream past it. A query walks down the lists from the end
that its component favours, scores what it meets, and stops when the sum of the
lists' current values cannot reach its kth best score. The best of all shards
are then merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors to a shard, and queries to an Arrow batch at most.
SHARD, BLOCK = 16_384, 1024


def best_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


class SortedLists:
    """A shard of integer vectors with a sorted list of rows for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.most = most
        self.vectors = vectors
        self.exact = vectors.astype(np.float64)
        self.lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)

    def search(self, query_id: int, query: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own."""
        n = len(self.ids)
        # Doubles are exact below 2**53; beyond it, Python's integers are used.
        size = self.most * float(np.abs(query.astype(np.float64)).sum())
        table = self.exact if size < 2**53 else self.vectors if size < 2**62 else self.vectors.astype(object)
        q = query.astype(np.float64) if size < 2**53 else query if size < 2**62 else query.astype(object)
        live = np.flatnonzero(query)
        up = query[live] < 0  # a negative component favours small values
        seen = self.ids == query_id
        found, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        depth = 0
        while depth < n:
            end = min(n, depth + step) if len(live) else n
            if end == n:
                new = np.flatnonzero(~seen)
            else:
                met = np.zeros(n, bool)
                met[self.lists[depth:end][:, live[up]].ravel()] = True
                met[self.lists[n - end : n - depth][:, live[~up]].ravel()] = True
                new = np.flatnonzero(met & ~seen)
            seen[new] = True
            found = np.concatenate([found, new])
            scores = np.concatenate([scores, table[new] @ q])
            kept = best_k(scores, self.ids[found], k)
            found, scores = found[kept], scores[kept]
            depth, step = end, step * 2
            if depth < n and len(scores) == k:
                last = np.where(up, self.lists[depth - 1][live], self.lists[n - depth][live])
                bound = (table[last, live] * q[live]).sum()
                if scores[-1] > bound:  # at equality an unseen row could still win a tie
                    break
        return self.ids[found], scores


def _stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows whose keys agree."""
    n = len(keys[0])
    edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if n else np.zeros(0, int)
    return list(zip([0, *edges.tolist()], [*edges.tolist(), n])) if n else []


def _searched(batches, k: int, block: int):
    """Rows (_shard, _length, _asks, vec_id, _vector), sorted by the first three,
    so that a shard's queries follow its vectors -> (query_id, vec_id, score).
    Held are one shard and one batch."""
    key, ids, vectors, lists = None, [], [], None
    for batch in batches:
        shard, length, asks, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for a, b in _stretches(shard, length, asks):
            values = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            if key != (shard[a], length[a]):
                key, ids, vectors, lists = (shard[a], length[a]), [], [], None
            if not asks[a]:
                ids.append(vec_id[a:b])
                vectors.append(values)
                continue
            if lists is None:
                n = sum(map(len, ids))
                lists = SortedLists(np.concatenate(ids) if n else np.zeros(0, np.int64), np.concatenate(vectors) if n else np.zeros((0, values.shape[1]), np.int64))
                ids, vectors = [], []
            for c in range(a, b, block):
                found = [lists.search(int(q), v, k) for q, v in zip(vec_id[c : min(b, c + block)], values[c - a :])]
                query = np.repeat(vec_id[c : c + len(found)], [len(i) for i, _ in found])
                score = np.concatenate([s.astype(np.int64) for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([i for i, _ in found])), pa.array(score)], names=["query_id", "vec_id", "score"])


def integer_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, _vector, _length): floor(1024 x) of each component; rows with a
    null id, or whose vector is null, empty or holds null or non-finite
    components, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 1024).cast("long")).alias("_vector"), F.size("embedding").alias("_length"))


def top_k(df: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    ``every``, the k rows with the greatest integer inner products among all
    rows with another vec_id, ties to the smaller vec_id (fewer if there are
    fewer). Only vectors of the same length are compared. Rows that repeat a
    vec_id are candidates each; a query that repeats one is answered once, by
    its greatest vector. Other columns of ``df``, whatever their names, are not
    read."""
    rows = integer_vectors(df)
    asked = F.col("vec_id") % every == 0
    shards = max(1, math.ceil(rows.count() / shard))
    queries = rows.where(asked).groupBy("vec_id").agg(F.max("_vector").alias("_vector")).withColumns({"_length": F.size("_vector"), "_asks": F.lit(True)})
    queries = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumns({"_asks": F.lit(False), "_shard": F.pmod(F.xxhash64("vec_id", "_vector"), F.lit(shards)).cast("int")})
    # Each vector goes to one shard, each query once to every shard.
    columns = ("_shard", "_length", "_asks", "vec_id", "_vector")
    dealt = rows.select(*columns).unionAll(queries.select(*columns)).repartition(shards, "_shard").sortWithinPartitions("_shard", "_length", "_asks")
    found = dealt.mapInArrow(lambda batches: _searched(batches, k, block), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
