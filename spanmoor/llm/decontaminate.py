"""Benchmark decontamination by spaced-seed hashing, in SQL functions only.

A mask looks at some of the tokens in a span and ignores the rest. Test items
and documents are hashed under the same masks at every position; equal hashes
give an alignment, and the tokens around it are compared one by one. The two
default masks leave at least one hit in any 13 aligned tokens of which 2 are
substituted (checked over all choices in the tests).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SUBSTITUTIONS = 13, 2
#: Items with fewer words say too little to identify a leak and are left out.
LEAST_WORDS = 5
#: Where short items count too: a mask for items of fewer words than the window,
#: but no fewer than its span. With MASKS it leaves a hit if one is substituted.
SHORT_MASK = (0, 2, 3, 4, 5, 6, 8)
#: The most seeds that are broadcast at once, 16 bytes each; more items are
#: looked up in as many passes.
MOST_SEEDS = 2_000_000
_SPAN = 9


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; none for null and blank texts."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), SPACE)
    return F.when(F.rlike(text, F.lit(WORD)), F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def seeds_of(rows: DataFrame, masks: list[tuple[int, ...]], fits: list[Column] | None = None) -> DataFrame:
    """A row for each mask and position where it lies within the token hashes
    ``_h``, and ``fits`` holds: also _at, _mask (its number) and seed. Positions
    come first and hashes then, as plain expressions: they are compiled, which
    functions over arrays are not, and ``_h`` is copied for no row."""
    # From an inner explode Spark would infer a filter and hash the words twice.
    rows = rows.select("*", F.posexplode_outer("_h").alias("_at", "_token")).drop("_token")
    last = F.size("_h") - F.col("_at") - 1

    def seed(m: int, mask: tuple[int, ...]) -> Column:
        fine = last >= mask[-1]
        return F.when(fine if fits is None else fine & fits[m], F.xxhash64(F.lit(m), *[F.get("_h", F.col("_at") + o) for o in mask]))

    return rows.select("*", F.posexplode(F.array(*[seed(m, mask) for m, mask in enumerate(masks)])).alias("_mask", "seed")).where("seed is not null")


def _around(h: str, i: Column) -> Column:
    """Tokens from 12 before to 20 after ``i``; null outside the text."""
    return F.transform(F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW + _SPAN - 2)), lambda k: F.get(F.col(h), i + k))


def leaks(docs: DataFrame, items: DataFrame, key: Column, text: Column, short: bool = False) -> DataFrame:
    """(doc_key, item_id, matched): pairs of a document and an item of
    ``items`` (item_id, text) that share WINDOW aligned tokens, all but
    SUBSTITUTIONS of them equal; ``matched`` is the most equal tokens in such a
    window. An item shorter than the window must occur whole, and one of fewer
    than LEAST_WORDS is left out. With ``short``, none is left out, and one of
    at least 9 words may have one substituted.

    Words are lower-cased and split at ASCII white space. Null or empty texts
    and items match nothing; repeated rows give a pair once; keys may be null.
    Documents are read in one pass for each MOST_SEEDS seeds of the items, of
    which a pass broadcasts no more; only hits leave it. Texts of any length are
    read whole; other columns of ``docs``, whatever their names, are not read.
    """
    tests = items.select("item_id", token_hashes(F.col("text")).alias("_h")).where(F.size("_h") >= (1 if short else LEAST_WORDS))
    tests = materialize(tests.groupBy("item_id", "_h").agg(F.size("_h").alias("_n")))
    lengths = sorted(r[0] for r in tests.where(F.col("_n") < WINDOW).select("_n").distinct().collect())
    # An item shorter than a mask's span is one seed of its own length.
    masks = [(mask, F.lit(True)) for mask in MASKS] + [(tuple(range(n)), F.col("_n") == n) for n in lengths if n < _SPAN]
    if short and lengths and lengths[-1] >= _SPAN:
        masks.append((SHORT_MASK, F.col("_n").between(_SPAN, WINDOW - 1)))
    fits, masks = [fit for _, fit in masks], [mask for mask, _ in masks]
    seeds = seeds_of(tests, masks, fits).select("item_id", "_n", "_mask", "seed", _around("_h", F.col("_at")).alias("_theirs"))
    seeds = materialize(seeds)
    keys = materialize(seeds.select("seed", "_mask").distinct())
    passes = max(1, math.ceil(keys.count() / MOST_SEEDS))
    rows = seeds_of(docs.select(key.alias("doc_key"), token_hashes(text).alias("_h")), masks)
    part = lambda b: (keys if passes == 1 else keys.where(F.pmod("seed", F.lit(passes)) == b)).select("seed").distinct()
    rows = reduce(DataFrame.unionAll, [rows.join(F.broadcast(part(b)), "seed") for b in range(passes)])
    rows = rows.select("doc_key", "seed", "_mask", _around("_h", F.col("_at")).alias("_near"))
    pairs = rows.join(seeds, ["seed", "_mask"])
    equal = F.transform(F.arrays_zip("_near", "_theirs"), lambda z: F.coalesce((z["_near"] == z["_theirs"]).cast("int"), F.lit(0)))
    pairs = pairs.select("doc_key", "item_id", F.least("_n", F.lit(WINDOW)).alias("_need"), equal.alias("_equal")).distinct()
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(WINDOW + _SPAN - 1)), lambda i: F.aggregate(F.slice("_equal", i, WINDOW), F.lit(0), lambda a, b: a + b)))
    pairs = pairs.withColumn("matched", best)
    allowed = F.when(F.col("_need") == WINDOW, F.lit(SUBSTITUTIONS)).when(F.lit(short) & (F.col("_need") >= _SPAN), F.lit(1)).otherwise(F.lit(0))
    return pairs.where(F.col("matched") >= F.col("_need") - allowed).groupBy("doc_key", "item_id").agg(F.max("matched").alias("matched"))


def leaked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched: the documents that hold a part of an item."""
    return leaks(docs, items, F.col("doc_id"), F.col("text")).withColumnRenamed("doc_key", "doc_id")


def drop_leaks(docs: DataFrame, items: DataFrame, short: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a part of an item, found by text
    fingerprint, so that repeated and null ids are told apart."""
    print_ = F.md5(F.coalesce("text", F.lit("")))
    bad = materialize(leaks(docs, items, print_, F.col("text"), short).select(F.col("doc_key").alias("_leaked")).distinct())
    return docs.join(bad, F.md5(F.coalesce(docs["text"], F.lit(""))) == bad["_leaked"], "left_anti")


LEAKS_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM dw),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS j FROM bw WHERE len(w) >= 5),
m AS (SELECT DISTINCT doc_id, item_id, n, i - j AS diagonal, j FROM d JOIN b USING (w)),
r AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM m)
SELECT doc_id, item_id, CAST(max(c) AS INT) AS matched FROM r
GROUP BY doc_id, item_id, n HAVING max(c) >= CASE WHEN n < 13 THEN n ELSE 11 END
"""
