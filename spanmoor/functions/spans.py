"""Alignment of extracted strings to the tokens of their source."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_at(source: Column, wanted: Column) -> Column:
    """0-based place of ``wanted`` in ``source`` (arrays of match tokens), or null.

    Only the first place of the first token counts: a phrase that also occurs
    later, but not there, is no exact match."""
    n, p = F.size(wanted), F.array_position(source, F.get(wanted, F.lit(0))).cast("int")
    found = F.when((n > 0) & (p > 0), F.slice(source, F.greatest(p, F.lit(1)), F.greatest(n, F.lit(1))) == wanted)
    return F.when(found, p - 1)


def overlap_bound(source: Column, wanted: Column) -> Column:
    """Share of ``wanted`` that the whole source could cover: no window has more."""
    return _overlap(source, wanted) / F.size(wanted)


def _overlap(tokens: Column, wanted: Column) -> Column:
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_distinct(wanted), F.lit(0), lambda acc, t: acc + F.least(count(tokens, t), count(wanted, t)))


def fuzzy_by_windows(source: Column, wanted: Column) -> Column:
    """struct(ratio, at) of the first window with the greatest share of ``wanted``,
    in SQL functions; for sources as short as a chunk."""
    n = F.size(wanted)
    windows = F.when((n > 0) & (F.size(source) >= n), F.sequence(F.lit(0), F.size(source) - n)).otherwise(F.array().cast("array<int>"))
    scored = F.transform(windows, lambda i: F.struct((_overlap(F.slice(source, i + 1, n), wanted) / n).alias("ratio"), (-i).alias("_at")))
    best = F.array_max(scored)
    return F.struct(best["ratio"].alias("ratio"), (-best["_at"]).alias("at"))


def best_window(source: list[str], wanted: list[str]) -> tuple[float, int]:
    """(ratio, place) of the best window, kept up by one token in and one out."""
    n = len(wanted)
    if not n or len(source) < n:
        return 0.0, 0
    need = Counter(wanted)
    held: Counter[str] = Counter()
    overlap = most = at = 0
    for i, token in enumerate(source):
        if token in need:
            held[token] += 1
            overlap += held[token] <= need[token]
        if i >= n:
            gone = source[i - n]
            if gone in need:
                overlap -= held[gone] <= need[gone]
                held[gone] -= 1
        if i >= n - 1 and overlap > most:
            most, at = overlap, i - n + 1
    return most / n, at


_BEST = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("at", T.IntegerType())])


@F.arrow_udf(_BEST)
def fuzzy_by_counter(source: pa.Array, wanted: pa.Array) -> pa.Array:
    """As fuzzy_by_windows, in time linear in the source. Rows with a null pass."""
    out = []
    for s, w in zip(source, wanted):
        if not s.is_valid or not w.is_valid:
            out.append(None)
        else:
            ratio, at = best_window(s.as_py(), w.as_py())
            out.append({"ratio": ratio, "at": at})
    return pa.array(out, pa.struct([("ratio", pa.float64()), ("at", pa.int32())]))


@F.arrow_udf(T.ArrayType(_BEST))
def fuzzy_many(source: pa.Array, wanted: pa.Array) -> pa.Array:
    """As fuzzy_by_counter, for all the strings of a source, which comes once.
    Null sources and strings pass."""
    out = []
    for s, ws in zip(source, wanted):
        if not s.is_valid or not ws.is_valid:
            out.append(None)
            continue
        tokens = s.as_py()
        found = [None if w is None else best_window(tokens, w) for w in ws.as_py()]
        out.append([None if f is None else {"ratio": f[0], "at": f[1]} for f in found])
    return pa.array(out, pa.list_(pa.struct([("ratio", pa.float64()), ("at", pa.int32())])))
