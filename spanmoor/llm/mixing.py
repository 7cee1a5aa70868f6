"""Mixing sources to target weights.

Every row gets a hash-random key. Keys are cut into fixed ranges; the sums of
sizes by source and key range, summed up along the ranges, are distributed
prefix sums over each source in key order. The one range of a source that holds
its cut is sorted exactly. A row's share then follows from its key alone, so
neither rows nor texts are shuffled to be taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also target. Sources in code-point order, null
    last, take the weights in turn. ``share`` of all sizes is dealt by weight;
    no target exceeds ``most`` times its source's size, and what is cut off is
    dealt again by weight (water-filling; a row for each source, no texts)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    fill = Window.orderBy("_ratio", "_weight", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    df = sizes.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("_ratio", F.col("_most") / F.col("_weight"))
    df = df.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / rest)
    df = df.withColumn("_place", F.row_number().over(fill))
    df = df.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_place", "_level"))).over(every))
    target = F.when(F.col("_place") >= F.col("_open._place"), F.col("_open._level") * F.col("_weight")).otherwise(F.col("_most"))
    return df.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    df: DataFrame,
    key: Column,
    source: Column,
    size: Column,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    digits: int = 4,
) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``taken`` (names that ``df``
    must not have, nor any that starts with two underscores), where ``taken`` sums to floor(target) over each source.

    Whole rounds over a source come first; the rest of its budget goes to the
    rows first in key order, the last of them in part. Rows that agree in key,
    source and size share their part evenly, rounded down. Null keys count as
    the empty string, null sources as a source of their own; empty tables give
    empty tables. ``digits``: hex digits of the key that number its range.
    """
    row = df.withColumns({"__source": source, "__size": size, "__key": F.md5(F.coalesce(key.cast("string"), F.lit("")))})
    narrow = row.select(F.col("__source").alias("source"), "__size", "__key")
    ranges = materialize(narrow.groupBy("source", F.substring("__key", 1, digits).alias("_range")).agg(F.sum("__size").alias("_words")))
    sources = materialize(source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most))
    budget = F.floor("target")
    sources = sources.withColumn("__rounds", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("_rest", budget - F.col("__rounds") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("_range")
    summed = ranges.withColumn("_upto", F.sum("_words").over(along)).withColumn("_before", F.col("_upto") - F.col("_words"))
    near = summed.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    near = near.where("_rest > 0 and _before < _rest and _rest <= _upto").select("s.source", "_range", "_before", "_rest")
    # Only the rows of the ranges that hold a cut are sorted.
    inside = narrow.alias("n").join(materialize(near).alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")) & (F.substring("__key", 1, digits) == F.col("_range")))
    ties = inside.groupBy("c.source", "_before", "_rest", "__key", "__size").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("source").orderBy("__key", "__size")
    ties = ties.withColumn("_upto", F.col("_before") + F.sum(F.col("__size") * F.col("_rows")).over(order))
    cut = ties.where("_upto >= _rest and _upto - __size * _rows < _rest")
    cut = cut.select("source", F.struct("__key", "__size").alias("__cut"), F.floor((F.col("_rest") - (F.col("_upto") - F.col("__size") * F.col("_rows"))) / F.col("_rows")).alias("__part"))
    plan = sources.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    plan = materialize(plan.select(F.col("s.source").alias("__of"), "source_size", "target", "__rounds", "__cut", "__part"))
    at = F.struct("__key", "__size")
    more = F.when(at < F.col("__cut"), F.col("__size")).when(at == F.col("__cut"), F.col("__part")).otherwise(F.lit(0))
    out = row.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
    return out.withColumn("taken", (F.col("__rounds") * F.col("__size") + more).cast("long")).select(*[df[c] for c in df.columns], "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    narrow = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(narrow, F.col("doc_id"), F.col("source"), F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def draw_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes at least a word of, each once for every
    round it takes part in, whole; columns as in ``docs``."""
    # Whole rows in a struct: no column of ``docs`` meets the inner names.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_of"), word_count(F.col("text")).alias("_words"))
    out = mix(rows, F.col("_id"), F.col("_of"), F.col("_words"))
    times = F.ceil(F.col("taken") / F.greatest(F.col("_words"), F.lit(1))).cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_round")).select("_row.*")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, CAST(source_size AS DOUBLE) * 2.0 AS most FROM s),
f AS (SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
             row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY most / weight, weight, source NULLS LAST)),
op AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM f WHERE most / weight > level),
t AS (SELECT source, source_size, CAST(CASE WHEN f.place >= op.place THEN op.level * weight ELSE most END AS DOUBLE) AS target FROM f, op),
r AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, size) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS rounds FROM r)
SELECT doc_id, size, source_size, target,
  CAST(rounds * size + greatest(0, least(size, budget - rounds * source_size - (upto - size))) AS BIGINT) AS taken FROM b
"""
