"""Alignment of extracted strings to byte spans of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import exact_at, fuzzy_by_counter, fuzzy_by_windows, fuzzy_many, overlap_bound
from ..functions.tokens import byte_at, match_places, match_tokens, token_texts

FUZZY_THRESHOLD = 0.75


def prepare(df: DataFrame, source: str = "text", to: str = "_source") -> DataFrame:
    """Adds struct<parts, places, tokens> of the source: its tokens, the places
    of its match tokens and these, once for all the strings to be aligned to it."""
    rows = df.withColumn("_parts", token_texts(F.col(source)))
    made = F.struct(F.col("_parts").alias("parts"), match_places(F.col("_parts")).alias("places"), match_tokens(F.col("_parts")).alias("tokens"))
    # An explode of one: what is above reads the arrays, instead of having them
    # made again for each use.
    return rows.withColumn("_made", made).select(*[df[c] for c in df.columns], F.explode(F.array("_made")).alias(to))


def _check(threshold: float, strategy: str) -> None:
    if not 0 < threshold:
        raise ValueError("fuzzy_threshold must be positive")
    if strategy not in ("windows", "counter"):
        raise ValueError(f"unknown strategy {strategy!r}")


def align_many(df: DataFrame, wanted: str, threshold: float = FUZZY_THRESHOLD, source: str = "_source", strategy: str = "counter", to: str = "_found") -> DataFrame:
    """As align_prepared, for ``wanted``, an array of strings: adds an array of
    struct<byte_start, byte_end, status>, and drops ``source``, which is neither
    copied nor sent to Python for each of its strings."""
    _check(threshold, strategy)
    tokens, parts, places = (F.col(f"{source}.{c}") for c in ("tokens", "parts", "places"))
    rows = df.withColumn("_wanted", F.transform(wanted, lambda t: match_tokens(token_texts(t))))
    rows = rows.withColumn("_exact", F.transform("_wanted", lambda w: exact_at(tokens, w)))

    def open_(w: Column, i: Column) -> Column:
        n = F.size(w)
        return F.when(F.get("_exact", i).isNull() & (n > 0) & (F.size(tokens) >= n) & (overlap_bound(tokens, w) >= threshold), w)

    rows = rows.withColumn("_open", F.transform("_wanted", open_))
    if strategy == "windows":
        best = F.transform("_open", lambda w: F.when(w.isNotNull(), fuzzy_by_windows(tokens, w)))
    else:
        best = fuzzy_many(F.when(F.exists("_open", lambda w: w.isNotNull()), tokens), F.col("_open"))
    rows = rows.withColumn("_best", best)

    def found(w: Column, i: Column) -> Column:
        exact, fuzzy = F.get("_exact", i), F.get("_best", i)
        place = F.coalesce(exact, F.when(fuzzy["ratio"] >= threshold, fuzzy["at"]))
        return F.struct(
            byte_at(parts, F.get(places, place)).alias("byte_start"),
            (byte_at(parts, F.get(places, place + F.size(w) - 1) + 1)).alias("byte_end"),
            F.when(exact.isNotNull(), "exact").when(place.isNotNull(), "fuzzy").otherwise("not_found").alias("status"),
        )

    rows = rows.withColumn("_result", F.transform("_wanted", found))
    # The explode of one: see align_prepared.
    return rows.select(*[df[c] for c in df.columns if c != source], F.explode(F.array("_result")).alias(to))


def align_prepared(df: DataFrame, wanted: str, threshold: float = FUZZY_THRESHOLD, source: str = "_source", strategy: str = "counter") -> DataFrame:
    """Adds byte_start, byte_end (null if not found) and status: exact, fuzzy or
    not_found. ``strategy``: "windows" searches in SQL functions, for short
    sources; "counter" in Arrow batches, for sources of any length. Either way
    only for strings that have no exact match and whose tokens could reach the
    threshold. Null strings and sources are not found. Thresholds must be
    positive."""
    _check(threshold, strategy)
    tokens = F.col(f"{source}.tokens")
    rows = df.withColumn("_wanted", match_tokens(token_texts(F.col(wanted))))
    rows = rows.withColumn("_exact", exact_at(tokens, F.col("_wanted")))
    n = F.size("_wanted")
    could = F.col("_exact").isNull() & (n > 0) & (F.size(tokens) >= n) & (overlap_bound(tokens, F.col("_wanted")) >= threshold)
    rows = rows.withColumn("_could", F.coalesce(could, F.lit(False)))
    if strategy == "windows":
        best = F.when(F.col("_could"), fuzzy_by_windows(tokens, F.col("_wanted")))
    else:
        best = fuzzy_by_counter(F.when(F.col("_could"), tokens), F.when(F.col("_could"), F.col("_wanted")))
    rows = rows.withColumn("_best", best)
    fuzzy = F.when(F.col("_best.ratio") >= threshold, F.col("_best.at"))
    rows = rows.withColumn("_place", F.coalesce("_exact", fuzzy))
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_place").isNotNull(), "fuzzy").otherwise("not_found")
    place = F.struct(
        byte_at(F.col(f"{source}.parts"), F.get(F.col(f"{source}.places"), F.col("_place"))).alias("byte_start"),
        byte_at(F.col(f"{source}.parts"), F.get(F.col(f"{source}.places"), F.col("_place") + n - 1) + 1).alias("byte_end"),
        status.alias("status"),
    )
    # The explode of one keeps filters on the result from being pushed into the
    # search, where Spark would run it once for each use of its result.
    rows = rows.withColumn("_result", place)
    return rows.select(*[df[c] for c in df.columns], F.explode(F.array("_result")).alias("_found")).select(*df.columns, "_found.*")


def align(df: DataFrame, source: str = "text", wanted: str = "ext_text", threshold: float = FUZZY_THRESHOLD, strategy: str = "counter") -> DataFrame:
    """Adds byte_start, byte_end and status of ``wanted``, a string column or an
    array of strings (then a row for each, with ext_idx), in ``source``."""
    rows = prepare(df, source)
    if dict(df.dtypes)[wanted].startswith("array"):
        keep = [c for c in df.columns if c != wanted]
        rows = align_many(rows, wanted, threshold, strategy=strategy)
        rows = rows.select(*keep, F.posexplode(F.arrays_zip(F.col(wanted).alias("text"), F.col("_found").alias("found"))).alias("ext_idx", "_s"))
        return rows.select(*keep, "ext_idx", F.col("_s.text").alias(wanted), "_s.found.*")
    return align_prepared(rows, wanted, threshold, strategy=strategy).drop("_source")


def span_text(source: Column, byte_start: Column, byte_end: Column) -> Column:
    """The bytes of a span, as text."""
    return F.substring(source.cast("binary"), byte_start + 1, byte_end - byte_start).cast("string")
