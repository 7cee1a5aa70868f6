"""Agreement of two sets of results."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
#: Another library's states on ours.
STATUS_MAP = {"match_exact": "exact", "match_greater": "fuzzy", "match_lesser": "fuzzy", "match_fuzzy": "fuzzy"}
_ENTRY = ("text", "class", "status", "byte_start")
_PAIR = "source {kind}, left_idx int, right_idx int, left_text string, right_text string, ratio double, left_class string, right_class string, left_status string, right_status string, left_start int, right_start int"


def map_status(status: Column) -> Column:
    """States of another library; unknown ones, and null, are not found."""
    out = F.lit("not_found")
    for theirs, ours in STATUS_MAP.items():
        out = F.when(status == theirs, ours).otherwise(out)
    return out


def pair_texts(left: list[str], right: list[str], least: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """(left, right, ratio): the left texts choose in order. Equal texts come
    first, the foremost of those left; who finds none takes the most similar of
    the rest, the foremost at a tie, if its ratio reaches ``least``."""
    places: dict[str, deque[int]] = defaultdict(deque)
    for j, text in enumerate(right):
        places[text].append(j)
    matchers = {text: SequenceMatcher(None, "", text) for text in places}  # each indexes its text once

    def likeness(text: str, other: str, floor: float) -> float:
        m = matchers[other]
        m.set_seq1(text)
        return m.ratio() if min(m.real_quick_ratio(), m.quick_ratio()) >= floor else -1.0

    def nearest(text: str) -> tuple[float, str | None]:
        floor, best = least, (-1.0, 0, None)
        for other, free in places.items():
            if free and (r := likeness(text, other, floor)) >= floor:
                floor, best = r, max(best, (r, -free[0], other), key=lambda x: x[:2])
        return best[0], best[2]

    out = []
    for i, text in enumerate(left):
        ratio, other = (1.0, text) if places.get(text) else nearest(text)
        if other is not None:
            out.append((i, places[other].popleft(), ratio))
    return out


def match(left: DataFrame, right: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of entries (source, idx, text, class, status, byte_start) of the
    two sides, source by source; only sources of both are paired."""

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("idx", ignore_index=True), b.sort_values("idx", ignore_index=True)
        rows = []
        for i, j, ratio in pair_texts(a["text"].tolist(), b["text"].tolist(), least):
            x, y = a.iloc[i], b.iloc[j]
            rows.append((x["source"], x["idx"], y["idx"], x["text"], y["text"], ratio, x["class"], y["class"], x["status"], y["status"], x["byte_start"], y["byte_start"]))
        out = pd.DataFrame(rows, columns=["source", "left_idx", "right_idx", "left_text", "right_text", "ratio", "left_class", "right_class", "left_status", "right_status", "left_start", "right_start"])
        return out.astype({"left_start": "Int32", "right_start": "Int32"})

    # Aliased, so that two sides of one origin have columns of their own.
    keep = [F.col(c).alias(c) for c in ("source", "idx", *_ENTRY)]
    schema = _PAIR.format(kind=left.schema["source"].dataType.simpleString())
    return left.select(*keep).groupBy("source").cogroup(right.select(*keep).groupBy("source")).applyInPandas(pair, schema)


def match_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of equal texts, the nth of a text with the nth, as one join."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source", "text").orderBy("idx"))
    a = left.withColumn("_n", nth).select("source", "text", "_n", *[F.col(c).alias(f"left_{d}") for c, d in (("idx", "idx"), ("class", "class"), ("status", "status"), ("byte_start", "start"))])
    b = right.withColumn("_n", nth).select("source", "text", "_n", *[F.col(c).alias(f"right_{d}") for c, d in (("idx", "idx"), ("class", "class"), ("status", "status"), ("byte_start", "start"))])
    return a.join(b, ["source", "text", "_n"]).drop("_n")


def summary(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each source (totals: source, left_total, right_total): counts,
    agreement in percent to one digit, offset differences, share matched."""
    percent = lambda c: F.round(100 * F.avg(c.cast("int")), 1)
    delta = F.abs(F.col("left_start") - F.col("right_start"))
    found = pairs.groupBy("source").agg(
        F.count("*").alias("matched"),
        percent(F.col("left_class") == F.col("right_class")).alias("class_agreement"),
        percent(F.col("left_status") == F.col("right_status")).alias("status_agreement"),
        F.round(F.avg(delta), 1).alias("offset_mean"),
        F.max(delta).alias("offset_max"),
    )
    rows = totals.join(found, "source", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    most = F.greatest("left_total", "right_total", F.lit(1))
    return rows.select("source", "left_total", "right_total", "matched", (F.col("left_total") - F.col("matched")).alias("only_left"), (F.col("right_total") - F.col("matched")).alias("only_right"), "class_agreement", "status_agreement", "offset_mean", "offset_max", F.round(100 * F.col("matched") / most, 1).alias("match_rate"))


def pair_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of both sides by source: ``state`` tells whether they can be
    compared (both), or which side has an error (the left's first) or none. Of
    several records of a source the last counts, by their ``place`` (file and
    line) if they have one, else the greatest by its columns."""

    def last(df: DataFrame, side: str) -> DataFrame:
        record = F.struct(*[c for c in df.columns if c not in ("source", "place")])
        pick = F.max_by(record, "place") if "place" in df.columns else F.max(record)
        return df.groupBy("source").agg(pick.alias(side))

    rows = last(left, "left").join(last(right, "right"), "source", "full_outer")
    state = (
        F.when(F.col("left").isNull(), "left_missing")
        .when(F.col("right").isNull(), "right_missing")
        .when(F.col("left.error").isNotNull(), "left_error")
        .when(F.col("right.error").isNotNull(), "right_error")
        .otherwise("both")
    )
    return rows.withColumn("state", state)


def entries(records: DataFrame, side: str) -> DataFrame:
    """(source, idx, text, class, status, byte_start) of comparable records."""
    rows = records.where("state = 'both'").select("source", F.posexplode(f"{side}.extractions").alias("idx", "_e"))
    return rows.select("source", "idx", *[F.col(f"_e.{c}").alias(c) for c in _ENTRY])


def report(left: DataFrame, right: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(summary by source, states by source) of two sets of benchmark records."""
    both = pair_records(left, right)
    totals = both.where("state = 'both'").select("source", F.size("left.extractions").alias("left_total"), F.size("right.extractions").alias("right_total"))
    return summary(match(entries(both, "left"), entries(both, "right"), least), totals), both.select("source", "state")


def task_summary(left: DataFrame, right: DataFrame, task: str, least: float = SIMILARITY) -> DataFrame:
    """One row for a task: documents, errors of each side, entries, matches and
    agreement over all documents that can be compared, mean times of these in
    milliseconds, and ``per_document``, the counts of each in order of source."""
    both = pair_records(left, right)
    fine = both.where("state = 'both'")
    totals = fine.select("source", F.size("left.extractions").alias("left_total"), F.size("right.extractions").alias("right_total"))
    pairs = match(entries(both, "left"), entries(both, "right"), least)
    broken = F.col("left.error").isNotNull()  # counts before the right one's
    time = lambda side: F.coalesce(F.round(F.avg(F.when(F.col("state") == "both", F.col(f"{side}.timing.total_ms")))), F.lit(0)).cast("long").alias(f"{side}_ms")
    head = both.agg(F.count("*").alias("documents"), F.count_if(broken).alias("left_errors"), F.count_if(~broken & F.col("right.error").isNotNull()).alias("right_errors"), time("left"), time("right"))
    delta = F.abs(F.col("left_start") - F.col("right_start"))
    percent = lambda c: F.coalesce(F.round(100 * F.avg(c.cast("int")), 1), F.lit(0.0))
    agreed = pairs.agg(
        percent(F.col("left_class") == F.col("right_class")).alias("class_agreement"),
        F.coalesce(F.round(F.avg(delta), 1), F.lit(0.0)).alias("offset_mean"),
        F.coalesce(F.max(delta), F.lit(0)).alias("offset_max"),
        percent(F.col("left_status") == F.col("right_status")).alias("status_agreement"),
    )
    counts = summary(pairs, totals).select("source", "left_total", "right_total", "matched", "only_left", "only_right")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    documents = counts.agg(*[total(c) for c in counts.columns[1:]], F.array_sort(F.collect_list(F.struct(*counts.columns))).alias("per_document"))
    rate = F.round(100 * F.col("matched") / F.greatest("left_total", "right_total", F.lit(1)), 1)
    rows = head.crossJoin(agreed).crossJoin(documents)  # a row each
    return rows.select(F.lit(task).alias("task"), "documents", "left_errors", "right_errors", "left_total", "right_total", "matched", "only_left", "only_right", rate.alias("match_rate"), "class_agreement", "offset_mean", "offset_max", "status_agreement", "left_ms", "right_ms", "per_document")


def report_json(tasks: dict[str, tuple[DataFrame, DataFrame]], metadata: dict, least: float = SIMILARITY) -> str:
    """A report of all tasks, in order of name, as JSON: ``metadata`` with the
    time and threshold, and a summary for each task (its two sides' records)."""
    told = [json.loads(task_summary(*tasks[t], t, least).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]) for t in sorted(tasks)]
    about = {"timestamp": datetime.now(timezone.utc).isoformat(), "match_threshold": least} | metadata
    return json.dumps({"metadata": about, "tasks": told}, indent=2, ensure_ascii=False)
