"""Text folders, task files, boilerplate and benchmark records."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prompt import Example, Extraction, Template

#: The lines that enclose a public-domain book.
_BEGIN = (r"\*\*\* START OF THE PROJECT GUTENBERG EBOOK [^\n]+? \*\*\*", r"\*\*\* START OF THIS PROJECT GUTENBERG EBOOK [^\n]+? \*\*\*")
_END = (r"\*\*\* END OF THE PROJECT GUTENBERG EBOOK [^\n]+? \*\*\*", r"\*\*\* END OF THIS PROJECT GUTENBERG EBOOK [^\n]+? \*\*\*")
_TRIM = r"(?U)\A\s+|\s+\z"


def read_text_folder(spark: SparkSession, folder: str, pattern: str = "*.txt", ordered: bool = False) -> DataFrame:
    """(slug, text): a row for each file, whole, slug being its base name. With
    ``ordered``, rows come by file name, which takes a sort of all texts."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_name").alias("_file"), F.col("value").alias("text"))
    rows = rows.orderBy("_file") if ordered else rows
    return rows.select(F.regexp_replace("_file", r"\.[^.]*\z", "").alias("slug"), "text")


def strip_boilerplate(text: Column) -> Column:
    """What lies between a book's start and end lines, trimmed."""
    for (first, second), before, after in ((_BEGIN, r"(?s)\A.*?", ""), (_END, "(?s)", r".*\z")):
        chosen = F.when(F.rlike(text, F.lit(first)), F.regexp_replace(text, before + first + after, ""))
        text = chosen.otherwise(F.regexp_replace(text, before + second + after, ""))
    return F.regexp_replace(text, _TRIM, "")


def _decoded(part: Column) -> Column:
    """Text of bytes of which the last character may be cut: a shorter part of
    the bytes then is the text."""
    parts = [F.substring(part, F.lit(1), F.octet_length(part) - i) for i in range(4)]
    return F.coalesce(*[F.try_validate_utf8(p.cast("string")) for p in parts])


def truncate_at_sentence(text: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` bytes, cut after the last sentence end that white
    space, a quote or the cut follows; else at the last space; else at the cut."""
    cut = _decoded(F.substring(text.cast("binary"), 1, max_bytes))
    sentence = F.regexp_extract(cut, r"""(?s)\A(.*[.!?])(?=[ \n\r"']|\z)""", 1)
    word = F.regexp_extract(cut, r"(?s)\A(.*) ", 1)
    out = F.when(sentence != "", sentence).when(word != "", word).otherwise(cut)
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(out)


def load_task(path: str) -> tuple[str, Template]:
    """(name, template) of a task file."""
    task = json.loads(Path(path).read_text(encoding="utf-8"))
    examples = [Example(e["text"], [Extraction(x["class"], x["text"], x.get("attributes") or {}) for x in e["extractions"]]) for e in task["examples"]]
    return task["name"], Template(task["description"], examples)


def benchmark_records(documents: DataFrame, spans: DataFrame, errors: DataFrame, task: str, library: str, total_ms: int | None) -> DataFrame:
    """A record for each document (doc_id): source, task, library, extractions,
    timing and error, the last of which empties the extractions."""
    entry = F.struct("class", F.col("ext_text").alias("text"), "byte_start", "byte_end", "status", "attributes")
    order = F.struct("chunk_idx", "ext_idx", entry.alias("entry"))
    found = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("_all")).withColumnRenamed("doc_id", "_doc")
    failed = errors.select(F.col("doc_id").alias("_failed"), F.col("error_kind").alias("error"))
    rows = documents.join(found, F.col("doc_id") == F.col("_doc"), "left").join(failed, F.col("doc_id") == F.col("_failed"), "left")
    timing = F.when(F.col("error").isNull(), F.struct(F.lit(total_ms).cast("long").alias("total_ms")))
    entries = F.coalesce(F.transform("_all", lambda s: s["entry"]), F.array().cast("array<struct<class:string,text:string,byte_start:int,byte_end:int,status:string,attributes:string>>"))
    return rows.select(F.col("doc_id").cast("string").alias("source"), F.lit(task).alias("task"), F.lit(library).alias("library"), entries.alias("extractions"), timing.alias("timing"), "error")


def write_records(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)


RECORD = "source string, task string, library string, extractions array<struct<class:string,text:string,byte_start:int,byte_end:int,status:string,attributes:string>>, timing struct<total_ms:bigint>, error string"


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark records of a folder, with the file's name and the record's
    place: file, block and row in it, which order records as files and lines do."""
    rows = spark.read.schema(RECORD).json(folder)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumns({"stem": F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", ""), "place": place})
