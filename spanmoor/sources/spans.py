"""JSON Lines with a document's text and its spans to the line."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<class:string,text:string,byte_start:int,byte_end:int,status:string,attributes:string>"
RECORD = f"text string, extractions array<{SPAN}>"
STATUSES = ("exact", "fuzzy", "not_found")


def _value(c: Column) -> Column:
    """The JSON value of a column; null stays, as null."""
    inside = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(inside, r'(?s)\A\{"v":(.*)\}\z', 1)


def to_json_lines(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, value): a line for each document (doc_id, text), its spans in
    order. Null offsets and classes are kept as nulls."""
    parts = [F.concat(F.lit(f'"{k}":'), _value(F.col(c))) for k, c in (("class", "class"), ("text", "ext_text"), ("byte_start", "byte_start"), ("byte_end", "byte_end"), ("status", "status"))]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(',"attributes":'), F.coalesce("attributes", F.lit("{}")), F.lit("}"))
    order = [c for c in ("chunk_idx", "ext_idx") if c in spans.columns]
    rows = spans.select(F.col(doc_id).alias("_doc"), F.struct(*order, line.alias("_line")).alias("_s"))
    rows = rows.groupBy("_doc").agg(F.array_sort(F.collect_list("_s")).alias("_all"))
    out = documents.join(rows, F.col(doc_id) == F.col("_doc"), "left")
    inside = F.array_join(F.transform(F.coalesce("_all", F.array().cast(rows.schema["_all"].dataType)), lambda s: s["_line"]), ",")
    value = F.concat(F.lit('{"text":'), _value(F.col("text")), F.lit(',"extractions":['), inside, F.lit("]}"))
    return out.select(doc_id, value.alias("value"))


def save_json_lines(documents: DataFrame, spans: DataFrame, path: str, doc_id: str = "doc_id", single_file: bool = False) -> None:
    """Writes text files of lines in a folder; with ``single_file``, one file in
    the order of ids."""
    lines = to_json_lines(documents, spans, doc_id)
    if single_file:
        lines = lines.repartition(1).sortWithinPartitions(doc_id)
    lines.select("value").write.text(path)


def save_json_file(documents: DataFrame, spans: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Writes one plain file at ``path``, in the order of ids; it is empty if
    there are no documents, and must not exist yet."""
    spark = documents.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path  # Hadoop's, as the path may be one that only Spark can open
    target, parts = Path(path), Path(f"{path}.parts-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    save_json_lines(documents, spans, parts.toString(), doc_id, single_file=True)
    try:
        found = files.globStatus(Path(parts, "part-*"))
        if len(found):
            files.rename(found[0].getPath(), target)
        else:
            files.create(target).close()
    finally:
        files.delete(parts, True)


def load_json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(text, ext_idx, class, ext_text, byte_start, byte_end, status,
    attributes), a row for each span, and one with nulls for a text without any.

    Empty lines are dropped. ``strict``: a line that is no such record, or an
    unknown status, raises once it is read; else such lines are left out. A
    missing path raises at once."""
    return parse_json_lines(spark.read.text(path), strict)


def parse_json_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    rows = lines.where("value <> ''").withColumn("_r", F.from_json("value", RECORD))
    known = F.forall("_r.extractions", lambda e: F.coalesce(e["status"].isin(*STATUSES), F.lit(False)))
    fine = F.coalesce(F.col("_r.text").isNotNull() & F.col("_r.extractions").isNotNull() & known, F.lit(False))
    if strict:
        rows = rows.withColumn("_r", F.when(fine, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("invalid_data: "), F.left("value", F.lit(200)))).cast(rows.schema["_r"].dataType)))
    else:
        rows = rows.where(fine)
    rows = rows.select(F.col("_r.text").alias("text"), F.posexplode_outer("_r.extractions").alias("ext_idx", "_e"))
    return rows.select("text", "ext_idx", F.col("_e.class").alias("class"), F.col("_e.text").alias("ext_text"), F.col("_e.byte_start").alias("byte_start"), F.col("_e.byte_end").alias("byte_end"), F.col("_e.status").alias("status"), F.when(F.col("ext_idx").isNotNull(), F.coalesce("_e.attributes", F.lit("{}"))).alias("attributes"))
