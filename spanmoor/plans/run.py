"""align, extract and run: the three entry points, DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import parse
from ..operators.align import FUZZY_THRESHOLD, align, align_many, prepare
from ..operators.infer import Client, infer
from ..operators.prompt import Template, prompt
from ..operators.text import MAX_CHUNK_CHARS, chunks
from ..sources.staging import stage

SPAN = ("ext_idx", "class", "ext_text", "attributes", "byte_start", "byte_end", "status")


def extract(df: DataFrame, source: str = "text", raw: str = "raw", threshold: float = FUZZY_THRESHOLD, strategy: str = "counter") -> DataFrame:
    """Model output to spans: one row for each valid entry, in order, and for a
    row whose output has none, one with null span columns. error_kind is
    invalid_format where the output can't be read (error_detail: the output);
    dropped counts entries without class or text. No shuffle."""
    keep = [c for c in df.columns if c not in (source, raw)]
    rows = df.withColumn("_parsed", parse(F.col(raw)))
    rows = prepare(rows, source).withColumns(
        {"error_kind": F.col("_parsed.error"), "error_detail": F.when(F.col("_parsed.error").isNotNull(), F.col(raw)), "dropped": F.col("_parsed.dropped")}
    )
    told = ("error_kind", "error_detail", "dropped")
    rows = rows.select(*keep, *told, "_source", F.col("_parsed.entries").alias("_entries"), F.col("_parsed.entries.text").alias("_texts"))
    rows = align_many(rows, "_texts", threshold, strategy=strategy)
    rows = rows.select(*keep, *told, F.posexplode_outer(F.arrays_zip(F.col("_entries").alias("e"), F.col("_found").alias("found"))).alias("ext_idx", "_s"))
    rows = rows.select(*keep, *told, "ext_idx", F.col("_s.e.class").alias("class"), F.col("_s.e.text").alias("ext_text"), F.col("_s.e.attributes").alias("attributes"), "_s.found.*")
    return rows.select(*keep, *SPAN, *told)


def run(
    df: DataFrame,
    client: Client,
    template: Template,
    source: str = "text",
    doc_id: str = "doc_id",
    max_chunk_chars: int | None = MAX_CHUNK_CHARS,
    threshold: float = FUZZY_THRESHOLD,
    persist: Callable[[DataFrame], DataFrame] = stage,
    on_chunk_error: Callable[[DataFrame], None] | None = None,
    task_timeout: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(spans, errors) of a run over documents (doc_id, source).

    Each document is cut into chunks (None: taken whole), prompts are sent, and
    output is parsed and aligned within its own chunk; offsets are then those of
    the document. The first error of a document in chunk order fails all of it:
    it has no spans and one row in ``errors`` (doc_id, chunk_idx, error_kind,
    error_detail, raw). ``persist`` writes and rereads model output, which is
    read twice, so that neither that nor a later retry asks the model again; the
    calls are thus made when ``run`` is called. ``on_chunk_error`` is called with
    the rows of all chunks, not only each document's first, whose output can't be
    read (see unreadable). ``task_timeout``: seconds that a chunk may take.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("text"))
    if max_chunk_chars is None:
        rows = rows.select("doc_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk_text"), F.lit(0).alias("chunk_byte_start"), F.lit(None).cast("string").alias("previous_chunk"))
    else:
        rows = chunks(rows, "text", max_chunk_chars)
    rows = rows.withColumn("prompt", prompt(template, F.col("chunk_text"), F.col("previous_chunk")))
    told = infer(rows, client, task_timeout=task_timeout).drop("prompt", "previous_chunk")
    told = persist(told)
    if on_chunk_error is not None:
        on_chunk_error(unreadable(told))
    spans = extract(told.where("infer_error is null"), "chunk_text", "raw", threshold, strategy="windows" if max_chunk_chars else "counter")
    broken = spans.where("error_kind is not null").select("doc_id", "chunk_idx", "error_kind", F.col("error_detail").alias("raw"))
    detail = F.when(F.lit(max_chunk_chars is None), F.col("raw"))  # a chunked run keeps the bare kind
    failed = told.where("infer_error is not null").select("doc_id", "chunk_idx", F.col("infer_error").alias("error_kind"), F.col("infer_detail").alias("error_detail"), F.lit(None).cast("string").alias("raw"))
    every = failed.unionByName(broken.withColumn("error_detail", detail))
    first = every.groupBy("doc_id").agg(F.min_by(F.struct("chunk_idx", "error_kind", "error_detail", "raw"), "chunk_idx").alias("_e"))
    errors = first.select("doc_id", "_e.*")
    good = spans.where("error_kind is null and ext_idx is not null").join(errors.select("doc_id"), "doc_id", "left_anti")
    shift = lambda c: (F.col(c) + F.col("chunk_byte_start")).alias(c)
    good = good.select("doc_id", "chunk_idx", "ext_idx", "class", "ext_text", "attributes", shift("byte_start"), shift("byte_end"), "status")
    return good, errors


def unreadable(told: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, chunk_text, chunk_byte_start, raw) of the chunks whose
    model output came, but can't be read."""
    rows = told.where("infer_error is null").select("doc_id", "chunk_idx", "chunk_text", "chunk_byte_start", "raw")
    return rows.where(parse(F.col("raw"))["error"] == "invalid_format")


def write_unreadable(folder: str) -> Callable[[DataFrame], None]:
    """An ``on_chunk_error`` that keeps raw output as JSON Lines in a folder."""
    return lambda rows: rows.write.option("ignoreNullFields", "false").json(folder)


def chunk_errors(errors: DataFrame) -> DataFrame:
    """Raw output that could not be read, to be kept for a look."""
    return errors.where("error_kind = 'invalid_format'").select("doc_id", "chunk_idx", "raw")


__all__ = ["align", "chunk_errors", "extract", "run", "unreadable", "write_unreadable"]
