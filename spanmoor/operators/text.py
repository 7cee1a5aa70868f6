"""Rows of tokens, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions.tokens import token_starts, token_texts, token_type

MAX_CHUNK_CHARS = 1000


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, one row for each token: token_idx, token, type,
    byte_start, byte_end. No shuffle."""
    keep = [c for c in df.columns if c != text]
    rows = df.withColumn("_parts", token_texts(F.col(text))).withColumn("_at", token_starts("_parts"))
    rows = rows.select(*keep, F.posexplode(F.arrays_zip("_parts", "_at")).alias("token_idx", "_t"))
    start, token = F.col("_t._at"), F.col("_t._parts")
    return rows.select(*keep, "token_idx", token.alias("token"), token_type(token).alias("type"), start.alias("byte_start"), (start + F.octet_length(token)).alias("byte_end"))


def _sentence_arrays(df: DataFrame, text: str) -> DataFrame:
    rows = df.withColumn("_parts", token_texts(F.col(text)))
    rows = rows.withColumn("_bounds", C.sentence_bounds(C.class_string(F.col("_parts"))))
    rows = rows.withColumn("_made", C.sentences_from(F.col("_parts"), F.col("_bounds")))
    # An explode of one: what is above reads the sentences, instead of having them
    # made again for each use.
    return rows.select(*[c for c in df.columns if c != text], F.explode(F.array("_made")).alias("_sentences"))


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each sentence: sent_idx, sentence, byte_start."""
    keep = [c for c in df.columns if c != text]
    rows = _sentence_arrays(df, text)
    rows = rows.withColumn("_at", C.starts_of(F.transform("_sentences", lambda s: F.octet_length(s))))
    rows = rows.select(*keep, F.posexplode(F.arrays_zip("_sentences", "_at")).alias("sent_idx", "_s"))
    return rows.select(*keep, "sent_idx", F.col("_s._sentences").alias("sentence"), F.col("_s._at").alias("byte_start"))


def chunks(df: DataFrame, text: str = "text", max_chunk_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """One row for each chunk: chunk_idx, chunk_text, chunk_byte_start and
    previous_chunk, the text before it (null for the first). Sentences are packed
    whole while they fit in ``max_chunk_chars`` graphemes. No shuffle."""
    if max_chunk_chars < 1:
        raise ValueError("max_chunk_chars must be positive")
    keep = [c for c in df.columns if c != text]
    rows = _sentence_arrays(df, text)
    lengths, sizes = F.transform("_sentences", lambda s: C.graphemes(s)), F.transform("_sentences", lambda s: F.octet_length(s))
    rows = rows.withColumn("_packed", C.pack(lengths, sizes, max_chunk_chars))
    rows = rows.withColumn("_chunks", F.transform("_packed", lambda p: F.array_join(F.slice("_sentences", p["first"] + 1, p["n"]), "")))
    numbered = F.transform("_chunks", lambda c, i: F.struct(c.alias("text"), F.get("_chunks", i - 1).alias("previous"), F.get("_packed", i)["at"].alias("at")))
    rows = rows.select(*keep, F.posexplode(numbered).alias("chunk_idx", "_c"))
    return rows.select(*keep, "chunk_idx", F.col("_c.text").alias("chunk_text"), F.col("_c.at").alias("chunk_byte_start"), F.col("_c.previous").alias("previous_chunk"))
