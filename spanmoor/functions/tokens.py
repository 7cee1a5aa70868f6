"""Tokens of a text, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words with inner marks, numbers with separators, single other
#: characters, runs of white space. Together they cover every character.
TOKEN_PATTERN = r"(?U)\p{L}[\p{L}\p{M}\x{2019}'\-]*|\d[\d.,]*|[^\s]|\s+"


def token_texts(text: Column) -> Column:
    """array<string>: the tokens, which joined give the text back."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_type(token: Column) -> Column:
    """By the first character alone. A run that starts with white space outside
    ASCII, and a digit outside ASCII, count as punctuation."""
    first = F.left(token, F.lit(1))
    return (
        F.when(first.isin(" ", "\t", "\n", "\r"), "whitespace")
        .when(first.between("0", "9"), "number")
        .when(F.rlike(first, F.lit(r"^\p{L}")), "word")
        .otherwise("punctuation")
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def token_starts(tokens: pa.Array) -> pa.Array:
    """Byte offset of each token: running sums of byte lengths, whole batches at
    a time. (A fold over a long array in SQL would copy it at each step.)"""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(tokens.flatten()), 0).to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    before = np.cumsum(lengths) - lengths
    base = np.zeros(len(counts), np.int64)
    some = counts > 0
    base[some] = before[offsets[:-1][some]]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((before - np.repeat(base, counts)).astype(np.int32)), mask=tokens.is_null())


def tokenize(text: Column) -> Column:
    """array<struct<text, type, byte_start, byte_end>>; offsets are half-open
    UTF-8 byte positions. Null gives null, the empty text an empty array."""
    parts = token_texts(text)
    pairs = F.arrays_zip(parts.alias("text"), token_starts(parts).alias("byte_start"))
    return F.transform(
        pairs,
        lambda t: F.struct(
            t["text"].alias("text"),
            token_type(t["text"]).alias("type"),
            t["byte_start"].alias("byte_start"),
            (t["byte_start"] + F.octet_length(t["text"])).alias("byte_end"),
        ),
    )


def is_space(token: Column) -> Column:
    """Whether the token's type is whitespace, by its first character."""
    return F.left(token, F.lit(1)).isin(" ", "\t", "\n", "\r")


def lowered(token: Column) -> Column:
    """Lower case, a final sigma like any other."""
    return F.when(token.contains("Σ"), F.translate(F.lower(token), "ς", "σ")).otherwise(F.lower(token))


def match_places(parts: Column) -> Column:
    """array<int>: places, from 0, of the tokens other than white space."""
    return F.filter(F.transform(parts, lambda t, i: F.when(~is_space(t), i)), lambda i: i.isNotNull())


def match_tokens(parts: Column) -> Column:
    """Lower-cased tokens other than white space: what alignment compares."""
    return F.transform(F.filter(parts, lambda t: ~is_space(t)), lowered)


def byte_at(parts: Column, place: Column) -> Column:
    """Byte offset of the token at a place, from 0; null for a null place. One
    join of what comes before, where a single offset is wanted."""
    return F.when(place >= 0, F.octet_length(F.array_join(F.slice(parts, F.lit(1), F.greatest(place, F.lit(0))), "")))


def char_to_byte(text: Column, position: Column) -> Column:
    """Byte offset of a character offset."""
    return F.octet_length(F.left(text, position))
