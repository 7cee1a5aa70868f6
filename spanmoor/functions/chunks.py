"""Sentences and chunks of a text, as column expressions.

Each token becomes one letter of a class string. Sentence bounds and chunks are
found in those letters and in the sentences' lengths, whole batches at a time and
in linear time; texts and tokens stay on the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import is_space, token_texts

#: Fixed values.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St")
ENDERS = (".", "!", "?")
CLOSERS = ('"', "'", ")", "]", "}", "»", "”", "’")


#: Characters of which each is a cluster of its own beside any of the others:
#: Latin, Greek, Cyrillic and Armenian letters, punctuation, kana, ideographs.
_SINGLE = r"\A[\t\n -\x{2FF}\x{370}-\x{482}\x{48A}-\x{58F}\x{1E00}-\x{1FFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]*+\z"


def graphemes(text: Column) -> Column:
    """Length in extended grapheme clusters. Texts of single characters alone
    have one each, which spares most texts the slow search."""
    return F.when(F.rlike(text, F.lit(_SINGLE)), F.length(text)).otherwise(F.regexp_count(text, F.lit(r"\X")))


def class_string(parts: Column) -> Column:
    """A letter for each token: E ends a sentence, C closes after it, N is white
    space with a line break, U a capitalised word, x the rest."""

    def letter(token: Column, i: Column) -> Column:
        first = F.left(token, F.lit(1))
        before = F.get(parts, i - 1)
        return (
            F.when((token == " ") | first.between("a", "z"), "x")  # most tokens
            .when(token.isin(*ENDERS), F.when((i > 0) & before.isin(*ABBREVIATIONS), "x").otherwise("E"))
            .when(token.isin(*CLOSERS), "C")
            .when(is_space(token), F.when(token.contains("\n"), "N").otherwise("x"))
            .when((F.upper(first) == first) & (F.lower(first) != first) & F.rlike(first, F.lit(r"^\p{L}")), "U")
            .otherwise("x")
        )

    return F.array_join(F.transform(parts, letter), "")


def _ints(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


@F.arrow_udf(_ints("at", "n"))
def sentence_bounds(classes: pa.Array) -> pa.Array:
    """First token and number of tokens of each sentence. One begins after an E
    and the Cs that follow it, and at an N before a U; null has none."""
    text = pc.cast(pc.fill_null(classes, ""), pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(letters)
    end = np.repeat(offsets[1:], np.diff(offsets))  # of the letter's own text
    other = np.where(letters != ord("C"), np.arange(n), n)
    past = np.append(np.minimum.accumulate(other[::-1])[::-1], n)  # the first letter from here on that is no C
    full = np.flatnonzero(letters == ord("E"))
    line = np.flatnonzero((letters[:-1] == ord("N")) & (letters[1:] == ord("U")))
    begins = np.zeros(n + 1, bool)
    begins[np.minimum(past[full + 1], end[full])] = True
    begins[line[line + 1 < end[line]]] = True
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins[:n])
    cuts = np.searchsorted(starts, offsets)
    of = np.repeat(offsets[:-1], np.diff(cuts))
    bounds = pa.StructArray.from_arrays([pa.array((starts - of).astype(np.int32)), pa.array(np.diff(np.append(starts, n)).astype(np.int32))], names=["at", "n"])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), bounds)


def _flat(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each array's begin) of array<int>; nulls are empty."""
    counts = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(arrays.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, np.concatenate([[0], np.cumsum(counts)])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def starts_of(sizes: pa.Array) -> pa.Array:
    """Running sums of each array<int> before each entry."""
    numbers, cuts = _flat(sizes)
    before = np.cumsum(numbers) - numbers
    base = np.append(before, 0)[cuts[:-1]]
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((before - np.repeat(base, np.diff(cuts))).astype(np.int32)))


def sentences_from(parts: Column, bounds: Column) -> Column:
    """The sentences, which joined give the text back."""
    return F.transform(bounds, lambda b: F.array_join(F.slice(parts, b["at"] + 1, b["n"]), ""))


def pack(lengths: Column, sizes: Column, most: int) -> Column:
    """array<struct<first, n, at>>: sentences by number, packed in order while a
    chunk's length stays within ``most``; a longer sentence stands alone. ``at``
    is the sum of the sizes before the chunk."""

    @F.arrow_udf(_ints("first", "n", "at"))
    def packed(lengths: pa.Array, sizes: pa.Array) -> pa.Array:
        numbers, cuts = _flat(lengths)
        upto = np.cumsum(numbers)
        first, n, ends = [], [], [0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i = a
            while i < b:
                room = most + (upto[i - 1] if i else 0)
                j = max(i + 1, i + int(np.searchsorted(upto[i:b], room, side="right")))
                first.append(i)
                n.append(j - i)
                i = j
            ends.append(len(first))
        first, ends = np.array(first, np.int64), np.array(ends)
        base = np.repeat(cuts[:-1], np.diff(ends))
        size, _ = _flat(sizes)
        before = np.append(np.cumsum(size) - size, 0)
        columns = (first - base, np.array(n, np.int64), before[first] - before[base])
        chunks = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["first", "n", "at"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), chunks)

    return packed(lengths, sizes)


__all__ = ["ABBREVIATIONS", "CLOSERS", "ENDERS", "class_string", "graphemes", "pack", "sentence_bounds", "sentences_from", "starts_of", "token_texts"]
