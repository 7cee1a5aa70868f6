"""Tokens, sentences and chunks on small texts, and what holds for any text."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanmoor.functions import chunks as C
from spanmoor.functions.tokens import char_to_byte, tokenize
from spanmoor.operators.text import chunks, sentences, tokens


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def told(df, *columns):
    out = {}
    for r in df.orderBy("doc_id", *[c for c in df.columns if c.endswith("_idx")]).collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return out


TOKENS = {
    "Hello, world!": [("Hello", "word", 0, 5), (",", "punctuation", 5, 6), (" ", "whitespace", 6, 7), ("world", "word", 7, 12), ("!", "punctuation", 12, 13)],
    "": [],
    "don't won't": [("don't", "word", 0, 5), (" ", "whitespace", 5, 6), ("won't", "word", 6, 11)],
    "costs $1,234.56 total": [("costs", "word", 0, 5), (" ", "whitespace", 5, 6), ("$", "punctuation", 6, 7), ("1,234.56", "number", 7, 15), (" ", "whitespace", 15, 16), ("total", "word", 16, 21)],
    "a  b": [("a", "word", 0, 1), ("  ", "whitespace", 1, 3), ("b", "word", 3, 4)],
    "café señor": [("café", "word", 0, 5), (" ", "whitespace", 5, 6), ("señor", "word", 6, 12)],
    "你好 世界": [("你好", "word", 0, 6), (" ", "whitespace", 6, 7), ("世界", "word", 7, 13)],
    "hello 🎉 world": [("hello", "word", 0, 5), (" ", "whitespace", 5, 6), ("🎉", "punctuation", 6, 10), (" ", "whitespace", 10, 11), ("world", "word", 11, 16)],
    "L5-S1.": [("L", "word", 0, 1), ("5", "number", 1, 2), ("-", "punctuation", 2, 3), ("S", "word", 3, 4), ("1.", "number", 4, 6)],
    "'hello'": [("'", "punctuation", 0, 1), ("hello'", "word", 1, 7)],
    "a b": [("a", "word", 0, 1), (" ", "punctuation", 1, 3), ("b", "word", 3, 4)],
    "٣٤": [("٣٤", "punctuation", 0, 4)],
}


def test_tokens(spark):
    found = told(tokens(frame(spark, *TOKENS)), "token", "type", "byte_start", "byte_end")
    assert [found.get(i, []) for i in range(len(TOKENS))] == list(TOKENS.values())


def test_tokenize_column(spark):
    rows = frame(spark, "Hi you", "", None).select(tokenize(F.col("text")).alias("t")).collect()
    assert [tuple(t) for t in rows[0].t] == [("Hi", "word", 0, 2), (" ", "whitespace", 2, 3), ("you", "word", 3, 6)]
    assert rows[1].t == [] and rows[2].t is None


SENTENCES = {
    "Hello world. Goodbye world.": ["Hello world.", " Goodbye world."],
    "What? Yes! OK.": ["What?", " Yes!", " OK."],
    "Dr. Smith is here. He is nice.": ["Dr. Smith is here.", " He is nice."],
    'He said "hello." Then left.': ['He said "hello."', " Then left."],
    "First line\nSecond line": ["First line", "\nSecond line"],
    "First line\nsecond line": ["First line\nsecond line"],
    "Wait... Now?!": ["Wait.", ".", ".", " Now?", "!"],
    "Born in 1564. He left. \n": ["Born in 1564. He left.", " \n"],
    "": [],
    ".": ["."],
    "\nUp": ["\nUp"],
    "Dr! No": ["Dr! No"],
}


def test_sentences(spark):
    found = told(sentences(frame(spark, *SENTENCES)), "sentence")
    assert [[s for (s,) in found.get(i, [])] for i in range(len(SENTENCES))] == list(SENTENCES.values())


@pytest.mark.parametrize(
    ("text", "most", "starts"),
    [
        ("First sentence. Second sentence. Third sentence. Fourth sentence.", 35, [0, 32]),
        ("Café is great. Señor drinks café.", 20, [0, 15]),
        ("long text that has no end to it at all", 20, [0]),
        ("", 20, []),
    ],
)
def test_chunks(spark, text, most, starts):
    rows = chunks(frame(spark, text), max_chunk_chars=most).orderBy("chunk_idx").collect()
    assert [r.chunk_byte_start for r in rows] == starts
    assert "".join(r.chunk_text for r in rows) == text
    assert [r.previous_chunk for r in rows] == [None, *[r.chunk_text for r in rows]][: len(rows)]


def by_folds(letters):
    """Sentence sizes from the letters, one at a time."""
    sizes, at, i = [], 0, 0
    while i < len(letters):
        if letters[i] == "N" and letters[i + 1 : i + 2] == "U" and i > at:
            sizes.append(i - at)
            at = i
        if letters[i] == "E":
            while letters[i + 1 : i + 2] == "C":
                i += 1
            sizes.append(i + 1 - at)
            at = i + 1
        i += 1
    return sizes + [len(letters) - at] * (at < len(letters))


def test_sentence_bounds(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ECNUxxx") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", "E", "C", "NU", "N", "U"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, c string").coalesce(2)
    for r in df.select("k", C.sentence_bounds(F.col("c")).alias("b")).collect():
        assert [b.n for b in r.b] == by_folds(texts[r.k] or "")
        assert [b.at for b in r.b] == [sum(b.n for b in r.b[:i]) for i in range(len(r.b))]


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(1, 12) for _ in range(rng.randint(0, 20))]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, n array<int>")
    for r in df.select("k", "n", C.pack(F.col("n"), F.transform("n", lambda x: 2 * x), 15).alias("p"), C.starts_of(F.col("n")).alias("s")).collect():
        told, i = [], 0
        while i < len(r.n):
            j = i + 1
            while j < len(r.n) and sum(r.n[i : j + 1]) <= 15:
                j += 1
            told.append((i, j - i, 2 * sum(r.n[:i])))
            i = j
        assert [tuple(p) for p in r.p] == told and r.s == [sum(r.n[:i]) for i in range(len(r.n))]


def test_long_text_in_linear_time(spark):
    """One text of 1 MB: sentences and chunks take seconds, not minutes."""
    text = "He went on to the next one. " * 36_000
    df = frame(spark, text)
    tokens(df).count()
    began = time.time()
    assert sentences(df).count() == 36_001
    rows = chunks(df).select(F.count("*"), F.sum(F.octet_length("chunk_text")), F.max("chunk_byte_start")).first()
    assert rows[0] == 1029 and rows[1] == len(text) and rows[2] == 979 + 1027 * 980
    assert time.time() - began < 40


def test_chunks_reject_size(spark):
    with pytest.raises(ValueError, match="positive"):
        chunks(frame(spark, "a"), max_chunk_chars=0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=20, max_size=40))
def test_nothing_is_lost(spark, texts):
    df = frame(spark, *texts)
    for rows, text, start in ((tokens(df), "token", "byte_start"), (sentences(df), "sentence", "byte_start"), (chunks(df, max_chunk_chars=12), "chunk_text", "chunk_byte_start")):
        found = told(rows, text, start)
        for i, t in enumerate(texts):
            parts = found.get(i, [])
            assert "".join(p for p, _ in parts) == t
            at = 0
            for p, s in parts:
                assert s == at
                at += len(p.encode())


def test_char_to_byte(spark):
    row = frame(spark, "Señor").select(char_to_byte(F.col("text"), F.lit(3)).alias("b")).first()
    assert row.b == 4
