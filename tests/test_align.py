"""Alignment on small cases, both strategies, and against brute force."""

import random

import pytest

from spanmoor.functions.spans import best_window
from spanmoor.operators.align import align

CASES = [
    ("the quick brown fox", "fox", 0.75, ("exact", 16, 19)),
    ("the quick brown fox", "quick brown", 0.75, ("exact", 4, 15)),
    ("Hello world", "hello", 0.75, ("exact", 0, 5)),
    ("hello world hello", "hello", 0.75, ("exact", 0, 5)),
    ("café señor bueno", "señor", 0.75, ("exact", 6, 12)),
    ("Patient is prescribed Naprosyn and prednisone for treatment.", "Naprosyn", 0.75, ("exact", 22, 30)),
    ("Patient is prescribed Naprosyn and prednisone for treatment.", "Napro", 0.75, ("not_found", None, None)),
    ("Patient was given Ibuprofen 600mg twice daily.", "Ibuprofen 600mg", 0.75, ("exact", 18, 33)),
    ("Pt was prescribed Naprosyn for pain and prednisone for one month.", "for one month", 0.6, ("fuzzy", 51, 64)),
    ("", "hello", 0.75, ("not_found", None, None)),
    ("hello", "", 0.75, ("not_found", None, None)),
    ("hello", "  ", 0.75, ("not_found", None, None)),
    ("hi", "this is much longer than source", 0.75, ("not_found", None, None)),
    ("the quick brown fox jumps", "quick brown dog", 0.6, ("fuzzy", 0, 15)),
    ("the quick brown fox jumps", "quick brown dog", 0.75, ("not_found", None, None)),
    ("Patient has severe heart problems today.", "problems heart", 0.6, ("fuzzy", 19, 33)),
    ("Findings consistent with degenerative disc disease at L5-S1.", "mild degenerative disc disease", 0.75, ("fuzzy", 20, 50)),
    ("Patient reports back pain and a fever.", "headache and fever", 0.75, ("not_found", None, None)),
    ("the quick brown fox jumps", "quick red cat", 0.75, ("not_found", None, None)),
    ("the quick brown fox jumps", "quick red cat", 0.3, ("fuzzy", 0, 15)),
    ("born in 1564. He", "1564", 0.75, ("not_found", None, None)),
    (None, "a", 0.75, ("not_found", None, None)),
    ("a", None, 0.75, ("not_found", None, None)),
]


@pytest.mark.parametrize("strategy", ["windows", "counter"])
def test_cases(spark, strategy):
    for threshold in {c[2] for c in CASES}:
        own = [(i, c[0], c[1]) for i, c in enumerate(CASES) if c[2] == threshold]
        df = spark.createDataFrame(own, "k int, text string, ext_text string")
        for r in align(df, threshold=threshold, strategy=strategy).collect():
            assert (r.status, r.byte_start, r.byte_end) == CASES[r.k][3], CASES[r.k]


def test_many_to_a_source(spark):
    df = spark.createDataFrame([(1, "the quick brown fox", ["fox", "cat", "quick"])], "doc_id int, text string, ext_text array<string>")
    rows = align(df).orderBy("ext_idx").collect()
    assert [(r.ext_idx, r.status, r.byte_start) for r in rows] == [(0, "exact", 16), (1, "not_found", None), (2, "exact", 4)]


def test_arguments(spark):
    df = spark.createDataFrame([("a", "a")], "text string, ext_text string")
    with pytest.raises(ValueError, match="positive"):
        align(df, threshold=0)
    with pytest.raises(ValueError, match="strategy"):
        align(df, strategy="guess")


def brute(source, wanted):
    n, best, at = len(wanted), 0.0, 0
    for i in range(len(source) - n + 1):
        window, hit = list(source[i : i + n]), 0
        for t in wanted:
            if t in window:
                window.remove(t)
                hit += 1
        if hit / n > best:
            best, at = hit / n, i
    return best, at


def test_best_window():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        w = [rng.choice("abcde") for _ in range(rng.randint(1, 5))]
        assert best_window(s, w) == brute(s, w)


def test_strategies_agree(spark):
    rng = random.Random(2)
    word = lambda k: " ".join(rng.choice("abcd") for _ in range(k))
    df = spark.createDataFrame([(i, word(rng.randint(1, 12)), word(rng.randint(1, 5))) for i in range(300)], "k int, text string, ext_text string")
    a, b = (sorted(map(tuple, align(df, threshold=0.5, strategy=s).collect())) for s in ("windows", "counter"))
    assert a == b
    for _, text, wanted, start, end, status in a:
        s, w = text.split(), wanted.split()
        p = s.index(w[0]) if w[0] in s else None
        if p is not None and s[p : p + len(w)] == w:
            assert status == "exact" and text[start:end] == wanted
        else:
            ratio, at = brute(s, w)
            assert status == ("fuzzy" if ratio >= 0.5 else "not_found")
            assert start == (2 * at if ratio >= 0.5 else None)
