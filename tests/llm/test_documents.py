"""The operators over documents, each against brute force and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanmoor.llm import decontaminate, minhash, mixing, neardup, quality, shards, suffix, toxicity
from spanmoor.llm.common import ascii_lower, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and white texts, repeated rows and ids, null ids and sources.
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", None, 3),
    (4, "one", None, "b", 3),
    (5, "Same text as the next one has it", "en", "b", 9),
    (5, "Same text as the next one has it", "en", "b", 9),
    (6, "same TEXT as the next one has it", "en", "c", 9),
    (None, "no id here but words enough to count", "en", "c", 9),
    (None, None, None, None, None),
    (7, "é" * 3000, "fr", "zz", 3000),
    (8, "word " * 30000, "en", "a", 150000),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    """Awkward rows with more columns, named like inner ones."""
    from pyspark.sql import functions as F

    extra = ("size", "key", "target", "taken", "cls", "kept", "shard", "slot", "n", "_size", "_id", "_rows", "spans", "label")
    return docs_of(spark, AWKWARD).select("*", *[F.lit("x").alias(c) for c in extra])


def words(text):
    return (text or "").encode().decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()


# --- mixing ------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        each = left / sum(w[s] for s in free)
        full = {s for s in free if each * w[s] >= most * sizes[s]}
        if not full:
            out |= {s: each * w[s] for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def check_mix(rows, found):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    target = brute_targets(sizes)
    by = defaultdict(list)
    for r in found:
        by[r.source_name].append(r)
        assert r.source_size == sizes[r.source_name]
        assert r.target == pytest.approx(target[r.source_name], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
    for name, own in by.items():
        total = sum(r.taken for r in own)
        ties = max(Counter((r.doc_id, r.size) for r in own).values())
        assert math.floor(target[name] + 1e-9) - ties < total <= math.floor(target[name] + 1e-9)
        rounds = int(target[name] // sizes[name]) if sizes[name] else 0
        cut, rest = False, math.floor(target[name] + 1e-9) - rounds * sizes[name]
        for r in sorted(own, key=lambda r: (hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest(), r.size)):
            part = r.taken - rounds * r.size
            if not cut and part == r.size:
                rest -= part
            elif r.size:
                assert cut is False or part == 0 or ties > 1
                cut = True


def test_mix(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a"] * 9 + ["b", "c", "dé", None, "e"]), 0) for i in range(600)]
    for some in (rows, AWKWARD):
        narrow = docs_of(spark, some).select("doc_id", F.col("source").alias("source_name"), mixing.word_count(F.col("text")).alias("size"))
        found = mixing.mix(narrow, F.col("doc_id"), F.col("source_name"), F.col("size"), digits=2).collect()
        assert len(found) == len(some)
        check_mix(some, found)
    out = mixing.mix_documents(clashing(spark))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == len(AWKWARD)
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


def test_draw(spark):
    df = docs_of(spark, [(i, "a b c d", "en", "xyz"[i % 3], 7) for i in range(60)])
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(df).collect()}
    out = mixing.draw_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: math.ceil(t / 4) for i, t in taken.items()})


# --- near duplicates ---------------------------------------------------------


def brute_groups(rows, percent=85):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)), key=str)


def near_copies(seed, families=6, size=25, length=120):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else " ".join(text), "en", "s", 0))
            if rng.random() < 0.2:
                rows.append((len(rows), rows[-1][1].replace(" ", "\n"), "en", "s", 0))
    return rows


@pytest.mark.parametrize("largest", [4096, 6])
def test_groups(spark, largest):
    rows = near_copies(largest) + [(1000 + (r[0] or 0) if r[0] else r[0], *r[1:]) for r in AWKWARD]
    found = neardup.groups(docs_of(spark, rows), largest=largest).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_groups_edges(spark):
    assert neardup.group_documents(docs_of(spark, [])).count() == 0
    assert neardup.group_documents(clashing(spark)).count() == len(AWKWARD)
    kept = neardup.keep_one(clashing(spark))
    assert kept.columns == clashing(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])


def test_chain_of_links(spark):
    """Each text is near the next alone; a hub that is near few must lose none."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        text = list(base)
        for j in range(i + 1):
            text[j * 12] = f"new{j}"
        rows.append((100 - i, " ".join(text), "en", "s", 0))
    found = neardup.group_documents(docs_of(spark, rows)).collect()
    assert {r.component_id for r in found} == {r[2] for r in brute_groups(rows)}


def test_null_and_repeated_ids(spark):
    """Each class fetches its own text, however many rows share its id."""
    rng = random.Random(41)
    base = [[f"b{k}w{j}" for j in range(40)] for k in range(40)]

    def text(i):
        w = list(base[i % 40])
        w[(i // 40) % 20 + 10] = f"n{i // 40}"
        return " ".join(w)

    rows = [(None, text(i), "en", "s", 0) for i in range(600)] + [(7, text(i + 50), "en", "s", 0) for i in range(600)] + [(8, text(3), "en", "s", 0)] * 200
    rng.shuffle(rows)
    found = neardup.groups(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_groups(rows)
    n = len({tuple(words(r[1])) for r in rows})
    kinds = docs_of(spark, rows)
    _, classes = neardup.classes_of(neardup.fingerprints(kinds, 28))
    wanted = classes.select(neardup.F.col("_at.doc_id").alias("_id"), neardup.F.col("_at.print").alias("_print"), "cls", "check")
    assert classes.count() == n
    joined = kinds.withColumn("print", neardup.F.xxhash64("text")).join(wanted, (neardup.F.col("print") == neardup.F.col("_print")) & neardup.F.col("doc_id").eqNullSafe(neardup.F.col("_id")))
    assert n <= joined.count() <= n + 200 and neardup.full_sets(joined.coalesce(1).select("text", "cls", "check"), 28).count() == n


def test_classes_that_clash(spark):
    """Sets of one class and another check are classes of their own."""
    rows = spark.createDataFrame([(1, 10, 3, 5, 7, [1]), (2, 10, 3, 5, 7, [1]), (3, 11, 3, 5, 8, [2]), (None, 12, 2, 6, 9, [3]), (4, 0, 0, 5, 1, [0])], "doc_id long, print long, n long, cls long, check long, keys array<long>")
    fixed, classes = neardup.classes_of(rows)
    by = {r.check: (r._low, r.cls) for r in classes.collect()}
    assert {k: v[0] for k, v in by.items()} == {7: 1, 8: 3, 9: None} and len({v[1] for v in by.values()}) == 3
    assert {(r.doc_id, r.cls) for r in fixed.where("n > 0").collect()} == {(1, by[7][1]), (2, by[7][1]), (3, by[8][1]), (None, by[9][1])}


def test_signatures_estimate():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    share = []
    for salt in range(20):
        e = np.concatenate([a, b]) + np.uint64(salt * 7919)
        s = minhash.signatures(e, np.repeat([0, 1], 400), 2)
        share.append((s[0] == s[1]).mean())
    assert abs(np.mean(share) - 360 / 440) < 0.02
    tiny = minhash.signatures(np.array([5], np.uint64), np.array([1]), 3)
    assert (tiny[0] == tiny[2]).all() and len(set((tiny[1] >> np.uint64(40)).tolist())) == minhash.BANDS * minhash.ROWS


def test_word_hashes():
    texts = ["a b  a", "", "A\tb", " x", "y"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, of = word_hashes(data, offsets)
    assert of.tolist() == [0, 0, 0, 2, 2, 3, 4]
    assert h[0] == h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_possible_links_is_sound(spark):
    import pandas as pd

    rng = random.Random(9)
    rows = []
    for i in range(60):
        n = rng.randint(5, 40)
        s = {rng.randint(0, 45) for _ in range(n)}
        rows.append(s)
    ids = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in rows]
    pdf = pd.DataFrame({"bucket": 1, "part": None, "cls": range(60), "label": [i // 2 for i in range(60)], "hub": 0, "keys": [np.array([1, 2], np.int64)] * 60, "bits": [neardup.bit_map(x) for x in ids], "n": [len(s) for s in rows]})
    got = set(map(tuple, neardup.possible_links(pdf, 60).to_numpy().tolist()))
    for i in range(1, 60):
        for j in range(i + 1, 60):
            both = len(rows[i] & rows[j])
            if i // 2 != j // 2 and 100 * both >= 60 * (len(rows[i]) + len(rows[j]) - both):
                assert (i, j) in got


# --- quality -----------------------------------------------------------------


def test_kth_greatest(spark):
    values = [round(random.Random(5).uniform(-50, 50), 6) for _ in range(500)] + [1.5] * 20 + [-3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, len(values)):
        assert quality.kth_greatest(df, "v", k) == pytest.approx(sorted(values, reverse=True)[k - 1])
    assert quality.kth_greatest(df, "v", 0) is None


def quality_rows(n=400):
    rng = random.Random(11)
    vocabulary = ["the", "and", "of", "to", "house", "river", "walks", "under", "green", "light", "with", "small"]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = " ".join(rng.choice(vocabulary) + ("" if good else rng.choice(["$$$", "%%%", "!!"])) for _ in range(rng.randint(20, 80)))
        rows.append((i, text, "en", "s", 0))
        if i % 2 == 0 or i % 8 == 1:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    df, told = docs_of(spark, rows + AWKWARD[:4]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.select_documents(df, told).collect()
    ids = {r.doc_id for r in found}
    good = {r[0] for r in rows if r[0] % 4 > 0}
    assert len(good - ids) <= 4 and not {r[0] for r in rows if r[0] % 4 == 0 and r[0] > 4} & ids
    assert sorted(map(tuple, found)) == sorted(map(tuple, quality.select_documents(df, told).collect()))
    kept = quality.keep_documents(df, told)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == ids


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_documents(docs_of(spark, []), none).count() == 0
    assert quality.keep_documents(clashing(spark), none).count() == len(AWKWARD)


def mixed_quality_rows(n=300):
    """Texts of every degree between the two kinds, and of very different lengths."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        foul = rng.random()
        text = " ".join(rng.choice(["stone", "water", "garden", "evening"]) + ("%%" if rng.random() < foul else "") for _ in range(rng.choice([3, 20, 200, 2000])))
        rows.append((i, text, "en", "s", 0))
        if i % 2:
            labels.append((i, int(rng.random() > foul), 0))
    return rows, labels


def brute_weights(rows, labels):
    """As the operator says it, a text and an n-gram at a time."""

    def bag(text):
        x, out = text.encode(), []
        for i in range(len(x) - 3):
            h = int.from_bytes(x[i : i + 4], "big")
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(((h ^ h >> 12) * 0x297A2D39 & 0xFFFFFFFF) >> 16)
        w = words(text)
        return out + [quality.HASHED + (a != b) for a, b in zip(w, w[1:])]

    bags = [bag(r[1] or "") for r in rows]
    good = {i for i, q, _ in labels if q == 1}
    every, chosen = Counter(), Counter()
    for r, b in zip(rows, bags):
        every.update(b)
        chosen.update(b if r[0] in good else [])
    share = sum(chosen.values()) / sum(every.values())
    ratio = {g: math.log((chosen[g] + quality.SMOOTH) / (n * share + quality.SMOOTH)) for g, n in every.items()}
    return [quality.PASSAGE * sum(ratio[g] for g in b) / (len(b) + quality.PRIOR) if b else None for b in bags]


def test_quality_against_brute_force(spark):
    rows, labels = mixed_quality_rows()
    rows = rows + [(1000 + i, *r[1:]) for i, r in enumerate(AWKWARD)] + [rows[1], (None, *rows[2][1:])]
    df, told = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    noise = {r.k: r.g for r in spark.createDataFrame([(r[0],) for r in rows], "k long").distinct().select("k", quality.gumbel(quality.F.col("k")).alias("g")).collect()}
    weights = brute_weights(rows, labels)
    found = quality.score_documents(df, told).collect()
    assert len(found) == len(rows)
    want = sorted((str(r[0]), w) for r, w in zip(rows, weights) if w is not None)
    got = sorted((str(r.doc_id), r.log_weight) for r in found if r.log_weight is not None)
    assert [i for i, _ in got] == [i for i, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want], abs=2e-4)
    assert not any(r.kept for r in found if r.log_weight is None) and any(not r.kept for r in found if r.log_weight is not None)
    for r in found:
        assert r.draw is None or r.draw == pytest.approx(r.log_weight + noise[r.doc_id], abs=2e-6)
    # k by the labels: of all rows above the best cut, corrected for errors either way.
    good = {i: q for i, q, _ in labels}
    some = [(math.floor(r.log_weight * 10), good.get(r.doc_id)) for r in found if r.log_weight is not None]
    rate = lambda t, label: sum(s >= t for s, x in some if x == label) / sum(x == label for _, x in some)
    cut = max(sorted({s for s, _ in some}), key=lambda t: rate(t, 1) - rate(t, 0))
    k = round(len(some) * min(1, max(0, (sum(s >= cut for s, _ in some) / len(some) - rate(cut, 0)) / (rate(cut, 1) - rate(cut, 0)))))
    draws = sorted((r.draw for r in found if r.draw is not None), reverse=True)
    assert 0 < k < len(draws) and {r.kept for r in found if r.draw is not None and r.draw >= draws[k - 1]} == {True}
    assert sum(r.kept for r in found) == sum(d >= draws[k - 1] for d in draws)


def test_quality_is_drawn(spark):
    """The noise decides among texts of like weight, and lengths don't."""
    rows, labels = mixed_quality_rows()
    df, told = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = ({r.doc_id: r for r in quality.score_documents(df, told, seed).collect()} for seed in (1, 2))
    kept = [{i for i, r in d.items() if r.kept} for d in (one, two)]
    assert len(kept[0] ^ kept[1]) > 4 and abs(len(kept[0]) - len(kept[1])) <= 1
    assert all(one[i].log_weight == two[i].log_weight for i in one)
    long_ = [i for i in one if len(rows[i][1]) > 500]
    assert abs(np.corrcoef([len(rows[i][1]) for i in long_], [one[i].log_weight for i in long_])[0, 1]) < 0.3
    # A draw from below the line: the choice is no cut by weight.
    assert min(one[i].log_weight for i in kept[0]) < max(r.log_weight for i, r in one.items() if i not in kept[0])


def test_expected_good():
    step = [(10, 1, 80), (10, None, 800), (0, 0, 20), (0, None, 200)]
    assert quality.expected_good(step) == pytest.approx(0.8)
    biased = [(10, 1, 5), (10, None, 800), (0, 0, 200), (0, None, 200)]  # few good labels
    assert quality.expected_good(biased) == pytest.approx(805 / 1205)
    assert quality.expected_good([(3, 1, 4), (2, None, 5)]) == quality.expected_good([(3, 0, 4)]) == quality.expected_good([]) == 1
    mixed = [(5, 1, 90), (5, 0, 10), (5, None, 100), (1, 1, 10), (1, 0, 90), (1, None, 100)]
    assert quality.expected_good(mixed) == pytest.approx(0.5)


def test_quality_awkward(spark):
    rows, labels = quality_rows(80)
    extra = [(900, "the house " * 40_000, "en", "s", 0)] * 2
    told = spark.createDataFrame([*labels, (900, 1, 0), (900, 1, 0), (None, 1, 0), (901, None, None), (902, 7, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs_of(spark, rows + extra + AWKWARD[:3]), told).collect()
    assert len(found) == 85 and [r.kept for r in found if r.doc_id == 900] == [True, True]
    df = clashing(spark).selectExpr("*", "'y' as log_weight", "'y' as Draw", "'y' as __ratio")
    kept = quality.keep_documents(df, told)
    assert kept.columns == df.columns and 0 < kept.count() <= len(AWKWARD)
    assert quality.score_documents(docs_of(spark, rows), told.where("quality = 0")).where("kept").count() == 80
    assert mixing.draw_documents(df).columns == df.columns


# --- toxicity ----------------------------------------------------------------


def toxic_rows(n=900):
    rng = random.Random(13)
    calm = [f"{a}{b}" for a in ("mor", "bel", "tan", "sil", "ver") for b in ("ning", "low", "der", "vet", "ona", "ish")]
    foul = ["scoundrel", "blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 150))]
        if i % 3 == 0:
            for _ in range(2):
                bad = list(rng.choice(foul))
                if i % 2:
                    bad[rng.randrange(2, len(bad) - 2)] = rng.choice("xyz")
                w[rng.randrange(len(w))] = "".join(bad)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    df, told = docs_of(spark, rows + [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "calm", "en", "s", 0)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(df, told).collect()
    assert len(found) == len(rows) + 3
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in found if r.held_out and r.doc_id < 5000]
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    learned = {r for r in toxicity.training_rows(df, told)[0]}
    assert not learned & {rows[r.doc_id][1] for r in held}


def test_toxicity_of_long_and_repeated_rows(spark):
    """A long text trains like any other, and its one foul word is found."""
    rows, labels = toxic_rows(300)
    foul, calm = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 3 != 1][:2]  # both train
    long_ = "morning below tanona " * 30_000
    rows += [(foul, long_ + "blockhead scoundrel", "en", "s", 0), (calm, long_, "en", "s", 0), *rows[:5], (foul, long_, "en", "s", 0)]
    told = spark.createDataFrame([*labels, (foul, 1, 1), (foul, 1, 1), (calm, 1, 0), (None, 1, 1), (3003, 1, None)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows)
    texts, marks = toxicity.training_rows(df, told)
    assert sum(len(t) > 500_000 for t in texts) == 2 and len(texts) == len(marks)
    found = toxicity.score_documents(df, told).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.score, r.predicted))
    assert all(len(by[r[0]]) == 1 for r in rows[:5])
    assert {p for _, p in by[calm]} == {0} and {p for _, p in by[foul]} == {0, 1}


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs_of(spark, []), none).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(clashing(spark), none).collect())


# --- decontamination ---------------------------------------------------------


def test_masks_survive_two_substitutions():
    from itertools import combinations

    for errors in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not {s + o for o in m} & set(errors) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def brute_leaks(rows, items):
    out = {}
    for doc, text, *_ in rows:
        d = (text or "").lower().split()
        for item, t in items:
            b = (t or "").lower().split()
            need = min(len(b), 13)
            for shift in range(-len(b), len(d)):
                equal = [0 <= j + shift < len(d) and d[j + shift] == b[j] for j in range(len(b))]
                for j in range(len(b) - need + 1):
                    hit = sum(equal[j : j + need])
                    if len(b) >= 5 and hit >= (need if need < 13 else 11):
                        out[doc, item] = max(out.get((doc, item), 0), hit)
    return out


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", most)
    rng = random.Random(17)
    w = lambda n: [f"v{rng.randint(0, 60)}" for _ in range(n)]
    items = [(i, " ".join(w(n))) for i, n in enumerate([13, 20, 40, 9, 6, 5, 12, 4, 1])] + [(90, None), (91, ""), (3, None)]
    rows = []
    for i in range(60):
        text = w(rng.randint(0, 60))
        item = (items[rng.randrange(7)][1] or "").split()
        for _ in range(rng.randint(0, 3)):
            if item:
                item[rng.randrange(len(item))] = "changed"
        a = rng.randrange(len(item)) if rng.random() < 0.3 else 0
        at = rng.randint(0, len(text))
        rows.append((i, " ".join([*text[:at], *item[a:], *text[at:]]).title(), "en", "s", 0))
    rows += AWKWARD[:4]
    rows = [(100 + i, *r[1:]) if i >= 60 else r for i, r in enumerate(rows)]
    found = decontaminate.leaked_documents(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in found} == brute_leaks(rows, items)
    kept = decontaminate.drop_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in brute_leaks(rows, items)}


def test_leaks_in_long_and_repeated_rows(spark):
    """A long text costs what its words cost, and each of its places counts."""
    import time

    rng = random.Random(43)
    item = [f"q{i}" for i in range(16)]
    filler = [f"f{rng.randint(0, 3000)}" for _ in range(120_000)]
    rows = [(1, " ".join([*filler, *item]), "en", "s", 0), (2, " ".join([*item[:13], *filler]), "en", "s", 0), (3, " ".join(filler), "en", "s", 0)]
    rows += [(4, " ".join(["x", *item, "y"]), "en", "s", 0)] * 50 + [(None, " ".join(item), "en", "s", 0)] * 3
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "not here at all in any text")], "item_id long, text string")
    began = time.time()
    found = decontaminate.leaked_documents(docs_of(spark, rows), items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.matched) for r in found) == [("1", 1, 13), ("2", 1, 13), ("4", 1, 13), ("None", 1, 13)]
    assert time.time() - began < 60
    assert [r.doc_id for r in decontaminate.drop_leaks(docs_of(spark, rows), items).collect()] == [3]


def test_leaks_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "words that nobody here has ever said")], "item_id long, text string")
    assert decontaminate.leaked_documents(clashing(spark), none).count() == 0
    assert decontaminate.drop_leaks(clashing(spark), none).count() == len(AWKWARD)
    assert decontaminate.leaked_documents(docs_of(spark, []), some).count() == 0


# --- sharding ----------------------------------------------------------------


def test_best_fit():
    rng = random.Random(19)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 60))), reverse=True)
        got = shards.best_fit_decreasing(sizes, 50)
        left, told = [], []
        for s in sizes:
            fit = [(r, i) for i, r in enumerate(left) if r >= s]
            i = min(fit)[1] if fit else len(left)
            if not fit:
                left.append(50)
            left[i] -= s
            told.append(i)
        assert got == told


def test_capacity_tree_splits():
    rng = random.Random(20)
    tree, held = shards.CapacityTree(), set()
    for i in range(5000):
        if rng.random() < 0.6:
            e = (rng.randint(0, 300), i)
            tree.add(e)
            held.add(e)
        else:
            size = rng.randint(0, 310)
            told = min((e for e in held if e >= (size, -1)), default=None)
            assert tree.take_tightest(size) == told
            held.discard(told)


def check_shards(rows, found, n=40):
    assert len(found) == len(rows)
    of, slots, load = {}, defaultdict(list), Counter()
    sizes = sorted((r[0], len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sizes
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards(spark):
    rng = random.Random(21)
    rows = [(i, "x" * rng.randint(1, 3000) + str(i % 900), "en", "s", 0) for i in range(2000)]
    load = check_shards(rows, shards.shard_documents(docs_of(spark, rows)).collect())
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    hot = rows + [(5000 + i, "hot", "en", "s", 0) for i in range(20000)]
    load = check_shards(hot, shards.shard_documents(docs_of(spark, hot)).collect())
    rest = sorted(load.values())[:-1]
    assert rest[-1] - rest[0] <= 0.02 * rest[-1]


def test_shards_edges(spark):
    check_shards(AWKWARD, shards.shard_documents(clashing(spark)).collect())
    assert shards.shard_documents(docs_of(spark, [])).count() == 0
    again = [sorted(map(str, shards.shard_documents(docs_of(spark, AWKWARD)).collect())) for _ in range(2)]
    assert again[0] == again[1]


# --- repeated passages -------------------------------------------------------


def brute_cut(rows, length=400):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for r, x in zip(rows, raw):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((r[0], len(x), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passage_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé fgh\n") for _ in range(n))
    shared, rows = [text(rng.randint(380, 700)) for _ in range(4)], []
    for i in range(60):
        t = text(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(shared) + text(rng.randint(0, 80))
        rows.append((i, t, "en", "s", 0))
    rows += [(100, rows[3][1], "en", "s", 0), (100, rows[3][1], "en", "s", 0), (101, "ab" * 600, "en", "s", 0), (102, "z" * 399, "en", "s", 0), (103, "z" * 400, "en", "s", 0), (104, "y" * 401, "en", "s", 0)]
    return rows + [(200 + i, *r[1:4], 0) for i, r in enumerate(AWKWARD[:9])] + [(None, shared[0], "en", "s", 0), (None, "q" * 10, "en", "s", 0)]


@pytest.mark.parametrize("most", [4096, 4])
def test_repeated_passages(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "SHARD_TEXTS", most)
    rows = passage_rows(most)
    found = suffix.strip_documents(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_cut(rows)


def test_repeated_passages_edges(spark):
    assert suffix.strip_documents(docs_of(spark, [])).count() == 0
    rows = suffix.strip_documents(clashing(spark)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_cut(AWKWARD)


def test_repeated_bytes(spark):
    """Texts that repeat themselves give few runs, and are still cut exactly."""
    from pyspark.sql import functions as F

    rng = random.Random(29)
    rows = [(1, "a" * 6000, "en", "s", 0), (2, "ab" * 2500 + "c", "en", "s", 0), (3, "".join(rng.choice("xyz") for _ in range(700)) + "a" * 900, "en", "s", 0), (4, ("wort " * 7 + "x") * 150, "en", "s", 0), (5, "b" * 400, "en", "s", 0)]
    found = suffix.strip_documents(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_cut(rows)
    long_ = docs_of(spark, [(1, "a" * 1_000_000, "en", "s", 0), (2, "b" * 399, "en", "s", 0)])
    told = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.strip_documents(long_).collect()}
    assert told == {1: (1_000_000, 1), 2: (0, 0)}
    keyed = long_.select(F.lit(1).cast("long").alias("row"), F.lit(1).cast("long").alias("key"), F.lit(1).cast("long").alias("check"), "text")
    assert suffix.anchored(keyed).count() <= 1000


def test_hot_minimizer(spark, monkeypatch):
    """One passage in many contexts: its minimizer is dealt over many shards."""
    monkeypatch.setattr(suffix, "SHARD_TEXTS", 8)
    rng = random.Random(30)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, side = text(500), text(150)
    rows = [(i, text(rng.randint(0, 300)) + (side if i % 3 == 0 else "") + passage + (side if i % 5 == 0 else "") + text(rng.randint(0, 300)), "en", "s", 0) for i in range(120)]
    rows += [(None, rows[0][1], "en", "s", 0)] * 3 + [(7, rows[7][1], "en", "s", 0)]
    found = suffix.strip_documents(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_cut(rows)


def test_fingerprints_decide_nothing(spark):
    """Strings of one fingerprint that differ are told apart by their bytes."""
    x, y = b"q" * 200 + b"r" * 300, b"q" * 200 + b"r" * 250 + b"s" * 50
    assert suffix.same_strings(x, y, np.array([0, 10, 50, 51, 100]), 0).tolist() == [True, True, True, False, False]
    assert suffix.same_strings(b"--" + x, y, np.array([2, 52, 53]), 2).tolist() == [True, True, False]
    z = b"t" * 500
    columns = "gram long, digest binary, first int, last int, slices int, text binary, starts array<int>, prints array<long>"
    rows = [(1, b"x", 0, 0, 2, x, [0, 80, 90], [5, 6, 7]), (1, b"y", 0, 0, 2, y, [0, 80, 90], [5, 6, 8]), (1, b"z", 0, 0, 2, z, [0, 3], [5, 6]), (1, b"zz", 0, 0, 2, z, [1, 7], [5, 9]), (2, b"x", 0, 0, 2, x, [0], [5]), (1, b"u", 4, 9, None, None, None, None)]
    told = {tuple(r) for r in suffix.merged(spark.createDataFrame(rows, columns)).collect()}
    assert {(g, bytes(d), a, b) for g, d, a, b in told} == {(1, b"x", 0, 0), (1, b"y", 0, 0), (1, b"z", 0, 0), (1, b"z", 3, 3), (1, b"zz", 1, 1)}


def test_long_texts_come_in_pieces():
    rng = np.random.default_rng(23)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 5000])
    whole = {(int(f), int(x)) for _, f, x, _ in zip(*suffix.runs(data, offsets))}
    starts = Counter()
    for piece, cuts, shift in suffix._pieces(data, offsets, 0, 1, 400, 1000):
        for _, f, x, _ in zip(*suffix.runs(piece, cuts)):
            for s in range(f + shift, x + shift + 1):
                starts[s] += 1
    assert set(starts) == {s for f, x in whole for s in range(f, x + 1)} == set(range(4601)) and set(starts.values()) == {1}


def test_suffix_array_and_prefixes():
    rng = random.Random(25)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"abcd", b"a", bytes([0, 1, 255])])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        data = b"".join(texts)
        order, word = suffix.suffix_array(np.frombuffer(data, np.uint8))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        got = suffix.common_prefixes(order, word, starts, 12)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 12 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert got[b] == n


def test_ascii_lower(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("ÄBCé",)], "t string").select(ascii_lower(F.col("t")).alias("t")).first().t == "Äbcé"
