"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Texts with equal shingle sets, by 128 bits of fingerprint, are one class. Classes that share a band are
candidates. In each bucket all classes are first compared with one hub, the
least id, on full sets. Buckets whose classes those links leave in more than one
component are then searched across components: every pair is held against an
upper bound of its similarity taken from bit maps of the sets, which never
rejects a true link, and what passes is compared on full sets. Large buckets
are cut into blocks for that, and all pairs of blocks are searched. So no bucket
emits all its pairs, and no link between different texts in a shared bucket is
lost. Two linked classes share no bucket with probability below 1e-7: the lower
the percentage, the more bands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WORD, free_name, materialize, mix64, shingle_hashes, slices, text_buffers, word_hashes
from .minhash import PERCENT, ROWS, band_keys, bands_for, distinct_elements, signatures

WORDS = 5
#: Residual buckets above this many classes are cut into blocks of about as many,
#: or of this many bytes of bit maps, and compared block against block.
LARGEST, BLOCK_BYTES = 4096, 1 << 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, and the text of each."""
    return distinct_elements(*shingle_hashes(*word_hashes(data, offsets), WORDS))


def class_ids(elements: np.ndarray, owner: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set: its class, and a check."""
    out = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
        total = np.zeros(sets, np.uint64)
        np.add.at(total, owner, mix64(elements ^ np.uint64(salt)))
        out.append(mix64(total + np.bincount(owner, minlength=sets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64)))


def fingerprints(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, print, n, cls, check, keys): a hash of the text, the size of its
    set, its class, its bands."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets, SLICE):
                s, of = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(of, minlength=b - a)
                keys = band_keys(signatures(s, of, b - a, bands * ROWS), bands)
                cls, check = class_ids(s, of, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n), pa.array(cls), pa.array(check), _lists(keys.ravel(), np.full(b - a, keys.shape[1]))], names=["doc_id", "print", "n", "cls", "check", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("print"), "text").mapInArrow(run, f"doc_id {kind}, print long, n long, cls long, check long, keys array<long>")


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a row for each class with its least id, a row that holds
    its text (id and hash), its set's size and check. Counted before they are
    shuffled, so that a hot class is a row a task. Sets that share a class and
    not the check, one in some 2**64 pairs, get classes of their own first."""

    def counted(rows: DataFrame) -> DataFrame:
        least, most = F.min("check").alias("check"), F.max("check").alias("_most")
        return materialize(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("_low"), F.min(F.struct("doc_id", "print")).alias("_at"), least, most))

    classes = counted(rows)
    odd = classes.where("check <> _most").select(F.col("cls").alias("_odd"))
    if not odd.isEmpty():
        own = F.when(F.col("_odd").isNotNull(), F.xxhash64("cls", "check")).otherwise(F.col("cls"))
        rows = materialize(rows.join(odd, F.col("cls") == F.col("_odd"), "left").withColumn("cls", own).drop("_odd"))
        classes = counted(rows)
    return rows, classes


def bit_map(elements: np.ndarray) -> bytes:
    """8 to 16 bits an element, a power of two in all."""
    bits = np.zeros(8 << max(3, int(len(elements) - 1).bit_length()), bool)
    bits[(mix64(elements) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def full_sets(rows: DataFrame, bands: int) -> DataFrame:
    """(text, cls, check) -> (cls, elements, bits, keys), once a task for a class,
    however many rows repeat its id and text."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            cls, check = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            fresh = np.array([c not in done and not done.add(c) for c in cls.tolist()], bool)
            for a, b in slices(offsets, SLICE):
                if not fresh[a:b].any():
                    continue
                s, of = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                right = np.flatnonzero((class_ids(s, of, b - a)[1] == check[a:b]) & fresh[a:b])
                cut = np.searchsorted(of, np.arange(b - a + 1))
                parts = [s[cut[i] : cut[i + 1]] for i in right]
                n = np.array([len(p) for p in parts], np.int64)
                if not len(parts):
                    continue
                s = np.concatenate(parts)
                keys = band_keys(signatures(s, np.repeat(np.arange(len(right)), n), len(right), bands * ROWS), bands)
                yield pa.RecordBatch.from_arrays([pa.array(cls[a:b][right]), _lists(s, n), pa.array([bit_map(p) for p in parts], pa.binary()), _lists(keys.ravel(), np.full(len(right), keys.shape[1]))], names=["cls", "elements", "bits", "keys"])

    return rows.mapInArrow(run, "cls long, elements array<long>, bits binary, keys array<long>")


def _fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def possible_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of one bucket's rows (bucket, part, cls, label, hub, keys, bits, n)
    of different labels, neither of them the hub, whose similarity may reach
    the percentage, and which no earlier band shares. Where ``part`` is 0 or 1,
    only pairs of a 0 and a 1."""
    pdf = pdf[pdf["cls"] != pdf["hub"]].drop_duplicates("cls").sort_values(["n", "cls"], ignore_index=True)
    n, cls, label = (pdf[c].to_numpy(np.int64) for c in ("n", "cls", "label"))
    bucket = int(pdf["bucket"].iloc[0]) if len(pdf) else 0
    part = None if pdf["part"].isna().any() else pdf["part"].to_numpy(np.int64)
    keys = np.stack(pdf["keys"].to_numpy()) if len(pdf) else np.zeros((0, 1), np.int64)
    width = pdf["bits"].map(len).to_numpy()
    maps = {w: np.frombuffer(b"".join(pdf["bits"][width == w]), np.uint64).reshape(-1, w // 8) for w in set(width.tolist())}
    start = {w: int(np.flatnonzero(width == w)[0]) for w in maps}  # widths ascend with n
    folded: dict[int, np.ndarray] = {}
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sizes, counts = np.unique(label, return_counts=True)
    main = sizes[counts.argmax()] if len(sizes) else None
    for i in np.flatnonzero(label != main if part is None else part == 0):
        # Pairs outside the main label come once; those with it from this side.
        fit = (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (label != label[i])
        fit &= (label == main) | (np.arange(len(n)) > i) if part is None else part == 1
        some = np.flatnonzero(fit)
        for w in sorted(set(width[some].tolist())):
            js = some[width[some] == w]
            mine, theirs = maps[width[i]][i - start[width[i]]], maps[w][js - start[w]]
            if w > width[i]:
                if w not in folded:
                    folded[w] = _fold(maps[w])
                theirs = folded[w][js - start[w]]
            elif w < width[i]:
                mine = _fold(mine[None])[0]
            both = np.bitwise_count(theirs & mine).sum(1, dtype=np.int64)
            only_mine = np.bitwise_count(mine).sum(dtype=np.int64) - both
            only_theirs = np.bitwise_count(theirs).sum(1, dtype=np.int64) - both
            most = np.minimum(n[i] - only_mine, n[js] - only_theirs)  # of shared elements
            js = js[100 * most >= percent * (n[i] + n[js] - most)]
            if len(js):
                first = (keys[js] == keys[i]).argmax(1)
                js = js[keys[i][first] == bucket]
                out.append((np.full(len(js), cls[i]), cls[js]))
    if not out:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    a, b = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def blocks(rows: DataFrame, percent: int, largest: int = LARGEST) -> DataFrame:
    """Rows (key, hub, cls, label, n, width) of large buckets, with (part, x, y):
    the pairs of blocks x, y in which a row is to be compared, and its side.

    A bucket's rows are cut by side (of its most frequent label or not), by size
    into steps of which only neighbours can hold links, and by class hash. Every
    block outside the main label meets itself, each other one once and all of the
    main label, as far as sizes allow; blocks of the main label never meet."""
    step = max(math.log(100 / percent), 1e-9) * (1 + 1e-9)
    main = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("_main"))
    rows = rows.join(F.broadcast(main), "key").withColumns({"_side": (F.col("label") == F.col("_main")).cast("long"), "_step": F.floor(F.log("n") / step)})
    most = F.greatest(F.count("*") / largest, F.sum("width") / BLOCK_BYTES)
    cuts = rows.groupBy("key", "_side", "_step").agg(F.ceil(most).alias("_cuts"))
    name = F.shiftleft(F.col("_step"), 32) + 2 * F.col("_cut") + F.col("_side")
    named = cuts.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))).select("key", "_side", "_step", name.alias("_block"))
    left = named.where("_side = 0").select("key", F.col("_block").alias("x"), F.col("_step").alias("_at"))
    tasks = left.join(named.withColumnRenamed("_block", "y"), "key").where("abs(_step - _at) <= 1 and (_side = 1 or x <= y)").select("key", "x", "y")
    tasks = materialize(tasks)
    seats = tasks.select("key", F.col("x").alias("_block"), F.when(F.col("x") != F.col("y"), 0).alias("part"), "x", "y")
    seats = seats.unionAll(tasks.where("x <> y").select("key", F.col("y").alias("_block"), F.lit(1).alias("part"), "x", "y"))
    rows = rows.join(cuts, ["key", "_side", "_step"]).withColumn("_cut", F.pmod(F.xxhash64("cls"), F.col("_cuts"))).withColumn("_block", name)
    return rows.join(seats, ["key", "_block"]).select("key", "hub", "cls", "label", "part", "x", "y")


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the links, the root being the least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the least node reachable.

    Each task joins its own links by union-find into stars; least labels then
    pass along the stars and jump to their label's label until none changes,
    which takes rounds in the logarithm of a component's width."""

    def contract(batches):
        a = [np.zeros(0, np.int64)]
        b = [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            if sum(map(len, a)) > 2_000_000:
                nodes, roots = union_find(np.concatenate(a), np.concatenate(b))
                a, b = [nodes], [roots]
        nodes, roots = union_find(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

    edges = materialize(links.select("a", "b").mapInArrow(contract, "a long, b long").distinct())
    both = materialize(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step)
        up = step.select(F.col("node").alias("_up"), F.col("label").alias("_to"))
        step = materialize(step.join(up, F.col("label") == F.col("_up"), "left").select("node", "old", F.least("label", "_to").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    size = lambda c: F.size(c).cast("long")
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("_b"))
    found = pairs.select("a", "b").join(right, "b").join(left, "a")
    found = found.where(100 * F.least(size("_a"), size("_b")) >= percent * F.greatest(size("_a"), size("_b")))
    found = found.withColumn("_i", size(F.array_intersect("_a", "_b")))
    return found.where(100 * F.col("_i") >= percent * (size("_a") + size("_b") - F.col("_i"))).select("a", "b")


def groups(docs: DataFrame, percent: int = PERCENT, largest: int = LARGEST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, cls, check, root (the component's
    least class, null without words) for every row of ``docs``.

    Texts without words, null ones too, are linked with nothing and are their
    own component. Rows that repeat an id and a text share a component, and
    each says the same; a null id is a component's only if no other is in it.
    Other columns of ``docs``, whatever their names, are not read; texts of any
    length are read whole.
    """
    bands = bands_for(percent)
    rows, classes = classes_of(materialize(fingerprints(docs, bands)))
    some = rows.where("n > 0")
    banded = some.select("cls", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("_last")).where("hub < _last").select("key", "hub")
    members = materialize(banded.join(buckets, "key").select("key", "hub", "cls").distinct())
    pairs = members.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    wanted = members.select("cls").distinct()
    texts = classes.join(wanted, "cls").select(F.col("_at.doc_id").alias("_id"), F.col("_at.print").alias("_print"), "cls", "check")
    fetched = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    fetched = fetched.join(texts.hint("shuffle_hash"), (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = materialize(full_sets(fetched.select("text", "cls", "check"), bands))
    links = materialize(verified(pairs, sets, percent))
    labels = components(links)
    # What the hubs have not settled.
    labelled = members.join(labels, F.col("cls") == F.col("node"), "left").select("key", "hub", "cls", F.coalesce("label", "cls").alias("label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_rows")).where("_low < _high and _rows > 2").select("key", "_rows")
    open_ = materialize(open_)
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    rest = labelled.join(open_.where(F.col("_rows") <= largest), "key").select("key", "hub", "cls", "label", none("int", "part"), none("long", "x"), none("long", "y"))
    large = open_.where(F.col("_rows") > largest)
    if not large.isEmpty():
        wide = labelled.join(large, "key").join(sets.select("cls", F.size("elements").alias("n"), F.length("bits").alias("width")), "cls")
        rest = rest.unionByName(blocks(materialize(wide.drop("_rows", "node")), percent, largest))
    rest = rest.join(sets.select("cls", "keys", "bits", F.size("elements").alias("n")), "cls").withColumnRenamed("key", "bucket")
    more = rest.groupBy("bucket", "x", "y").applyInPandas(lambda pdf: possible_links(pdf, percent), "a long, b long")
    more = verified(more, sets, percent)
    labels = components(links.unionAll(more))
    lows = classes.select("cls", "_low").join(labels, F.col("cls") == F.col("node"), "left").select("cls", "_low", F.coalesce("label", "cls").alias("_root"))
    lows = materialize(lows)
    least = lows.groupBy("_root").agg(F.min("_low").alias("_id"))
    named = lows.join(least, "_root").select(F.col("cls").alias("_cls"), F.col("_id"), F.col("_root"))
    out = rows.join(named, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "cls", "check", F.col("_root").alias("root"))


def group_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    return groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def class_of(text: pa.Array) -> pa.Array:
    """The check of each text's class, as in fingerprints()."""
    data, offsets = text_buffers(text)
    out = np.zeros(len(text), np.int64)
    for a, b in slices(offsets, SLICE):
        out[a:b] = class_ids(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)[1]
    return pa.array(out)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group, of its least id; where that has more
    than one row in the group, or is null, of the least class. Texts without words
    stay, one of those that share an id and a text. Joined are the ids that go,
    as they are the fewer; only rows of repeated or null ids are judged by class."""
    every = groups(docs, percent)
    found = every.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = materialize(found.where("_rows > 1 or _kept = 0").select("_id", "_kept"))
    some = odd.where("_kept > 0")
    once = docs.join(odd, docs["doc_id"].eqNullSafe(odd["_id"]), "left_anti")
    if some.isEmpty():
        return once
    again = docs.join(some, docs["doc_id"].eqNullSafe(some["_id"]), "left_semi")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    blank = again.where(~worded).dropDuplicates(["doc_id", "text"])
    # The rows that stand for a group have one id, that of the group.
    stand = every.where("kept and n_shingles > 0").groupBy("root").agg(F.first("doc_id").alias("_id"), F.min(F.struct("cls", "check")).alias("_stands"))
    stand = materialize(stand.join(some.select(F.col("_id").alias("_some")), F.col("_id").eqNullSafe(F.col("_some")), "left_semi").select("_id", F.col("_stands.check").alias("_stands")))
    name = free_name("class", docs.columns)
    told = again.where(worded).withColumn(name, F.arrow_udf(class_of, "long")(F.col("text")))
    told = told.join(stand, told["doc_id"].eqNullSafe(stand["_id"]) & (told[name] == stand["_stands"]), "left_semi")
    told = told.dropDuplicates(["doc_id", name]).drop(name)
    return once.unionByName(blank).unionByName(told)


GROUPS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
