"""Removal of repeated passages with suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere
else too. Every string has a minimizer, the K-gram in it with the least hash;
equal strings have equal ones. A text's string starts thus fall into runs with
one minimizer each, and only runs with equal minimizers can hold equal strings.
Runs with equal texts are settled by their count (texts count as equal if their
128-bit hashes are). The distinct texts of each remaining minimizer go to shards;
each shard is sorted into a suffix array by Larsson-Sadakane refinement, common
prefixes follow by Kasai's rule, and a string is repeated if it shares LENGTH
bytes with a neighbour.

A minimizer with more texts than a shard takes is dealt over shards. Each gives
one start of every string it holds, under a fingerprint; strings of all shards
meet by fingerprint, look up the first of their kind by binary search, and are
then compared with it byte by byte. What differs from the first of its
fingerprint is compared by its bytes with the others that do. So the same strings
are found at every size, and none by a fingerprint alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, SLICE, materialize, mix64, powers, slices, text_buffers

LENGTH, K = 400, 100
#: Bytes of text to a shard, and texts of one minimizer that a shard takes.
SHARD_BYTES, SHARD_TEXTS = 2 << 20, 4096
#: The most starts of a run: where a text repeats itself, one minimizer goes on.
MOST_STARTS = 1024
#: Ranges of fingerprints for each shard that a minimizer is dealt over.
RANGES = 64
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return x


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    return mix64((total[k:] - total[:-k]) * inverse[: n - k + 1])


def runs(data: np.ndarray, offsets: np.ndarray):
    """(text, first start, last start, minimizer) of the runs of string starts,
    offsets within the concatenation of at most 16 MB."""
    return all_runs(data, offsets)[:4]


def all_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """As ``runs``, and whether the minimizer occurs more than once in the run,
    without which all strings of a run differ."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    grams = _gram_hashes(data, k)
    # The order is by 40 bits of hash, then by place: the first of equals.
    least = _sliding_min(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    inside = np.zeros(n + 1, np.int32)
    long_ = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    valid = np.cumsum(inside[: len(least)]) > 0
    at = (least & _PLACE).astype(np.int64)
    minimizer = grams[at]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (minimizer[1:] != minimizer[:-1])
    begin[offsets[:-1][long_]] = True
    since = np.arange(len(begin)) - np.maximum.accumulate(np.where(begin, np.arange(len(begin)), 0))
    begin |= valid & (since % MOST_STARTS == 0)
    first = np.flatnonzero(begin)
    end = valid.copy()
    end[:-1] &= ~valid[1:] | begin[1:]
    last = np.flatnonzero(end)
    return np.searchsorted(offsets, first, side="right") - 1, first, last, minimizer[first], at[first] != at[last]


def _pieces(data: np.ndarray, offsets: np.ndarray, a: int, b: int, length: int, most: int):
    """Slices of whole texts; a text above ``most`` bytes comes in pieces that
    overlap so that each string start is in one piece."""
    if b - a > 1 or offsets[b] - offsets[a] <= most:
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 0
        return
    for at in range(0, int(offsets[b] - offsets[a]), most - length + 1):
        piece = data[offsets[a] + at : min(offsets[b], offsets[a] + at + most)]
        yield piece, np.array([0, len(piece)]), at


def anchored(docs: DataFrame) -> DataFrame:
    """(row, key, check, gram, digest, at, size, more): the runs of each text.
    ``digest`` is of the run's text, which starts at ``at`` with ``size`` bytes;
    ``more``: whether it may repeat a string of its own."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for a, b in slices(offsets, SLICE):
                for piece, cuts, shift in _pieces(data, offsets, a, b, LENGTH, 1 << 23):
                    of, first, last, gram, more = all_runs(piece, cuts)
                    if not len(of):
                        continue
                    view = memoryview(np.ascontiguousarray(piece))
                    digest = [xxhash.xxh3_128_digest(view[x : y + LENGTH]) for x, y in zip(first.tolist(), last.tolist())]
                    take = pa.array(a + of)
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(3)], pa.array(gram.view(np.int64)), pa.array(digest, pa.binary()), pa.array((first - cuts[of] + shift).astype(np.int64)), pa.array((last - first + LENGTH).astype(np.int32)), pa.array(more)], names=["row", "key", "check", "gram", "digest", "at", "size", "more"])

    return docs.select("row", "key", "check", "text").mapInArrow(run, "row long, key long, check long, gram long, digest binary, at long, size int, more boolean")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, 8-byte words at each place). Larsson-Sadakane: groups of
    suffixes that agree so far are sorted by the rank of what follows, so that
    what is compared doubles each time; what stands alone is left alone."""
    n = len(data)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        word = word << np.uint64(8) | padded[i : n + i]
    order = np.argsort(word, kind="stable")
    sorted_ = word[order]
    begins = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    h = 8
    while True:
        alone = begins & np.concatenate([begins[1:], [True]])
        some = np.flatnonzero(~alone)
        if not len(some):
            break
        suffix = order[some]
        then = suffix + h  # past the end, the shorter suffix is the lesser
        follows = np.where(then < n, rank[np.minimum(then, n)], n - 1 - then)
        pair = rank[suffix] * (4 * n + 32) + follows + 2 * n + 16
        by = np.argsort(pair, kind="stable")
        pair, suffix = pair[by], suffix[by]
        order[some] = suffix
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        begins[some] = new
        rank[suffix] = some[new][np.cumsum(new) - 1]
        h *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, up to ``cap``, that each suffix shares with the one before it in
    the array. Kasai: going from a suffix to the next in the text loses one byte
    at most. The texts, which begin at ``starts``, are walked side by side."""
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    word = np.concatenate([word, np.zeros(cap + 8, np.uint64)])
    out = np.zeros(n, np.int32)
    sizes = np.diff(np.concatenate([starts, [n]]))
    by = np.argsort(-sizes, kind="stable")
    here, sizes = starts[by].copy(), sizes[by]
    shared = np.zeros(len(by), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        lanes = int(np.searchsorted(-sizes, -step))
        i, s = here[:lanes] + step, np.maximum(shared[:lanes] - 1, 0)
        j = before[i]
        s[j < 0] = 0
        # Past the shorter suffix's end the words are padded; ends are cut off below.
        going = np.flatnonzero(j >= 0)
        while len(going):
            x, y = i[going] + s[going], j[going] + s[going]
            far = np.minimum(np.maximum(x, y), n)
            differ = word[np.minimum(x, n)] ^ word[np.minimum(y, n)]
            same = (differ == 0) & (far < n)
            stopped = differ[~same]
            s[going[~same]] += sum((stopped < np.uint64(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8))
            s[going[same]] += 8
            going = going[same & (s[going] < cap)]
        np.minimum(s, np.minimum(n - i, cap), out=s)
        s[j >= 0] = np.minimum(s[j >= 0], n - j[j >= 0])
        out[i] = s
        shared[:lanes] = s
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, whether the string at each of its len - length + 1 starts
    also starts elsewhere in the texts, and whether it does so earlier in the
    suffix array: of equal strings, all but one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    order, word = suffix_array(data)
    prefix = common_prefixes(order, word, starts, length)[order]
    left = np.repeat(starts + sizes, sizes)[order] - order
    whole = left >= length  # suffixes with a whole string
    places = np.flatnonzero(whole)
    again, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(places) > 1:
        # Shared by two suffixes: the least of what neighbours between them share.
        shared = np.minimum.reduceat(np.concatenate([prefix, [0]]), np.stack([places[:-1] + 1, places[1:] + 1], 1).ravel())[::2]
        same = shared >= length
        later[order[places[1:][same]]] = True
        again |= later
        again[order[places[:-1][same]]] = True
    return [(again[s : s + n - length + 1], later[s : s + n - length + 1]) for s, n in zip(starts, sizes)]


def ranges_of(flags: np.ndarray) -> np.ndarray:
    """(k, 2) first and last positions of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, digest, slice, slices, text) of the runs wanted (row, cuts). Rows
    that share an id and a text are one row here, read once a task."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows: list[tuple] = []
            held = 0
            for i, (row, cuts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                for c in () if row in done else cuts.as_py():
                    text = data[offsets[i] + c["at"] : min(offsets[i + 1], offsets[i] + c["at"] + c["size"])].tobytes()
                    if len(text) == c["size"] and xxhash.xxh3_128_digest(text) == c["digest"]:
                        rows.append((c["gram"], c["digest"], c["slice"], c["slices"], text))
                        held += len(text)
                done.add(row)
                if held > 1 << 22 or i == len(batch) - 1 and rows:
                    g, d, s, m, t = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d, pa.binary()), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(t, pa.binary())], names=["gram", "digest", "slice", "slices", "text"])
                    rows, held = [], 0

    rows = docs.select("row", "text").join(wanted.hint("shuffle_hash"), "row")
    return rows.select("row", "text", "cuts").mapInArrow(run, "gram long, digest binary, slice int, slices int, text binary")


def _sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's repeated starts as ranges (gram, digest, first, last), and for
    texts of a split minimizer, with the text, one start of each string that the
    shard holds and its fingerprint."""
    pdf = pdf.drop_duplicates(["gram", "digest"]).sort_values(["gram", "digest"], ignore_index=True)
    out: list[tuple] = []
    for row, (again, later) in zip(pdf.itertuples(), repeated_starts(pdf["text"].tolist())):
        for a, b in ranges_of(again).tolist():
            out.append((row.gram, row.digest, a, b, None, None, None, None))
        if row.slices > 1:
            starts = np.flatnonzero(~later)
            prints = _gram_hashes(np.frombuffer(row.text, np.uint8), LENGTH).view(np.int64)[starts]
            out.append((row.gram, row.digest, 0, 0, row.slices, row.text, starts, prints))
    return pd.DataFrame(out, columns=["gram", "digest", "first", "last", "slices", "text", "starts", "prints"]).astype({"slices": "Int32"})


def _look_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings of one minimizer and range of fingerprints, from several shards:
    those that another one of the same fingerprint comes before, with that one."""
    pdf = pdf.sort_values(["print", "digest", "first"], ignore_index=True)
    prints = pdf["print"].to_numpy(np.int64)
    at = np.searchsorted(prints, prints)
    hit = np.flatnonzero(at != np.arange(len(prints)))
    out = pdf.loc[hit, ["gram", "digest", "first"]]
    return out.assign(other=pdf["digest"].to_numpy()[at[hit]], other_first=pdf["first"].to_numpy()[at[hit]])


def same_strings(text: bytes, other: bytes, starts: np.ndarray, shift: int, length: int = LENGTH) -> np.ndarray:
    """For each of the ascending starts, whether the string of ``text`` there is
    that of ``other`` at the start less ``shift``, byte by byte."""
    low, high = int(starts[0]), int(starts[-1]) + length
    differ = np.frombuffer(text, np.uint8)[low:high] != np.frombuffer(other, np.uint8)[low - shift : high - shift]
    upto = np.concatenate([[0], np.cumsum(differ)])
    return upto[starts - low + length] == upto[starts - low]


def _compared(pairs: DataFrame) -> DataFrame:
    """Pairs of texts (gram, digest, text, other, other_text, shift, starts) ->
    (gram, digest, first, last): ranges of starts of either that are equal; and
    (gram, digest, first, last, string) of each start that is not."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for gram, digest, text, other, other_text, shift, starts in zip(*[c.to_pylist() for c in batch.columns]):
                starts = np.array(starts)
                same = same_strings(text, other_text, starts, shift)
                for a in starts[~same].tolist():
                    out.append((gram, digest, a, a, text[a : a + LENGTH]))
                starts = starts[same]
                edge = np.flatnonzero(np.diff(starts) != 1)
                for a, b in zip(starts[np.concatenate([[0], edge + 1])].tolist(), starts[np.concatenate([edge, [len(starts) - 1]])].tolist()) if len(starts) else ():
                    out += [(gram, digest, a, b, None), (gram, other, a - shift, b - shift, None)]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["gram", "digest", "first", "last", "string"])

    return pairs.select("gram", "digest", "text", "other", "other_text", "shift", "starts").mapInArrow(run, "gram long, digest binary, first int, last int, string binary")


def merged(sorted_: DataFrame) -> DataFrame:
    """(gram, digest, first, last): ranges of starts of strings that two shards
    of a minimizer hold, from what _sort_shard gives."""
    split = sorted_.where("starts is not null")
    strings = split.select("gram", "digest", "slices", F.explode(F.arrays_zip(F.col("starts").alias("first"), F.col("prints").alias("print"))).alias("s")).select("gram", "digest", "slices", "s.*")
    strings = strings.withColumn("_range", F.pmod(F.xxhash64("print"), F.col("slices") * RANGES))
    found = strings.groupBy("gram", "_range").applyInPandas(_look_up, "gram long, digest binary, first int, other binary, other_first int")
    pairs = found.groupBy("gram", "digest", "other", (F.col("first") - F.col("other_first")).alias("shift")).agg(F.sort_array(F.collect_list("first")).alias("starts"))
    held = split.select("gram", "digest", "text")
    pairs = pairs.join(held, ["gram", "digest"]).join(held.select("gram", F.col("digest").alias("other"), F.col("text").alias("other_text")), ["gram", "other"])
    compared = materialize(_compared(pairs))
    odd = compared.where("string is not null")
    twins = odd.groupBy("gram", "string").count().where("count > 1").select("gram", "string")
    return compared.where("string is null").unionByName(odd.join(twins, ["gram", "string"]), allowMissingColumns=True).select("gram", "digest", "first", "last")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, check, spans) for each distinct text of ``docs`` (row, key, check,
    n_bytes, text) that has any: sorted, disjoint, maximal byte ranges."""
    runs_ = materialize(anchored(docs.where(F.col("n_bytes") >= LENGTH)))
    texts = runs_.groupBy("gram", "digest").agg(F.count("*").alias("_rows"), F.min("row").alias("row"), F.min_by("at", "row").alias("at"), F.min("size").alias("size"), F.max("more").alias("_more"))
    texts = materialize(texts)
    # Distinct texts of one minimizer have to be sorted; what is only copied need not be.
    grams = texts.groupBy("gram").agg(F.count("*").alias("_texts"), F.max("_more").alias("_again")).where("_texts > 1 or _again")
    open_ = texts.join(grams, "gram")
    split = F.ceil(F.col("_texts") / SHARD_TEXTS).cast("int")
    open_ = materialize(open_.withColumns({"slices": split, "slice": F.pmod(F.xxhash64("digest"), split).cast("int")}))
    total, most = open_.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("slices"), F.lit(1))).first()
    shards = max(1, math.ceil(total / SHARD_BYTES))
    cuts = F.collect_list(F.struct("gram", "digest", "slice", "slices", "at", "size")).alias("cuts")
    found = _texts(docs, open_.groupBy("row").agg(cuts))
    shard = F.when(F.col("slices") == 1, F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("gram", "slice"), F.lit(1 << 30)) + shards)
    schema = "gram long, digest binary, first int, last int, slices int, text binary, starts array<int>, prints array<long>"
    sorted_ = materialize(found.withColumn("_shard", shard).groupBy("_shard").applyInPandas(_sort_shard, schema))
    ranges = sorted_.where("starts is null").select("gram", "digest", "first", "last")
    if most > 1:
        ranges = ranges.unionAll(merged(sorted_))
    copied = texts.where("_rows > 1").select("gram", "digest", F.lit(0).alias("first"), (F.col("size") - LENGTH).alias("last"))
    ranges = ranges.join(texts.where("_rows > 1").select("gram", "digest"), ["gram", "digest"], "left_anti").unionAll(copied)
    spans = runs_.select("key", "check", "gram", "digest", "at").join(ranges, ["gram", "digest"])
    spans = spans.select("key", "check", (F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + LENGTH).alias("b")).distinct()
    return spans.groupBy("key", "check").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without its sorted spans, bytes removed, maximal runs."""
    kept, at, removed, runs_ = [], 0, 0, 0
    end = -1
    for a, b in spans:
        if a > end:
            kept.append(text[at:a])
            runs_ += 1
            removed += b - a
        else:
            removed += max(0, b - end)
        end = max(end, b)
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs_


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row.

    Null texts count as empty. ``kept`` is what is left, as bytes, and null where
    nothing is removed. Equal texts are told apart by 128 bits of hashes. Rows
    that repeat an id or a text each count as a place of their own; other columns
    of ``docs``, whatever their names, are not read. A long text is cut into
    pieces of 8 MB, and one that repeats itself into runs of MOST_STARTS starts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "key", "check"))  # where to find a run's text again; never null
    spans = repeated_spans(rows).withColumnsRenamed({"key": "_key", "check": "_check"})

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            n_removed, n_spans, digests, kept = [], [], [], []
            for i, found in enumerate(batch.column(3)):
                whole = data[offsets[i] : offsets[i + 1]].tobytes()
                left, removed, runs_ = cut_out(whole, [(s["a"], s["b"]) for s in found.as_py() or ()])
                n_removed.append(removed)
                n_spans.append(runs_)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if removed else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = rows.join(spans.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check")), "left")
    return both.select("doc_id", "n_bytes", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def strip_documents(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
