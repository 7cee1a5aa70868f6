"""Pieces shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where
    that is unset: a temporary one on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'the cluster'} share")
        found = "file://" + tempfile.mkdtemp(prefix="spanmoor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, survives lost executors, and gives later joins a true size. The
    files go when the driver ends, as results read them until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanmoor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if hasattr(spark, "_jvm"):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it;
    Spark does not tell upper from lower case there."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised words and shingles over Arrow string buffers -----------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown on demand."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _POW[:n], _INV[:n]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets); null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that numpy works on at once: few enough to stay in a core's
#: cache, and a worker's memory far below its texts'.
SLICE = 1 << 18


def slices(offsets: np.ndarray, most: int):
    """Ranges of whole texts with about ``most`` bytes each; a longer text is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lowered words of the texts, and each word's text number."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1] | begins[1:n]
    end = word.copy()
    end[:-1] &= space[1:] | begins[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * power, out=total[1:])
    hashed = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _MUL)
    return hashed, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words within a text, and their text numbers;
    a text with 1 to k-1 words gives its whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    short = count < k
    out, of = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = mix64(h + words[i : n - k + 1 + i] + _MUL)
        whole = text[: n - k + 1] == text[k - 1 :]
        out.append(h[whole])
        of.append(text[: n - k + 1][whole])
    for f, c in zip(first[short], count[short]):
        h = np.full(1, c, np.uint64)
        for i in range(c):
            h = mix64(h + words[f + i : f + i + 1] + _MUL)
        out.append(h)
        of.append(text[f : f + 1])
    out, of = np.concatenate(out), np.concatenate(of)
    if short.any():
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
