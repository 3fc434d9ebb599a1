"""Helpers shared by the operators: scratch tables, executor code, word spans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import materialise, ship_package  # noqa: F401  (materialise: for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also makes the package importable on the executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z and nothing else; pure ASCII texts take the fast path."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, upper, low))


# ------------------------------------------------- words of a batch of texts

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty) in one array,
    and the n + 1 offsets of its rows in it."""
    import pyarrow as pa
    import pyarrow.compute as pc
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def by_bytes(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges (lo, hi) of rows that hold about ``limit`` bytes, at least a row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def ranges(arrays: list, most: int):
    """A slice of each of some sorted arrays of integers, again and again, until all is covered: the
    values between two bounds, about ``most`` in all if they lie evenly. Equal ones come together."""
    met = [x for x in arrays if len(x)]
    if not met:
        return
    least, last = min(int(x[0]) for x in met), max(int(x[-1]) for x in met)
    n = -(-sum(map(len, met)) // most)
    edges = np.array([least + (last - least) * i // n for i in range(1, n)], met[0].dtype)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in arrays]
    for k in range(n):
        yield [slice(c[k], c[k + 1]) for c in cuts]


def word_spans(raw: np.ndarray, offsets: np.ndarray):
    """Starts and ends (byte positions) of the words ``[^\\x20\\x09-\\x0D]+`` of
    every row, and the n + 1 offsets of the rows among the words.

    A word never crosses a row: rows are parted by a virtual space.
    """
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)      # a row begins here
    first[offsets] = True
    before = np.empty(n, dtype=bool)         # the byte before is a word byte of this row
    before[0] = False
    before[1:] = word[:-1]
    before &= ~first[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~first[1:n + 1]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
