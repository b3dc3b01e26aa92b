"""Helpers that the operators share: reading, shared folders, word spans of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources import staging

#: ASCII whitespace, as the class [\x20\x09-\x0D] has it.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside a-z, 0-9 and 0x80-0xFF once A-Z are lower-cased.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A-Z only; bytes of longer UTF-8 sequences stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that a task works on at once, unless one text alone is longer.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that none of the frame's own columns has."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The frame's own columns, by names that may hold dots or backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, *more: Column) -> DataFrame:
    """The frame's columns and more of them, named c0, c1 and so on; whole rows go to Python by these, whatever their names."""
    return df.select(*own_columns(df), *more).toDF(*[f"c{i}" for i in range(len(df.columns) + len(more))])


def shared_dir(spark: SparkSession) -> str:
    """A new folder path for what is stored; see sources.staging, which says where and how it is removed."""
    return staging.new_path(spark)


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, so that a lost executor costs no lineage."""
    return staging.staged(df)


def sliced(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, as whole texts need more memory to work on than to hold. The session's settings stay as they are."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch if batch.num_rows <= most else batch.take(pa.array(np.arange(i, min(i + most, batch.num_rows))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits depend on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK):
    """Row ranges (first, last + 1) of about most bytes each; a longer text stands alone."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def spans(buf: np.ndarray, at: np.ndarray, apart: np.ndarray = BLANK):
    """Starts, ends and row of each word: a longest run of bytes of one row that apart doesn't mark."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~apart[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        power = np.full(n, base, np.uint64)
        power[:1] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


_CACHED = _powers(CHUNK)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial, for about CHUNK bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        part = buf[low : int(ends[j - 1])]
        power, back = _CACHED if len(part) <= CHUNK else _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mixed((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * MUL)
        i = j
    return out
