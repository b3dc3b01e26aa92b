"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items of up to FEW shingles are candidates for each document that has one of their shingles, found by its code: no chance
is left there. Larger items are partitioned by size: class c holds those of up to 2**c shingles. For a class, a document is cut into windows of
two blocks of 2**c shingles, each window overlapping the next by a block; so a short passage is at least a fair part of some
window however long the document is, and the containment bound becomes a bound on Jaccard similarity that doesn't fade with
the document's length. Windows and items have BANDS MinHash values, and a window is a candidate for each item with which
it shares one. A larger item of which a share t lies in a document, in one piece or in many, is missed with probability of about
exp(-BANDS * t / 3) at most; for t of 0.8 that is 4e-8. A block's MinHash values serve both windows that it is in, and
those of a class are minima of neighbours in the class below.

Candidates are verified in the same task on the texts of the shingles, whole document against whole item. Documents are
never shuffled. The items are the query set: they come in blocks of at most ITEM_BYTES of text (one longer item alone),
each block broadcast and held against all documents.

Shingles are SHINGLE words; words are runs of letters and digits with A-Z lower-cased, so case and punctuation don't hide
a passage. An item of fewer words is one shingle of all its words, found where a document has them in this order.

Defined results: null and empty texts have no words and never match, nor do items without words; repeated rows and items
match alike; a null doc_id or item_id is carried on; an empty table gives no rows; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import LOWER, NOT_WORD, chunks, fresh, mixed, numbered, own_columns, sliced, spans, text_bytes, word_hashes

SHINGLE = 5
LEAST = 0.8
BANDS = 64
#: Items of up to FEW shingles are looked up by the codes of these, larger ones by MinHash from class SMALLEST on.
FEW = 16
SMALLEST = 4
ITEM_BYTES = 4 << 20
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_WORDS = bytes(0x20 if NOT_WORD[i] else int(LOWER[i]) for i in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode().translate(_WORDS).split(b" ") if w]


def shingles(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of a text; one of all words if these are fewer than k."""
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingle_codes(buf: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code and the row of each shingle of k words, in order."""
    buf = LOWER[buf]
    starts, ends, row = spans(buf, at, NOT_WORD)
    if len(starts) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hashes(buf, starts, ends)
    n = len(w) - k + 1
    code = np.zeros(n, np.uint64)
    for i in range(k):
        code += w[i : i + n] * _ODD[i]
    whole = row[:n] == row[k - 1 :]
    return mixed(code)[whole], row[:n][whole]


def minima(code: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(BANDS x blocks MinHash values, row of each block) for blocks of width shingles of one row; the last may be shorter."""
    first = np.searchsorted(row, row)  # where the row of each shingle begins
    cut = np.flatnonzero((np.arange(len(row)) - first) % width == 0)
    out = np.empty((BANDS, len(cut)), np.uint64)
    for i in range(BANDS):
        out[i] = np.minimum.reduceat(code * _ODD[i], cut)
    return out, row[cut]


def paired(low: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of twice the width: each row's first and second block, third and fourth, and so on."""
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    cut = np.flatnonzero(nth % 2 == 0)
    return np.minimum.reduceat(low, cut, axis=1), of[cut]


def windows(low: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two neighbouring blocks, one beginning at each block."""
    out = low.copy()
    near = np.flatnonzero(of[1:] == of[:-1])
    out[:, near] = np.minimum(low[:, near], low[:, near + 1])
    return out, of


class Items:
    """A block of benchmark items: their exact shingles, and MinHash values by size class."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.ids = [r[0] for r in rows]
        words = [normal_words(r[1]) for r in rows]
        self.short = {i: w for i, w in enumerate(words) if 0 < len(w) < SHINGLE}
        self.shingles = [shingles(w) for w in words]
        by_class: dict[int, list[int]] = {}
        few = [i for i, s in enumerate(self.shingles) if 0 < len(s) <= FEW and i not in self.short]
        code, row = shingle_codes(*text_bytes(pa.array([b" ".join(words[i]).decode() for i in few], pa.string())))
        order = np.argsort(code, kind="stable")
        self.few = code[order], np.array(few, np.int64)[row[order]]
        for i, s in enumerate(self.shingles):
            if len(s) > FEW:
                by_class.setdefault(max(SMALLEST, (len(s) - 1).bit_length()), []).append(i)
        self.classes = {}
        for c, members in by_class.items():
            buf, at = text_bytes(pa.array([b" ".join(words[i]).decode() for i in members], pa.string()))
            code, row = shingle_codes(buf, at)
            bands = []
            for j in range(BANDS):
                low = np.full(len(members), np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(low, row, code * _ODD[j])
                order = np.argsort(low, kind="stable")
                bands.append((low[order], np.array(members)[order]))
            self.classes[c] = bands

    def candidates(self, code: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a shingle, of a small item, or a MinHash value in a window."""
        found: set[tuple[int, int]] = set()
        values, members = self.few
        if len(code) and len(values):
            first, last = np.searchsorted(values, code), np.searchsorted(values, code, "right")
            for h in np.flatnonzero(last > first):
                found.update((int(row[h]), int(m)) for m in members[first[h] : last[h]])
        if not len(code) or not self.classes:
            return found
        low, of = minima(code, row, 1 << SMALLEST)
        for c in range(SMALLEST, max(self.classes) + 1):
            if c > SMALLEST:
                low, of = paired(low, of)
            if c not in self.classes:
                continue
            both, _ = windows(low, of)
            for j, (values, members) in enumerate(self.classes[c]):
                first = np.searchsorted(values, both[j])
                hit = np.flatnonzero(values[np.minimum(first, len(values) - 1)] == both[j])
                for h in hit:
                    k = first[h]
                    while k < len(values) and values[k] == both[j][h]:
                        found.add((int(of[h]), int(members[k])))
                        k += 1
        return found

    def leaks(self, column: pa.Array, least: float) -> list[list[tuple[int, float]]]:
        """For each text, the items of which it contains at least that share of the shingles."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(column))]
        buf, at = text_bytes(column)
        for i, j in chunks(at):
            part = buf[at[i] : at[j]]
            code, row = shingle_codes(part, at[i : j + 1] - at[i])
            pairs = self.candidates(code, row)
            words: dict[int, list[bytes]] = {}
            own: dict[int, set[bytes]] = {}
            for r in {r for r, _ in pairs}:
                words[r] = normal_words(column[i + r].as_py())
                own[r] = shingles(words[r])
            for r, item in sorted(pairs):
                share = len(self.shingles[item] & own[r]) / len(self.shingles[item])
                if share >= least:
                    out[i + r].append((item, share))
            if self.short:
                for r in range(j - i):
                    line = b" " + b" ".join(words.get(r) or normal_words(column[i + r].as_py())) + b" "
                    out[i + r] += [(item, 1.0) for item, w in self.short.items() if b" " + b" ".join(w) + b" " in line]
        return out


def blocks_of(items: DataFrame):
    """The items in blocks that the driver can hold, each as rows (item_id, text)."""
    rows = items.select("item_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    total = rows.agg(F.sum("b")).first()[0] or 0
    n = int(total // ITEM_BYTES) + 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        if got := rows.where(of == k).select("item_id", "text").collect():
            yield [tuple(r) for r in got]


def annotated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """All columns of the documents, and a last one: array of (item_id, containment)."""
    spark = docs.sparkSession
    item = T.ArrayType(T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("containment", T.DoubleType())]))
    empty = F.array().cast(item)
    out = numbered(docs, empty)
    at = docs.columns.index("text")
    for block in blocks_of(items):
        shared = spark.sparkContext.broadcast(block)
        schema = out.schema

        def run(batches, shared=shared):
            own = Items(shared.value)
            for batch in sliced(batches):
                column = batch.column(at)
                kind = batch.schema.field(batch.num_columns - 1)
                before = batch.column(batch.num_columns - 1).to_pylist()
                more = own.leaks(column, least)
                merged = [(b or []) + [{"item_id": own.ids[i], "containment": c} for i, c in m] for b, m in zip(before, more, strict=True)]
                yield batch.set_column(batch.num_columns - 1, kind, pa.array(merged, kind.type))

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns, fresh(docs, "leaks"))


def pairs(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The digest of the query: each document and item of which it contains at least that share."""
    narrow = docs.select("doc_id", "text")
    found = annotated(narrow, items, least).select("doc_id", F.explode(fresh(narrow, "leaks")).alias("x"))
    return found.select("doc_id", F.col("x.item_id").alias("item_id"), F.round("x.containment", 9).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents in which no item was found, with their own columns."""
    return annotated(docs, items, least).where(F.size(fresh(docs, "leaks")) == 0).select(*own_columns(docs))
