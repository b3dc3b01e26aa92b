"""Cost-balanced packing of tokenized documents into training sequences.

A piece of n tokens costs n + n * n / QUADRATIC: work on each token, and attention of all to all within the piece. Pieces go,
the costliest first, to the sequence of the lowest cost that has room for them; one that fits nowhere is cut, its beginning
fills the cheapest sequence with any room, and the rest of it waits for its turn by its own cost. As many sequences are open
as the tokens at hand fill, so each ends full.

A task packs its own documents as they come, some GROUP tokens at a time, and nothing is shuffled: what a group leaves (less
than a sequence) joins the next one. What tasks leave at their end, less than a sequence each, is stored with the rest,
gathered into groups of the same size and packed once more; the last tokens of such a group, less than a sequence too, fill
sequences whose lengths are powers of two. So no sequence is padded.

Tokenizing: before a text is encoded it is cut at single blanks between two characters that aren't blanks, and between letters
and marks, where the tokenizer's own pattern always begins a new token; so words that a batch holds often are encoded once, and
the ids are those of the whole text. A stretch without such a place is encoded as a whole.

Defined results: a null text counts as an empty one, which is the end token alone; rows that stand more than once are
documents of their own, as are those without a doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, stored, text_bytes

#: Tokens of a sequence; the end token; the length at which attention costs as much as all else; tokens packed at a time.
LENGTH = 2048
END = 1
QUADRATIC = 12_288
GROUP = 1 << 21
#: Bytes of text encoded at a time, and how many of its words are encoded as one text.
CHUNK = 16 << 20
LINES = 512


def cost(tokens):
    """What a piece costs: linear in its tokens, and quadratic for the attention among them."""
    return tokens + tokens * tokens / QUADRATIC


def cuts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of the units that can be encoded apart: rows, cut before single blanks between two characters that are none, and
    before marks after letters a-z.

    Characters whose first byte is C2, E1, E2 or E3 may be blanks of Unicode, so they don't count as others.
    """
    if len(buf) < 3:
        return np.unique(at)
    blank = (buf == 0x20) | (buf == 0x0A) | (buf == 0x09) | (buf == 0x0D)
    plain = (buf > 0x20) & (buf < 0x7F)
    two, tail = (buf >= 0xC3) & (buf < 0xE0), (buf & 0xC0) == 0x80
    three = (buf == 0xE0) | ((buf >= 0xE4) & (buf < 0xF0))
    begins = plain | two | three | (buf >= 0xF0)
    ends = plain.copy()
    ends[1:] |= tail[1:] & two[:-1]
    ends[2:] |= tail[2:] & tail[1:-1] & three[:-2]
    letter = ((buf | 0x20) >= 0x61) & ((buf | 0x20) <= 0x7A)
    mark = plain & ~letter & ~((buf >= 0x30) & (buf <= 0x39))
    edge = np.zeros(len(buf) + 1, bool)
    edge[1 : len(buf) - 1] = blank[1:-1] & ends[:-2] & begins[2:]
    edge[1 : len(buf)] |= letter[:-1] & mark[1:]
    edge[at] = True
    return np.flatnonzero(edge)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, n[0] of them, then those of first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """Ids of texts by a tokenizer's file, whose special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.breaks = self.of.encode("\n", add_special_tokens=False).ids

    def encoded(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and how many each has.

        Words with one space before them at most are encoded many at a time, a line each: a line break between them is a
        token of its own, which no word holds.
        """
        buf, at = text_bytes(units)
        first = at[:-1]
        odd = (buf <= 0x20) | (buf == 0x7F) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))
        odd[first] &= buf[first] != 0x20
        plain = ~np.logical_or.reduceat(odd, first) if len(self.breaks) == 1 else np.zeros(len(units), bool)
        words, rest = (units.filter(pa.array(m)).to_pylist() for m in (plain, ~plain))
        lines = [b"\n".join([*words[i : i + LINES], b""]).decode(errors="replace") for i in range(0, len(words), LINES)]
        flat = np.fromiter(chain.from_iterable(x.ids for x in self.of.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(flat == self.breaks[0])
        alone = [x.ids for x in self.of.encode_batch_fast([u.decode(errors="replace") for u in rest], add_special_tokens=False)]
        size, ids = np.empty(len(units), np.int64), np.delete(flat, ends)
        size[plain], size[~plain] = np.diff(ends, prepend=-1) - 1, [len(x) for x in alone]
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        for mask, own in ((plain, ids), (~plain, np.fromiter(chain.from_iterable(alone), np.uint32))):
            out[spread(begin[mask], size[mask])] = own
        return out, size

    def ids(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts laid end to end, each with the end token, and the offsets of the texts among them."""
        rows = len(at) - 1
        edges = cuts(buf, at)
        if len(edges) < 2:
            return np.full(rows, END, np.uint32), np.arange(rows + 1)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(buf)]).dictionary_encode()
        of, (flat, size) = units.indices.to_numpy(), self.encoded(units.dictionary)
        n = size[of]
        before = np.concatenate([[0], np.cumsum(n)])
        own = before[np.searchsorted(edges, at)]
        out = np.full(int(before[-1]) + rows, END, np.uint32)
        kept = np.ones(len(out), bool)
        kept[own[1:] + np.arange(rows)] = False
        out[kept] = flat[spread((np.cumsum(size) - size)[of], n)]
        return out, own + np.arange(rows + 1)


class Packer:
    """Pieces that wait, and how those at hand are dealt out to sequences."""

    def __init__(self, length: int = LENGTH):
        self.length, self.tokens, self.sequences = length, 0, 0
        self.waiting: list[tuple] = []  # (doc_id, start, tokens of the document, ids)

    def add(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, start, total, ids))
        self.tokens += len(ids)

    def full(self) -> Iterator[tuple]:
        """Fills as many sequences as the tokens that wait can fill; what fits in none goes on waiting."""
        yield from self._dealt([self.length] * (self.tokens // self.length))

    def last(self) -> Iterator[tuple]:
        """Packs all that waits: full sequences, then others whose lengths are powers of two."""
        yield from self.full()
        yield from self._dealt([1 << b for b in reversed(range(self.tokens.bit_length())) if self.tokens >> b & 1])

    def _dealt(self, rooms: list[int]) -> Iterator[tuple]:
        room, costs, used = np.array(rooms, np.int64), np.zeros(len(rooms)), np.zeros(len(rooms), np.int64)
        queue = [(-len(p[3]), i, p) for i, p in enumerate(self.waiting)]
        heapq.heapify(queue)
        first, order = self.sequences, len(queue)
        self.sequences += len(rooms)
        open_ = int(room.sum())
        while open_ and queue:
            doc_id, start, total, ids = heapq.heappop(queue)[2]
            fits = room >= len(ids)
            if not fits.any():
                fits = room > 0
            j = int(np.argmin(np.where(fits, costs, np.inf)))
            n = min(len(ids), int(room[j]))
            yield doc_id, start, total, ids[:n], first + j, int(used[j])
            room[j] -= n
            used[j] += n
            costs[j] += cost(n)
            open_ -= n
            self.tokens -= n
            if n < len(ids):
                heapq.heappush(queue, (n - len(ids), order, (doc_id, start + n, total, ids[n:])))
                order += 1
        self.waiting = [(*p[:3], p[3].copy()) for _, _, p in sorted(queue, key=lambda q: q[:2])]  # copied, so that the rest of their batch can go


def _told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (doc_id, start, tokens of the document, ids, sequence or None, offset) as a batch."""
    doc, start, total, ids, sequence, offset = zip(*rows, strict=True)
    columns = (doc, start, [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], total, sequence, offset)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    tokenizer is the path of the tokenizer's file, which every executor must have.
    """
    kind = dict(docs.dtypes)["doc_id"]
    spec = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def out(doc_type: pa.DataType, pieces: Iterator[tuple], stage: int) -> Iterator[pa.RecordBatch]:
        schema, mark = pa.schema([("doc_id", doc_type), *fields]), (2 * TaskContext.get().partitionId() + stage) << 32
        held, tokens = [], 0
        for doc_id, start, total, ids, sequence, offset in pieces:
            held.append((doc_id, start, total, ids, None if sequence is None else mark + sequence, offset))
            tokens += len(ids)
            if tokens >= group:
                yield _told(held, schema)
                held, tokens = [], 0
        if held:
            yield _told(held, schema)

    def first(batches):
        encoder, packer, doc_type = Encoder(tokenizer), Packer(length), pa.null()

        def pieces(batch):
            buf, at = text_bytes(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for i, j in chunks(at, CHUNK):
                ids, own = encoder.ids(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                for k in range(j - i):
                    mine = ids[own[k] : own[k + 1]]
                    for start in range(0, len(mine), length):
                        packer.add(ids_of[i + k], start, len(mine), mine[start : start + length])
                    if packer.tokens >= group:
                        yield from packer.full()

        for batch in batches:
            doc_type = batch.schema.field(0).type
            yield from out(doc_type, pieces(batch), 0)
        yield from out(doc_type, packer.full(), 0)
        yield from out(doc_type, ((*p, None, None) for p in packer.waiting), 0)

    def again(batches):
        packer, doc_type = Packer(length), pa.null()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc_id, start, total, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 3)), strict=True):
                packer.add(doc_id, start, total, np.frombuffer(ids, "<u4"))
        yield from out(doc_type, packer.last(), 1)

    laid = stored(docs.select("doc_id", "text").mapInArrow(first, spec))
    rest = laid.where("sequence_id is null")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    return laid.where("sequence_id is not null").unionByName(rest.repartition(int(tokens // group) + 1).mapInArrow(again, spec))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest of the query: each piece with the checksum of its ids."""
    return packed(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
