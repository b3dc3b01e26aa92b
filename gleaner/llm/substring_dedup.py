"""Substring dedup by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the least of its words, longer words coming first and equally long ones
by hash, so that minimisers are rare words rather than common ones. Consecutive windows of a text that share a minimiser
travel as one packed string, once for a chunk of texts, with the places where it stands. All places of a window have
the same minimiser and so meet in the same bin, where windows are sorted and the least doc_id of each is found exactly: equal
hashes are compared as bytes.

Bins are as many as the corpus needs at BIN bytes each. Their sizes are added up before anything moves. A bin that exceeds
its limit (a hot minimiser, or a hot passage within texts that differ) is never sent to one task: its windows travel one by
one, are counted by a grouping with partial sums and joined back, both of which Spark splits. So a task's bytes have a bound
whatever the corpus. The numbers of such bins go to all tasks, 8 bytes for each LIMIT bytes of strings at most.

Defined results: a null, empty or short text keeps its words; documents with equal doc_id don't remove each other's words
and are told apart by a 64-bit hash of their text; a null doc_id is neither smaller nor larger than any, so such rows keep
all words and remove none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import MUL, mixed, sliced, spans, stored, word_hashes

K = 13
#: Bytes of strings and places that a bin is meant for, and that it may have before its windows travel singly.
BIN, LIMIT = 12 << 20, 64 << 20
FLUSH = 4 << 20
#: Most tasks that settle bins; each task takes its bins one after the other.
PARTS = 200_000
_ODD = mixed(np.arange(101, 101 + K, dtype=np.uint64)) | np.uint64(1)


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, k: int = K):
    """First word, number of windows and minimiser of each longest run of windows that share a minimiser."""
    n = len(starts) - k + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none.astype(np.uint64)
    size = np.uint64(255) - np.minimum(ends - starts, 255).astype(np.uint64)
    least = (size << np.uint64(56)) | (word_hashes(buf, starts, ends) >> np.uint64(8))
    width = 1
    while 2 * width <= k:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[k - width : k - width + n])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    if not len(at):
        return none, none, none.astype(np.uint64)
    own = least[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[new], np.diff(np.append(new, len(at))), own[new]


def pack(strings: list[bytes], string: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> bytes:
    """Distinct strings and the places (string, doc_id, hash of the text, first word) where they stand, compressed."""
    head = np.array([len(strings), len(string)], np.int64)
    body = b"".join(x.tobytes() for x in (head, doc.astype(np.int64), string.astype(np.int32), mark.astype(np.int64), start.astype(np.int32)))
    return zstandard.ZstdCompressor(level=3).compress(body + b"\n".join(strings))


def unpack(data: bytes):
    body = zstandard.ZstdDecompressor().decompress(data)
    _, n = np.frombuffer(body, np.int64, 2)
    n, at, out = int(n), 16, []
    for kind, width in ((np.int64, 8), (np.int32, 4), (np.int64, 8), (np.int32, 4)):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * width
    doc, string, mark, start = out
    return body[at:].split(b"\n"), string.astype(np.int64), doc, mark, start.astype(np.int64)


def strings_of(lines: list[bytes], bins: int):
    """Of texts given as words with single spaces: their bytes, and of each string its bin, ends, text, first word and windows."""
    at = np.cumsum([0] + [len(x) + 1 for x in lines])
    whole = b" ".join(lines) + b" "
    buf = np.frombuffer(whole, np.uint8)
    starts, ends, row = spans(buf, at)
    first, count, least = runs(buf, starts, ends, row)
    if not len(first):
        return None
    begin = np.searchsorted(row, row[first])  # the first word of each text
    to = (mixed(least * MUL) % np.uint64(bins)).astype(np.int64)
    return whole, buf, starts, ends, to, starts[first], ends[first + count + K - 2], row[first], first, first - begin, count


def packs(lines: list[bytes], doc: np.ndarray, mark: np.ndarray, bins: int, hot: np.ndarray):
    """(bin, pack) for each bin, hot ones aside, that has strings of these texts."""
    if (got := strings_of(lines, bins)) is None:
        return
    whole, _, _, _, to, a, b, r, _, word, _ = got
    a, b, order = a.tolist(), b.tolist(), np.argsort(to, kind="stable")
    order = order[~np.isin(to[order], hot)]
    cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]])[: len(order)]).tolist() + [len(order)]
    for i, j in zip(cuts, cuts[1:]):
        mine = order[i:j]
        known: dict[bytes, int] = {}
        string = np.array([known.setdefault(whole[a[x] : b[x]], len(known)) for x in mine.tolist()])
        yield int(to[mine[0]]), pack(list(known), string, doc[r[mine]], mark[r[mine]], word[mine])


def sizes(lines: list[bytes], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins that have strings of these texts, and their bytes: each distinct string once, and 24 for each place."""
    if (got := strings_of(lines, bins)) is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, buf, _, _, to, a, b, *_ = got
    _, one = np.unique(word_hashes(buf, a, b), return_index=True)
    own, place = np.unique(to, return_inverse=True)
    size = 24 * np.bincount(place) + np.bincount(place[one], weights=(b - a + 1)[one], minlength=len(own)).astype(np.int64)
    return own, size


def single_windows(lines: list[bytes], doc: np.ndarray, mark: np.ndarray, bins: int, hot: np.ndarray):
    """(window, doc_id, hash of the text, first word) columns of all windows of hot bins."""
    if (got := strings_of(lines, bins)) is None:
        return
    whole, _, starts, ends, to, _, _, r, first, word, count = got
    mine = np.flatnonzero(np.isin(to, hot))
    for i in range(0, len(mine), 1 << 12):
        part = mine[i : i + (1 << 12)]
        of = np.repeat(part, count[part])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        at = first[of] + nth
        texts = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at + K - 1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(doc[r[of]]), pa.array(mark[r[of]]), pa.array(word[of] + nth)], ["window", "doc_id", "mark", "first"])


def least_docs(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of strings whose least doc_ids are given: least doc_id anywhere; and each string's first window and number."""
    whole = b"\n".join(strings) + b"\n"
    buf = np.frombuffer(whole, np.uint8)
    at = np.cumsum([0] + [len(x) + 1 for x in strings])
    starts, ends, row = spans(buf, at)
    w, n = word_hashes(buf, starts, ends), len(starts) - K + 1
    code = np.zeros(n, np.uint64)
    for i in range(K):
        code += w[i : i + n] * _ODD[i]
    inside = np.flatnonzero(row[:n] == row[K - 1 :])
    code, of = code[inside], row[inside]
    order = np.argsort(code, kind="stable")
    s = code[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(cut, len(s)))
    found = np.repeat(np.minimum.reduceat(least[of[order]], cut), size)
    a, b = starts[inside].tolist(), ends[inside + K - 1].tolist()
    for c, m in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
        places = order[c : c + m].tolist()
        one = whole[a[places[0]] : b[places[0]]]
        if any(whole[a[p] : b[p]] != one for p in places):  # different windows of one hash
            own: dict[bytes, int] = {}
            for p in places:
                text = whole[a[p] : b[p]]
                own[text] = min(own.get(text, least[of[p]]), least[of[p]])
            found[c : c + m] = [own[whole[a[p] : b[p]]] for p in places]
    out = np.empty(len(s), np.int64)
    out[order] = found
    return out, np.searchsorted(of, np.arange(len(strings))), np.bincount(of, minlength=len(strings))


def ranges(bin_packs: list[bytes]):
    """(doc_id, hash of the text, first word, word after) of the words that the windows of a bin remove, in longest runs."""
    strings: list[bytes] = []
    parts = []
    for data in bin_packs:
        own, string, doc, mark, start = unpack(data)
        parts.append((string + len(strings), doc, mark, start))
        strings += own
    string, doc, mark, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc)
    found, first, count = least_docs(strings, least)
    some = np.minimum.reduceat(found, first)  # each string has a window
    hit = np.flatnonzero(some[string] < doc)
    n = count[string[hit]]
    of = np.repeat(hit, n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    gone = found[first[string[of]] + nth] < doc[of]
    of, word = of[gone], start[of[gone]] + nth[gone]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1] + 1)]) if len(of) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(of)) - 1 if len(of) else begin
    return doc[of[begin]], mark[of[begin]], word[begin], word[last] + K


def flushed(batches, told):
    """What told makes of texts of at least K words, FLUSH bytes or one longer text at a time: lines, doc_ids, hashes of the texts."""
    lines, doc, mark, held = [], [], [], 0
    for batch in sliced(batches):
        for d, t, c in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = t.as_py().encode().split()
            if len(words) < K:
                continue
            lines.append(b" ".join(words))
            doc.append(d.as_py())
            mark.append(c.as_py())
            held += len(lines[-1])
            if held >= FLUSH:
                yield from told(lines, np.array(doc, np.int64), np.array(mark, np.int64))
                lines, doc, mark, held = [], [], [], 0
    if lines:
        yield from told(lines, np.array(doc, np.int64), np.array(mark, np.int64))


def removed(docs: DataFrame, bin_bytes: int = BIN, limit: int = LIMIT) -> DataFrame:
    """(doc_id, mark, first, after): word ranges to remove from the text of that doc_id and hash; they may overlap."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bins = max(1, int(3 * total // bin_bytes))

    def measure(batches):
        def told(lines, doc, mark):
            own, size = sizes(lines, bins)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(size)], ["bin", "size"])

        yield from flushed(batches, told)

    large = rows.mapInArrow(measure, "bin long, size long").groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") > limit)
    hot = np.array(sorted(r[0] for r in large.select("bin").collect()), np.int64)

    def pack_all(batches):
        def told(lines, doc, mark):
            got = list(packs(lines, doc, mark, bins, hot))
            for i in range(0, len(got), 256):
                yield pa.RecordBatch.from_pydict({"bin": pa.array([g[0] for g in got[i : i + 256]], pa.int64()), "pack": pa.array([g[1] for g in got[i : i + 256]], pa.binary())})

        yield from flushed(batches, told)

    def settle(batches):
        bin_, held = None, []
        for batch in sliced(batches):
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bin_ and held:
                    yield from told(held)
                    held = []
                bin_ = b
                held.append(p.as_py())
        if held:
            yield from told(held)

    def told(held):
        found = ranges(held)
        for i in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in found], ["doc_id", "mark", "first", "after"])

    packed = rows.mapInArrow(pack_all, "bin long, pack binary").repartition(min(bins, PARTS), "bin").sortWithinPartitions("bin")
    out = stored(packed.mapInArrow(settle, "doc_id long, mark long, first long, after long"))
    if not len(hot):
        return out

    def single(batches):
        yield from flushed(batches, lambda lines, doc, mark: single_windows(lines, doc, mark, bins, hot))

    places = rows.mapInArrow(single, "window binary, doc_id long, mark long, first long")
    low = places.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    gone = places.join(low, "window").where("doc_id > least").select("doc_id", "mark", "first", (F.col("first") + K).alias("after"))
    return out.unionByName(gone)


def kept(docs: DataFrame, ranges_of: DataFrame, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words' SHA-256, or the words themselves."""
    lists = ranges_of.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("first", "after"))).alias("ranges"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    both = rows.join(lists.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "ranges")
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in sliced(batches):
            n, less, digest, texts = [], [], [], []
            for t, r in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = t.as_py().encode().split()
                n.append(len(words))
                if r:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [x["first"] for x in r], 1)
                    np.add.at(gone, [x["after"] for x in r], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                less.append(n[-1] - len(words))
                line = b" ".join(words)
                digest.append(hashlib.sha256(line).hexdigest())
                texts.append(line.decode() if text_out else "")
            last = texts if text_out else digest
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(last, pa.string())], ["doc_id", "n_words", "n_removed", "last"])

    out = both.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, last string")
    return out.withColumnRenamed("last", "text" if text_out else "kept_sha256")


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query."""
    return kept(docs, removed(docs))
