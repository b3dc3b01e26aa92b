"""Ranked lexical search by branch and bound over hierarchical max trees.

Each document's score for a query is a sum over the query's terms, weight times impact. Documents are dealt into shards of
consecutive ids within a task; for each term a shard has a tree over ranges of its documents, whose nodes hold the largest
impact of the term in the range. A query's bound for a range is the sum of weight times these maxima. The search keeps the
open ranges in a heap, descends those of the highest bounds (a few at a time, as they are looked up together), scores single
documents at the leaves, and ends when the best open bound is below the last of the best documents found; ranges whose bound
equals it are opened, as a document there may come first by its id. What a task has found bounds its next shard too.

Only documents' counts of the queries' terms are kept, from one pass over the texts, and stored: from these come the
documents' numbers and lengths and each term's document frequency, and then the shards. Texts are never shuffled; a task sends
on the few best documents of each query. Queries come in blocks of bounded size (decontamination.blocks_of), each block
broadcast and held against all documents.

Defined results: a null or empty text has no terms, isn't counted and is never found; a query without terms finds nothing;
repeated rows and queries count and are found as rows of their own, so an id may stand at several ranks; a null doc_id comes
last among equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, NOT_WORD, chunks, spans, stored, text_bytes
from gleaner.llm.decontamination import blocks_of

BEST = 10
#: Documents of a shard, and term counts that it holds at most (one document's alone may be more).
SHARD, HELD = 1 << 16, 1 << 22
#: Ranges below a range: 1 << FAN; ranges looked up together.
FAN, TOGETHER = 4, 32
#: Bytes of text taken at a time.
CHUNK = 4 << 20


def terms_in(buf: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of texts laid end to end, with what stands between them at odd places, and the row of each term."""
    low = LOWER[buf]
    starts, ends, row = spans(low, at, NOT_WORD)
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(low)]), row


def terms_of(text: str | None) -> list[bytes]:
    buf, at = text_bytes(pa.array([text], pa.string()))
    found, row = terms_in(buf, at)
    return found.to_pylist()[::2] if len(row) else []


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), term (places in the vocabulary, ascending) and tf of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        known = pa.array(shared.value, pa.large_binary())
        size = len(known)
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            for i, j in chunks(at, CHUNK):
                found, row = terms_in(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                rows = j - i
                n = np.bincount(row, minlength=rows)
                place = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)[::2].astype(np.int64)
                mine = place >= 0
                pair, tf = np.unique(row[mine] * size + place[mine], return_counts=True)
                edges = pa.array(np.searchsorted(pair, np.arange(rows + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (pair % max(size, 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<int>")


class Shard:
    """Documents in order of their ids, and each term's tree of largest impacts over ranges of them."""

    def __init__(self, rows: pa.Table, size: int, documents: int, length: int):
        rows = rows.take(pc.sort_indices(rows["doc_id"].combine_chunks())).combine_chunks()
        self.ids = rows["doc_id"]
        n, lists, tf = rows["n"].to_numpy(), rows["term"].combine_chunks(), rows["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy().astype(np.int64)
        if n.size and 75 * int(n.max()) * documents >= 1 << 62:
            norm = np.array([25 + 75 * int(x) * documents // length for x in n], np.int64)
        else:
            norm = 25 + 75 * n * documents // max(length, 1)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
        order = np.lexsort((doc, term))
        term, node, high = term[order], doc[order], impact[order]
        self.levels = []  # of single documents, then of ranges of growing width: keys (term, range) in order, largest impacts, ranges
        count = len(n)
        while True:
            key = term * count + node
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            high, term, node = np.maximum.reduceat(high, cut) if len(cut) else high, term[cut], node[cut]
            self.levels.append((key[cut], high, count))
            if count <= 1 << FAN:
                break
            node, count = node >> FAN, (count - 1 >> FAN) + 1

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum of weight times largest impact for each of the ranges."""
        keys, high, count = self.levels[level]
        if not len(keys):
            return np.zeros(len(nodes), np.int64)
        want = terms[:, None] * count + nodes[None, :]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return weights @ np.where(keys[at] == want, high[at], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, best: int = BEST) -> list[tuple[int, int]]:
        """(score, place) of the best documents whose score is above 0 and no less than least, the highest first."""
        top = len(self.levels) - 1
        found: list[tuple[int, int]] = []  # (score, -place): the smallest is the last of the best
        heap: list[tuple[int, int, int]] = []

        def open_(level: int, nodes: np.ndarray) -> None:
            nonlocal least
            bound = self.bounds(level, nodes, terms, weights)
            for k in np.flatnonzero((bound > 0) & (bound >= least)).tolist():
                if level:
                    heapq.heappush(heap, (-int(bound[k]), level, int(nodes[k])))
                else:
                    (heapq.heappush if len(found) < best else heapq.heappushpop)(found, (int(bound[k]), -int(nodes[k])))
            if len(found) == best:
                least = max(least, found[0][0])

        open_(top, np.arange(self.levels[top][2]))
        while heap and -heap[0][0] >= least:
            level, nodes = heap[0][1], []
            while heap and len(nodes) < TOGETHER and -heap[0][0] >= least and heap[0][1] == level:
                nodes.append(heapq.heappop(heap)[2])
            below = (np.array(nodes)[:, None] << FAN) + np.arange(1 << FAN)
            below = below[below < self.levels[level - 1][2]]
            open_(level - 1, below)
        return [(s, -p) for s, p in sorted(found, reverse=True)]


def ranked_block(docs: DataFrame, block: list[tuple], best: int) -> DataFrame:
    """(at, doc_id, score, rank): the best documents of each query of a block, which are rows (item_id, text)."""
    spark = docs.sparkSession
    asked = [terms_of(text) for _, text in block]
    vocabulary = sorted({t for q in asked for t in q})
    place = {t: i for i, t in enumerate(vocabulary)}
    counts = stored(counted(docs, vocabulary))
    documents, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # terms of one block
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    queries = []
    for q in asked:
        terms, times = np.unique(np.array([place[t] for t in q], np.int64), return_counts=True)
        own = weight[terms] > 0
        queries.append((terms[own], times[own] * weight[terms[own]]))
    shared, kind = spark.sparkContext.broadcast(queries), dict(docs.dtypes)["doc_id"]

    def run(batches):
        kept: list[list[tuple]] = [[] for _ in shared.value]  # (-score, no id, id) of each query

        def search(rows: pa.Table) -> None:
            shard = Shard(rows, len(vocabulary), documents, length)
            for mine, (terms, weights) in zip(kept, shared.value, strict=True):
                if len(terms):
                    got = shard.search(terms, weights, -mine[-1][0] if len(mine) == best else 0, best)
                    if got:
                        ids = [shard.ids[p].as_py() for _, p in got]
                        mine += [(-s, x is None, x) for (s, _), x in zip(got, ids, strict=True)]
                        mine.sort(key=lambda m: m[:2] + (m[2] if m[2] is not None else 0,))
                        del mine[best:]

        held, rows, size, doc_type = [], 0, 0, None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            step = max(1, min(SHARD, batch.num_rows))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column(2).flatten())
                if rows >= SHARD or size >= HELD:
                    search(pa.Table.from_batches(held))
                    held, rows, size = [], 0, 0
        if held:
            search(pa.Table.from_batches(held))
        out = [(i, x, -s) for i, mine in enumerate(kept) for s, _, x in mine]
        if out:
            at, ids, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids, doc_type), pa.array(score, pa.int64())], ["at", "doc_id", "score"])

    found = counts.where("size(term) > 0").mapInArrow(run, f"at int, doc_id {kind}, score long")
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of each item, equal scores by ascending doc_id."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    out = None
    for block in blocks_of(items):
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"at int, item_id {kind}")
        got = ranked_block(docs.select("doc_id", "text"), block, best).join(F.broadcast(ids), "at").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
