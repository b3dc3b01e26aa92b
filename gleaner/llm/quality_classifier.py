"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Features are indicators of byte trigrams of the text and of pairs of neighbouring word shapes (case, marks, length, same
word again), hashed to DIM places. The log-count ratios come from the training rows, the weights from dual coordinate
descent on a bounded sample of them: SAMPLE rows at most, those of smallest hash of doc_id, which is a documented bound of
the fit alone. Every row is scored whole, from its text alone.

Defined results: a null text is scored as empty; rows without a label or with a null label are scored like others and never
learnt from; if labels of only one class are there, all scores are 0.5; repeated rows score alike; of a labelled doc_id that
stands for several texts one is learnt from, that whose features are least as bytes; labels of doc_ids that no document has
are not used; an empty table gives no rows; other columns, whatever their names, are passed on by accepted() and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANK, MUL, chunks, fresh, mixed, numbered, own_columns, sliced, spans, text_bytes, word_hashes

BITS = 18
DIM = 1 << BITS
SAMPLE = 3000
FOLDS, HELD = 3, 1


def held_out(doc_id="doc_id"):
    """Rows that no label is learnt from: crc32 of doc_id as text leaves HELD on division by FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each indicator that is set, sorted and distinct, for texts laid end to end."""
    rows = len(at) - 1
    of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    b = buf.astype(np.uint64)
    if len(b) >= 3:
        gram = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        inner = of[:-2] == of[2:]
        gram, gram_of = gram[inner], of[:-2][inner]
    else:
        gram, gram_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends, row = spans(buf, at, BLANK)
    upper = ((buf >= 0x41) & (buf <= 0x5A)).astype(np.int32)
    letter = upper.astype(bool) | ((buf >= 0x61) & (buf <= 0x7A)) | (buf >= 0x80)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    ups, letters = total(upper), total(letter)
    size = ends - starts
    n_up, n_letter = ups[ends] - ups[starts], letters[ends] - letters[starts]
    shape = np.minimum(size, 15) * 27 + np.minimum(n_up, 2) * 9 + np.minimum(size - n_letter, 2) * 3
    if len(starts) > 1:
        codes = word_hashes(buf, starts, ends)
        near = row[1:] == row[:-1]
        same = (codes[1:] == codes[:-1]).astype(np.int64)
        pair = ((shape[:-1] * 432 + shape[1:]) * 2 + same + (1 << 40))[near].astype(np.uint64)
        pair_of = row[:-1][near]
    else:
        pair, pair_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = mixed(np.concatenate([gram, pair]) * MUL) >> np.uint64(64 - BITS)
    both = np.unique((np.concatenate([gram_of, pair_of]) << BITS) | code.astype(np.int64))
    return both >> BITS, both & (DIM - 1)


def feature_lists(column: pa.Array) -> list[np.ndarray]:
    """The features of each text."""
    buf, at = text_bytes(column)
    out = []
    for i, j in chunks(at):
        row, feature = features(buf[at[i] : at[j]], at[i : j + 1] - at[i])
        out += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
    return out


def fit(own: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """(weights with the ratios multiplied in, bias, slope and offset of the score) by dual coordinate descent."""
    labels = np.asarray(labels)
    y = np.where(labels == 1, 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        return np.zeros(DIM), 0.0, 0.0, 0.0
    row, feature = np.repeat(np.arange(len(y)), [len(f) for f in own]), np.concatenate(own)
    good = y[row] > 0
    p = 1.0 + np.bincount(feature[good], minlength=DIM)
    q = 1.0 + np.bincount(feature[~good], minlength=DIM)
    seen = p + q > 2
    ratio = np.where(seen, np.log(p / ((y > 0).sum() + 2)) - np.log(q / ((y < 0).sum() + 2)), 0.0)
    scale = np.array([1 / np.sqrt(max(1, len(f))) for f in own])  # so that long texts don't outweigh short ones
    norm = np.array([scale[i] ** 2 * (ratio[f] ** 2).sum() + 1 for i, f in enumerate(own)])
    w, bias, alpha, rng = np.zeros(DIM), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    most = np.where(y > 0, cost, cost * (y > 0).sum() / (y < 0).sum())
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            f = own[i]
            gradient = y[i] * (scale[i] * (w[f] * ratio[f]).sum() + bias) - 1
            before = alpha[i]
            alpha[i] = min(max(before - gradient / norm[i], 0.0), most[i])
            if (step := (alpha[i] - before) * y[i]) != 0:
                w[f] += step * scale[i] * ratio[f]
                bias += step
    return w * ratio, bias, 3.0, 0.0


def margins(model, column: pa.Array) -> np.ndarray:
    weights, bias, slope, offset = model
    buf, at = text_bytes(column)
    out = np.full(len(at) - 1, bias)
    for i, j in chunks(at):
        r, f = features(buf[at[i] : at[j]], at[i : j + 1] - at[i])
        n = np.bincount(r, minlength=j - i)
        out[i:j] += np.bincount(r, weights=weights[f], minlength=j - i) / np.sqrt(np.maximum(n, 1))
    return slope * out + offset


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    """A model of the label, from at most sample labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__y")).where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    order = F.xxhash64(F.lit(11), "__id")
    # The ids first, so that only the sample's texts move.
    there = docs.select(F.col("doc_id").alias("__id")).where(~held_out("__id")).distinct()
    ids = known.where(~held_out("__id")).groupBy("__id").agg(F.max("__y").alias("__y")).join(there, "__id", "left_semi").orderBy(order, "__id").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", F.col("__y").cast("int").alias("y"))

    def run(batches):
        for batch in sliced(batches):
            found = [f.tobytes() for f in feature_lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "features"])

    id_type = dict(got.dtypes)["doc_id"]
    # One row for each doc_id, so that no more than the sample reaches the driver however often a doc_id stands.
    one = got.mapInArrow(run, f"doc_id {id_type}, y int, features binary").groupBy("doc_id", "y").agg(F.min("features").alias("features"))
    rows = sorted((r[0], r[1], bytes(r[2])) for r in one.collect())
    return fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64))


def scored(docs: DataFrame, model) -> DataFrame:
    """All columns of the documents, and a last one, the score: the estimate that the label is 1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(x.astype(np.float32) if isinstance(x, np.ndarray) else x for x in model))
    at = docs.columns.index("text")
    out = numbered(docs, F.lit(0.0))

    def run(batches):
        for batch in sliced(batches):
            margin = margins(shared.value, batch.column(at))
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield batch.set_column(batch.num_columns - 1, batch.schema.field(batch.num_columns - 1), pa.array(score))

    return out.mapInArrow(run, out.schema).toDF(*docs.columns, fresh(docs, "score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the query."""
    narrow = docs.select("doc_id", "text")
    out = scored(narrow, trained(narrow, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches least, with their own columns."""
    out = scored(docs, trained(docs, labels))
    return out.where(F.col(fresh(docs, "score")) >= least).select(*own_columns(docs))
