"""Language-model scores by prediction by partial matching over bytes, and by smoothed word counts.

The model is a trie of byte contexts up to ORDER bytes. Counts of all (ORDER + 1)-grams of the training texts are summed
by Spark; those of shorter contexts are their marginal sums, each in a table of its own. A text's code length is added up
byte by byte: a byte seen in the longest context costs its share there; otherwise an escape is paid, with the probability
(d + r) / (t + d + r) of d kinds of bytes seen t times in all and r times of rarer ones (method C), and the next shorter context is asked, in which all bytes
that the longer one has seen are excluded. Below the empty context all bytes left over are alike.

Nothing is pruned: a gram's code length follows from the gram alone, so it is worked out once for each distinct gram, by
windows and joins over the stored level tables, and a text's score is the sum over its grams. The grams that stand most
often, KEPT at most, are broadcast with their code lengths as a fast path that no result depends on; all others meet
theirs in a join, summed up by text beforehand. Those are chosen by all texts, so that no gram left over is a hot key.

A text is read as its UTF-8 bytes, A-Z lower-cased, between two marks of the byte 255, which UTF-8 never has; the second is
coded too, so the probabilities of all lower-cased texts sum to one at most. Words are of the same lower-cased bytes.

Word counts have no such bound. Words of at least a WORD_SHARE of all tokens (at most 1 / WORD_SHARE words) are broadcast;
all others meet their counts in a join, where none of them is a hot key.

Defined results: a null text counts as empty: one token, the end; a null doc_id counts as training; with no training rows
N and V are 0, all tokens have the same probability, and so have all bytes; repeated rows are learnt from and scored each by
itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import MUL, sliced, stored

ORDER = 5
#: Most grams that are broadcast.
KEPT = 500_000
WORD_SHARE = 5e-6
MARK = 255
FOLDS, HELD = 5, 1
#: The token that ends a text; no word is empty.
END = ""
CHUNK = 1 << 20


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def lowered(text: str | None) -> bytes:
    """A text's UTF-8 bytes, A-Z lower-cased and nothing else."""
    return (text or "").encode().lower()


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each coded byte, as a number, and the text of each."""
    mark = bytes([MARK])
    whole = np.frombuffer(b"".join(mark * order + t + mark for t in texts), np.uint8)
    n = np.array([len(t) + order + 1 for t in texts], np.int64)
    code = np.zeros(len(whole) - order, np.int64)
    for i in range(order + 1):
        code = (code << 8) | whole[i : len(whole) - order + i]
    # the gram that begins at place i of a text ends at its coded byte i; grams across texts go
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(texts)), n)[: len(code)]
    inside = np.arange(len(code)) - begin[of] < n[of] - order
    return code[inside], of[inside]


def gram_sums(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of what each task has read, added up before anything moves; a gram has several rows."""

    def run(batches):
        keys, sums, parts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0

        def merged():
            both, place = np.unique(np.concatenate([keys, *(p[0] for p in parts)]), return_inverse=True)
            return both, np.bincount(place, weights=np.concatenate([sums, *(p[1] for p in parts)])).astype(np.int64)

        def told():
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(sums[i : i + (1 << 16)])], ["gram", "n"])

        for batch in sliced(batches):
            for t in batch.column(0):
                held.append(lowered(t.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    parts.append(np.unique(grams(held, order)[0], return_counts=True))
                    held, size = [], 0
                if len(parts) == 8:
                    keys, sums = merged()
                    parts = []
                    if len(keys) > 2_000_000:
                        yield from told()
                        keys, sums = keys[:0], sums[:0]
        if held:
            parts.append(np.unique(grams(held, order)[0], return_counts=True))
        if parts:
            keys, sums = merged()
        yield from told()

    return docs.select("text").mapInArrow(run, "gram long, n long")


class Table:
    """Keys (int64) to values in a hash table of arrays, looked up many at a time."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys = np.full((1 << self.bits) + 1, -1, np.int64)
        self.values = {n: np.zeros((1 << self.bits) + 1, v.dtype) for n, v in values.items()}
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self.slots(keys[left], step)
            free = self.keys[slot] == -1
            taker = np.full(1 << self.bits, -1)
            taker[slot[free]] = left[free]
            placed = free & (taker[slot] == left)
            self.keys[slot[placed]] = keys[left[placed]]
            for n, v in values.items():
                self.values[n][slot[placed]] = v[left[placed]]
            left, step = left[~placed], step + 1

    def slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        home = (keys.astype(np.uint64) * MUL) >> np.uint64(64 - self.bits)
        return ((home + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the last slot, of no key and values zero, where it is not there."""
        out = np.full(len(keys), 1 << self.bits)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self.slots(keys[left], step)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = slot[hit]
            left, step = left[~hit & (there != -1)], step + 1
        return out


class Trie:
    """The model from levels of (grams, counts): levels[k] has the grams of k context bytes and one more."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.nodes = [], []
        for k, (gram, n) in enumerate(levels):
            context = gram >> 8
            node, place = np.unique(context, return_inverse=True)
            total = np.bincount(place, weights=n, minlength=len(node)) if len(node) else np.zeros(0)
            kinds = np.bincount(place, minlength=len(node)).astype(float) if len(node) else np.zeros(0)
            # what the bytes seen here have in the next shorter context, where they are excluded after an escape
            if k and len(node):
                below = self.grams[k - 1]
                share = below.values["n"][below.find(gram & ((1 << 8 * k) - 1))]
                excluded = np.bincount(place, weights=share, minlength=len(node))
            else:
                excluded = np.zeros(len(node))
            self.grams.append(Table(gram, n=n.astype(float)))
            # how often the context stands less what its nodes hold: mass of rare bytes, which only an escape can reach
            stands = below.values["n"][below.find(node)] if k and len(node) else total
            self.nodes.append(Table(node, t=total, d=kinds, x=excluded, e=np.maximum(stands - total, 0)))

        node = self.nodes[-1].find(self.grams[-1].keys >> 8)
        v, n = self.nodes[-1].values, self.grams[-1].values["n"]
        self.top = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(v["t"][node] + v["d"][node] + v["e"][node], 1)), 0.0)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        slot = self.grams[-1].find(gram)
        out = self.top[slot]  # most bytes are seen in the longest context
        left = np.flatnonzero(out == 0)
        left = left[self.grams[-1].values["n"][slot[left]] == 0]
        gone_t, gone_d = np.zeros(len(left)), np.zeros(len(left))  # excluded counts and kinds
        for k in range(self.order, -1, -1):
            if not len(left):
                return out
            code = gram[left] & ((1 << 8 * (k + 1)) - 1)
            node = self.nodes[k].find(code >> 8)
            v = self.nodes[k].values
            t, d = v["t"][node], v["d"][node]
            n = self.grams[k].values["n"][self.grams[k].find(code)]
            # a context that isn't in the trie is passed without an escape; once one is, all shorter ones are
            room_t, room_d = np.maximum(t - gone_t, 0), np.maximum(d - gone_d, 0) + v["e"][node]
            whole = room_t + room_d
            seen = n > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log10(n / whole)
                escape = np.where(room_d > 0, np.log10(room_d / whole), 0.0)
            out[left] += np.where(seen, hit, np.where(d > 0, escape, 0.0))
            gone_t, gone_d = np.where(d > 0, v["x"][node], gone_t), np.where(d > 0, d, gone_d)
            on = ~seen
            left, gone_t, gone_d = left[on], gone_t[on], gone_d[on]
        out[left] += np.log10(1 / np.maximum(256 - gone_d, 1))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            gram, of = grams(texts[i:j], self.order)
            out[i:j] = np.bincount(of, weights=self.log10(gram), minlength=j - i)
            i = j
        return out


def shorter(level: DataFrame, k: int) -> DataFrame:
    """The counts of grams of k bytes from those of one more."""
    return level.groupBy(tail("gram", k).alias("gram")).agg(F.sum("n").alias("n"))


def tail(gram: str, k: int):
    """The last k bytes of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * k) - 1))


def trained(train: DataFrame, order: int = ORDER, share: float = 0.0) -> Trie:
    """The trie of the training texts in memory, without nodes of less than a share of all bytes; for small texts."""
    level = stored(gram_sums(train, order).groupBy("gram").agg(F.sum("n").alias("n")))
    levels = []
    total = level.agg(F.sum("n")).first()[0] or 0
    for k in range(order, -1, -1):
        got = level.where(F.col("n") >= share * total).toPandas()
        levels.append((got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64)))
        if k:
            level = stored(shorter(level, k))
    return Trie(levels[::-1])


def costs(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, m, p) of each gram of the texts: how often it stands in all, log10 of its last byte after the others."""
    count = gram_sums(rows.where(~held_out()), order).select("gram", "n", F.col("n").alias("m"))
    count = count.unionByName(gram_sums(rows.where(held_out()), order).select("gram", F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    every = stored(count.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    levels = [every.where("n > 0").select("gram", "n")]
    for k in range(order, 0, -1):
        levels.insert(0, stored(shorter(levels[0], k)))

    at = Window.partitionBy(F.shiftright("gram", 8))
    of = every.select("gram", "n", "m", F.sum("n").over(at).alias("t"), F.count(F.when(F.col("n") > 0, 1)).over(at).alias("d"))
    done = [of.where("n > 0").select("gram", "m", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("p"))]
    # grams of no training text go down the contexts, the excluded counts and kinds with them
    zero = F.lit(0).cast("long")
    left = stored(every.where("n = 0").select("gram", "m", F.lit(0.0).alias("p"), zero.alias("gone_t"), zero.alias("gone_d")))
    for k in range(order, -1, -1):
        # tables of at most 2 ** 16 rows are broadcast, as their keys are hot
        node_hint, level_hint, below_hint = (F.broadcast if k <= most else lambda df: df for most in (2, 1, 2))
        here = left.withColumns({"code": tail("gram", k + 1), "context": F.shiftright(tail("gram", k + 1), 8)})
        seen = levels[k].withColumn("context", F.shiftright("gram", 8)).join(node_hint(here.select("context").distinct()), "context", "left_semi")
        if k:
            below = levels[k - 1].select(F.col("gram").alias("code"), F.col("n").alias("x"))
            seen = seen.withColumn("code", tail("gram", k)).join(below_hint(below), "code")
        else:
            seen = seen.withColumn("x", zero)
        node = seen.groupBy("context").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("x").alias("x"))
        met = here.join(node_hint(node), "context", "left").join(level_hint(levels[k].select(F.col("gram").alias("code"), "n")), "code", "left")
        room_t, room_d = (F.greatest(F.col(v) - F.col(f"gone_{v}"), zero) for v in "td")
        share = F.when(F.col("n").isNotNull(), F.col("n")).when(room_d > 0, room_d)  # no room, no escape to pay
        step = F.when(share.isNotNull() & F.col("d").isNotNull(), F.log10(share / (room_t + room_d))).otherwise(0.0)
        met = stored(met.select(
            "gram", "m", "n", (F.col("p") + step).alias("p"), F.coalesce("x", "gone_t").alias("gone_t"), F.coalesce("d", "gone_d").alias("gone_d")
        ))
        done.append(met.where("n is not null").select("gram", "m", "p"))
        left = met.where("n is null").drop("n")
    done.append(left.select("gram", "m", (F.col("p") - F.log10(F.greatest(F.lit(256) - F.col("gone_d"), F.lit(1)))).alias("p")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out)


def least_kept(cost: DataFrame, most: int) -> float:
    """A count that at most so many grams reach, from their numbers by size class."""
    found = cost.groupBy(F.floor(F.log2("m") * 16).alias("c")).agg(F.count("*").alias("grams"), F.min("m").alias("m")).orderBy(F.desc("c")).collect()
    least, had = float("inf"), 0
    for r in found:
        had += r.grams
        if had > most:
            break
        least = r.m
    return least


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts, ends counted."""

    def run(batches):
        count: Counter = Counter()
        for batch in sliced(batches):
            for t in batch.column(0):
                count.update(lowered(t.as_py()).split())
                count[b""] += 1
            if len(count) > 200_000:
                yield told(count)
                count = Counter()
        if count:
            yield told(count)

    def told(count):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def coded(fast: Table, texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text, the summed log10 of its grams in the table, and the grams that aren't there and how often each stands."""
    score, code, times, ends = np.zeros(len(texts)), [], [], np.zeros(len(texts) + 1, np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        gram, of = grams(texts[i:j], order)
        slot = fast.find(gram)
        score[i:j] = np.bincount(of, weights=fast.values["p"][slot], minlength=j - i)
        left = np.flatnonzero(fast.keys[slot] == -1)
        gram, of = gram[left], of[left]
        by = np.lexsort((gram, of))
        gram, of = gram[by], of[by]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])[: len(gram)])
        code.append(gram[first])
        times.append(np.diff(np.append(first, len(gram))))
        ends[i + 1 : j + 1] = np.bincount(of[first], minlength=j - i)
        i = j
    ends = pa.array(np.cumsum(ends), pa.int32())
    code, times = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (code, times))
    return score, pa.ListArray.from_arrays(ends, pa.array(code, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32), pa.int32()))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: word counts' and the byte model's log10 probabilities of each text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where(~held_out())
    counts = stored(token_counts(train))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = n + 0.5 * (v + 1)
    often = {r[0].encode(): r[1] for r in counts.where(F.col("n") >= WORD_SHARE * n).collect()} if n else {}
    cost = costs(rows)
    least = least_kept(cost, KEPT)
    kept = cost.where(F.col("m") >= least).select("gram", "p").toArrow()
    fast = Table(kept["gram"].to_numpy(), p=kept["p"].to_numpy())
    shared = spark.sparkContext.broadcast((often, fast))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        often, fast = shared.value
        cost = {w: np.log10((c + 0.5) / whole) for w, c in often.items()}
        for batch in sliced(batches):
            texts = [lowered(t.as_py()) for t in batch.column(1)]
            scores, codes, repeats = coded(fast, texts)
            tokens, known, base, words, times = [], [], [], [], []
            for t in texts:
                count = Counter(t.split())
                count[b""] += 1
                tokens.append(count.total())
                sure = count.keys() & cost.keys()
                known.append(sum(count[w] for w in sure))
                base.append(sum(count[w] * cost[w] for w in sorted(sure)))
                rest = [w for w in count if w not in cost]
                words.append([w.decode() for w in rest])
                times.append([count[w] for w in rest])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())), codes, repeats],
                ["doc_id", "n_tokens", "known", "base", "score", "words", "times", "codes", "repeats"],
            )

    spec = f"doc_id {id_type}, n_tokens long, known long, base double, score double, words array<string>, times array<long>, codes array<long>, repeats array<int>"
    keyed = rows.mapInArrow(run, spec)
    found = stored(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "known", "base", "score", F.arrays_zip("words", "times").alias("rest"), F.arrays_zip("codes", "repeats").alias("grams")))
    rare = found.select("row", F.explode("rest").alias("x")).select("row", F.col("x.words").alias("token"), F.col("x.times").alias("k"))
    seen = rare.join(counts.where(F.col("n") < WORD_SHARE * n), "token", "left")
    part = seen.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(float(whole)))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("met"),
    )
    scarce = found.select("row", F.explode("grams").alias("x")).select("row", F.col("x.codes").alias("gram"), F.col("x.repeats").alias("k"))
    spent = scarce.join(cost.where(F.col("m") < least).select("gram", "p"), "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("p")).alias("spent"))
    out = found.drop("rest", "grams").join(part, "row", "left").join(spent, "row", "left")
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("spent", F.lit(0.0))).alias("score"),
    )
