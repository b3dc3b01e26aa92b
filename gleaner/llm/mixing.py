"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into BLOCKS hashed blocks. The blocks in hash order, over and over, are the draws of the
source: disjoint blocks until all have been drawn once, then a second pass, then a third. A source's quota is the
number of draws that fit into its target, and one more where a block left in that pass brings the words nearer to it. The tree splits the quotas of all sources among output shards: at each node,
the left half of the shards gets a multivariate-hypergeometric share of the draws, so that each shard is an unbiased
sample of the mix. Each shard then takes its own run of draws of each source and orders its rows by a hash.

The driver holds a row for each source and shard: the mix is configured by source, so these are as many as the weights
that it is given. Blocks, documents and their order stay on the executors, and no source lands in one task: a hot source
is spread over its blocks.

Defined results: a null text has size 0 and is drawn like others with its block; a null source is a source of its own, the
last; sources without words have target 0 and are not drawn; repeated rows are drawn together with their block; an empty
table gives no rows; reruns agree; other columns, whatever their names, are passed on by mix() and not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, own_columns, stored

BLOCKS = 4096
SHARDS = 16
SEED = 20240229
MOST = 3
#: Words that a part of a shard should hold while its rows are put in order.
PART_WORDS = 250_000
#: Words that one task should move at most; a mix of more than the session's shuffle partitions can hold gets more of them.
TASK_WORDS = 20_000_000
#: Draws that are broadcast, so that whole texts needn't move to meet them; a mix of more draws moves its texts instead.
SENT = 1 << 19


def block_key(blocks: int) -> tuple[Column, Column]:
    """The hash that orders a source's documents, and the block that it puts them into."""
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("source"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))
    return key, F.pmod(key, F.lit(blocks)).cast("int")


def sized(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, words and block of each document."""
    bare = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    words = F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)
    return docs.select("doc_id", "source", words.cast("long").alias("size"), block_key(blocks)[1].alias("block"))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight; what exceeds most times the source's size is shared again."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) that each shard (rows) gets; shards get equal numbers of draws, to one."""
    total = int(quotas.sum())
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        want, rest = sum(room[first:middle]), int(have.sum())
        left = np.zeros_like(have)
        for i, n in enumerate(have):  # one source after the other: each draw is hypergeometric given the former
            rest -= int(n)
            if want:
                left[i] = rng.hypergeometric(int(n), rest, want) if rest else min(int(n), want)
                want -= int(left[i])
        down(first, middle, left)
        down(middle, last, have - left)

    down(0, shards, quotas.astype(np.int64))
    return out


def plan(rows: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """(draws, sources): draws has source, block, pass and shard; sources has source, source_size and target."""
    spark = rows.sparkSession
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sizes = {r[0]: r[1] for r in blocks.groupBy("source").agg(F.sum("words")).collect()}
    wanted = targets(sizes, weights)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    table = [(s, sizes[s], float(wanted[s])) for s in names]
    sources = spark.createDataFrame(table, "source string, source_size long, target double")
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    laid = blocks.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1)
    laid = laid.withColumn("of", F.count("*").over(Window.partitionBy("source")))
    s = sources.withColumnRenamed("source", "__source")
    laid = laid.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # Draws are taken while they fit. The last one is, of the blocks that its pass has left, that which brings the sum nearest.
    passes = laid.where("source_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    passes = passes.withColumn("nth", F.col("pass") * F.col("of") + F.col("nth"))
    of, fits = Window.partitionBy("source"), F.col("pass") * F.col("source_size") + F.col("before") + F.col("words") <= F.col("target")
    laid = passes.withColumn("fits", fits).withColumn("left", F.col("target") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))).over(of), F.lit(0)))
    laid = laid.withColumn("first_free", F.count_if("fits").over(of)).withColumn("gap", F.abs(F.col("words") - F.col("left")))
    may_end = ~F.col("fits") & (F.col("pass") == F.floor(F.col("target") / F.col("source_size"))) & (F.col("gap") < F.col("left"))
    laid = laid.withColumn("ends", F.min(F.when(may_end, F.struct("gap", "nth"))).over(of)["nth"])
    place = F.when(F.col("fits"), F.col("nth")).when(F.col("nth") == F.col("ends"), F.col("first_free"))
    drawn = stored(laid.select("source", "block", "pass", place.alias("nth")).where("nth is not null"))
    quota = {r[0]: r[1] for r in drawn.groupBy("source").count().collect()}
    have = split(np.array([quota.get(n, 0) for n in names], np.int64), shards, np.random.default_rng(SEED))
    ends = np.cumsum(have, axis=0)
    runs = [(n, k, int(ends[k, i] - have[k, i]), int(ends[k, i])) for i, n in enumerate(names) for k in range(shards) if have[k, i]]
    runs = spark.createDataFrame(runs, "__source string, shard int, first long, end long")
    return drawn.join(runs, F.col("source").eqNullSafe(F.col("__source")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("end"))).select("source", "block", "pass", "shard"), sources


def dealt(rows: DataFrame, words: float, shards: int, shard: str, place: str, part: int = PART_WORDS, task: int = TASK_WORDS) -> DataFrame:
    """The rows moved by shard and by part of it, so that a part holds about so many words and a task no more than it should."""
    keys = shard, F.pmod(F.xxhash64(F.lit(SEED + 2), place), F.lit(max(1, int(words // (shards * part)))))
    tasks = int(words // task) + 1
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(tasks, *keys)
    return rows.repartition(*keys)


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: all columns of the documents, once for each draw, by output shard and in hash order there."""
    names = own_columns(docs)
    draws, sources = plan(sized(docs), shards)
    block, place, shard, s, b, turn = (fresh(docs, x) for x in ("block", "place", "shard", "s", "b", "pass"))
    d = draws.select(F.col("source").alias(s), F.col("block").alias(b), F.col("pass").alias(turn), F.col("shard").alias(shard))
    if sources.count() * BLOCKS * MOST <= SENT:
        d = F.broadcast(d)
    out = docs.withColumn(block, block_key(BLOCKS)[1]).join(d, F.col("source").eqNullSafe(F.col(s)) & (F.col(block) == F.col(b)))
    out = out.withColumn(place, F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col(turn), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))))
    words = sources.agg(F.sum("target")).first()[0] or 0
    return dealt(out, words, shards, shard, place).sortWithinPartitions(shard, place).select(*names)


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: words that the mix takes of each document."""
    rows = stored(sized(docs))
    draws, sources = plan(rows)
    d = draws.groupBy(F.col("source").alias("__s"), F.col("block").alias("__b")).agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    s = sources.withColumnRenamed("source", "__source")
    out = rows.join(s, F.col("source").eqNullSafe(F.col("__source"))).join(d, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"), F.col("source").alias("source"), "first_shard")
