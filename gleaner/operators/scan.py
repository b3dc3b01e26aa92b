"""Passes over sorted rows: whole groups many at a time, and a fold whose state goes on from one partition to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.staging import staged


def key_of(*by: str) -> Column:
    """One column that is equal where all the columns are, nulls included."""
    return F.to_json(F.struct(*[F.col(c).alias(str(i)) for i, c in enumerate(by)]), {"ignoreNullFields": "false"})


def in_groups(df: DataFrame, by: list[str], order: list[str], fold: Callable[[pa.Table, np.ndarray], pa.RecordBatch], spec: str) -> DataFrame:
    """What fold makes of whole groups, which must be small, in the given order of their rows.

    fold gets the rows of many groups at once, with where each begins and where the last ends; the last column is the group's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                rows = pa.Table.from_batches(parts).combine_chunks()
                key = rows.column(rows.num_columns - 1).combine_chunks()
                begins = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
                yield fold(rows, np.concatenate([[0], begins, [len(key)]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.num_columns - 1)
            start = pc.index(key, key[-1]).as_py()
            if start:
                yield from told([*held, batch.slice(0, start)])
                held = [batch.slice(start)]
            elif held and held[-1].column(batch.num_columns - 1)[-1] == key[-1]:
                held.append(batch)
            else:
                yield from told(held)
                held = [batch]
        yield from told(held)

    keyed = df.withColumn("__key", key_of(*by))
    return keyed.repartition("__key").sortWithinPartitions("__key", *order).mapInArrow(run, spec)


def carried(df: DataFrame, key: str, order: str, values: list[str], step: Callable, none: tuple, name: str, parts: int = 0) -> DataFrame:
    """The rows with one more column (long): what a fold over each group's rows in order gives for each of them.

    step(state, order, *values) gives (state, result), where a state is a tuple of numbers and none the state before a group's
    first row. Without parts, a group is scanned by one task, with the state of one row. With parts, rows are dealt out by ranges
    of group and order, so a long group lies in many of them. A part goes by the state that the one before it ended with; as that
    is only known once it was scanned, parts are scanned again until no state that is handed on changes. A group's later rows
    seldom depend on how its earlier ones went, so that mostly happens at once.
    """
    kept = df.columns
    at = [kept.index(c) for c in (order, *values)]
    before: dict[int, tuple] = {}
    dealt = df.repartition(key).withColumn("__part", F.lit(0)) if not parts else staged(df.repartitionByRange(parts, key, order).withColumn("__part", F.spark_partition_id()))
    spec = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(dealt.dtypes)] + [f"c{len(kept) + 1} long, c{len(kept) + 2} array<double>"])
    while True:

        def scan(batches: Iterator[pa.RecordBatch], before=before) -> Iterator[pa.RecordBatch]:
            part, own, state = None, None, none
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in (kept.index(key), len(kept), *at)), strict=True)
                results, states = [], []
                for k, p, *row in rows:
                    if p != part:
                        part, (own, state) = p, before.get(p, (None, none))
                    if k != own:
                        own, state = k, none
                    state, result = step(state, *row)
                    results.append(result)
                    states.append(state)
                states = pa.array([[float(x) for x in s] for s in states] if parts else [None] * len(states), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, pa.int64()), states], [f"c{i}" for i in range(len(kept) + 3)])

        if not parts:
            return dealt.sortWithinPartitions(key, order).mapInArrow(scan, spec).toDF(*kept, "__part", name, "__state").select(*kept, name)
        done = staged(dealt.repartition("__part").sortWithinPartitions("__part", key, order).mapInArrow(scan, spec).toDF(*kept, "__part", name, "__state"))
        ends = F.max_by(F.struct(key, "__state"), F.struct(key, order)).alias("x")
        told = {r[0]: r for r in done.groupBy("__part").agg(F.min(key).alias("first"), ends).select("__part", "first", "x.*").collect()}  # a row a part
        handed, state = {}, None
        for p in sorted(told):
            if state is not None and state[0] == told[p]["first"]:
                handed[p] = state
            state = (told[p][2], tuple(told[p][3]))
        if handed == before:
            return done.select(*kept, name)
        before = handed
