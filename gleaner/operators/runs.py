"""Runs: the many readings of one hit, cut into stretches, and each stretch into the lines that made it.

Nothing here gathers a stretch's readings: runs are put together by a scan that carries one row's state, readings meet the line
nearest in time by two passes in order of time, and lines are summed up in two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import fixed as X
from gleaner.functions.text import tenths
from gleaner.operators.scan import carried, in_groups, key_of
from gleaner.operators.statistics import islands
from gleaner.sources.staging import staged

HIT = ("clip_id", "kind", "dir", "amount", "fighter")
#: Runs of one key beyond which they are scanned in many parts.
LONG = 1 << 20


def second(cfg: Settings) -> Column:
    """What tells two timed lines apart: the second, from the aligned time or from the clock."""
    return F.when(F.col("exact"), F.coalesce(F.col("wall_s"), F.col("t")) if cfg.exact_second_key else F.bround("t"))


def stretches(readings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Readings with read_at, second and run: stretches without a break of more than the line's span.

    They are dealt out in as many parts as the session sets, as the passes over them are much work for few bytes.
    """
    df = readings.repartition(int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")), *HIT)
    df = df.withColumn("read_at", F.coalesce("ft", "t")).withColumn("second", second(cfg))
    return islands(df, HIT, "read_at", cfg.visible, ("t", "seq"), "run")


def apart(df: DataFrame, horizon: float = 24.0) -> DataFrame:
    """Readings of stretches() with stretch, alone and key as far as that is told without a scan; a null stretch says that it is not.

    A run begins a stretch for sure if it shows seconds but none that a run before it shows, or if it shows none and lies farther
    than horizon from the one before. What lies between such beginnings is put together by a scan only if it has several runs and
    one of them shows a second. All passes work where the readings lie. key is a number that no other run, or stretch, has.
    """
    order, run = Window.partitionBy(*HIT).orderBy("read_at", "t", "seq"), Window.partitionBy(*HIT, "run")
    df = df.withColumn("key", F.monotonically_increasing_id())
    df = df.withColumn("__gap", F.when(F.col("run") > F.lag("run").over(order), F.col("read_at") - F.lag("read_at").over(order)))
    df = df.withColumn("__shown", F.col("second").isNotNull() & (F.min("run").over(Window.partitionBy(*HIT, "second")) < F.col("run")))
    df = df.withColumns({
        "__n": F.count("*").over(run), "__timed": F.max(F.col("second").isNotNull()).over(run), "__linked": F.max("__shown").over(run), "__near": F.coalesce(F.max("__gap").over(run) <= horizon, F.lit(False)), "key": F.min("key").over(run),
    })
    begins = F.when(~F.when(F.col("__timed"), F.col("__linked")).otherwise(F.col("__near")), F.col("run"))
    df = df.withColumn("__begin", F.max(begins).over(Window.partitionBy(*HIT).orderBy("run")))
    piece = Window.partitionBy(*HIT, "__begin")
    df = df.withColumn("__scanned", (F.max("run").over(piece) > F.col("__begin")) & F.max("__timed").over(piece))
    df = df.withColumn("stretch", F.when(~F.col("__scanned"), F.col("run"))).withColumn("alone", F.col("stretch").isNotNull() & (F.col("__n") == 1))
    return df.drop("__gap", "__shown", "__n", "__timed", "__linked", "__near", "__begin", "__scanned")


def _rejoin(horizon: float):
    def step(state, run, first_at, last_at, linked, timed):
        """state: the first run of what was joined so far, the last of its runs with a second, the last reading."""
        first, shown, at = state
        back = linked if timed else shown if first_at - at <= horizon else -1
        if first < 0 or back is None or back < first:
            first, shown = run, -1
        return (first, run if timed else shown, last_at), int(first)

    return step


def rejoined(df: DataFrame, by: tuple[str, ...] = HIT, horizon: float = 24.0, parts: int = 0) -> DataFrame:
    """Readings with runs put together again: with the ones before if both show a common second, or if this shows none, those
    show some, and no more than horizon lies between; alone tells the readings that are all of their stretch.

    A run shows a second that those before it, as far as they are joined, show as well, if the last run that showed one of its
    seconds is among them; so the scan needs no sets of seconds. A stretch is called by its first run.
    """
    df = staged(df.withColumn("__key", key_of(*by)))
    run = df.groupBy("__key", "run").agg(F.count("*").alias("readings"), F.min("read_at").alias("first_at"), F.max("read_at").alias("last_at"), F.max(F.col("second").isNotNull()).alias("timed"))
    shown = df.where("second is not null").select("__key", "run", "second").distinct()
    shown = shown.withColumn("linked", F.lag("run").over(Window.partitionBy("__key", "second").orderBy("run"))).where("linked is not null")
    run = staged(run.join(shown.groupBy("__key", "run").agg(F.max("linked").alias("linked")), ["__key", "run"], "left"))
    if not parts and (run.agg(F.max("run")).first()[0] or 0) >= LONG:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fold = carried(run, "__key", "run", ["first_at", "last_at", "linked", "timed"], _rejoin(horizon), (-1, -1, 0.0), "stretch", parts)
    alone = F.sum("readings").over(Window.partitionBy("__key", "stretch")) == 1
    return df.join(staged(fold.withColumn("alone", alone).select("__key", "run", "stretch", "alone")), ["__key", "run"]).drop("__key")


def known_tags(flags: Column) -> Column:
    return F.size(F.array_except(flags, F.array(*[F.lit(t) for t in X.TAGS]))) == 0


def summed(df: DataFrame, *key: str) -> DataFrame:
    """For each line's readings and each list of tags: how many, from when to when, and the first reading of all."""
    base = F.struct("t", "read_at", "seq", F.struct(*HIT, "pass", "ft", "wall_s", "exact", "who", "target", "ability", "raw").alias("r"))
    return df.groupBy(*key, "flags").agg(F.count("*").alias("votes"), F.min(F.struct("read_at", "t", "seq")).alias("met"), F.min(base).alias("base"), F.min("read_at").alias("from"), F.max("read_at").alias("to"))


def told(parts: DataFrame, name: str, *key: str) -> DataFrame:
    """A row for each line from its sums by lists of tags: the most frequent list, of known tags alone if there are any such, of
    equals the one met first."""
    best = F.min(F.struct(~F.coalesce(known_tags(F.col("flags")), F.lit(False)), -F.col("votes"), "met", F.col("flags").alias("flags")))["flags"]
    return parts.groupBy(*key).agg(F.struct(F.min("base").alias("base"), best.alias("flags"), F.sum("votes").alias("seen"), F.min("from").alias("from"), F.max("to").alias("to")).alias(name))


def copies(frames: DataFrame, known: DataFrame, key: str, apart: float = 2.0) -> DataFrame:
    """(key, at): lines that only copies in a frame witness.

    frames (key, at, n) says how many copies a frame shows at most, known (key, at) which lines there are. For each k up to the
    most copies the first frame with k of them adds a line, unless it is near another one or there are as many lines as copies.
    """
    most = frames.groupBy(key).agg(F.max("n").alias("most")).join(known.groupBy(key).agg(F.count("*").alias("lines")), key, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    # a frame is the first with more copies than any before it; one row for it does, as its other ones would be near this
    before = F.coalesce(F.max("n").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = frames.join(most.where("most > lines"), key).withColumn("k", before + 1).where("n >= k").select(key, "most", "lines", "k", "at")
    # a line meets the cells of time beside its own alone
    cell = lambda d: F.floor((F.col("at") + d) / (apart + 1))
    around = known.select(key, F.col("at").alias("__line"), F.explode(F.array(*[cell(d) for d in (-apart - 1, 0.0, apart + 1)])).alias("__cell"))
    near = (F.col("__line") - F.col("at") <= apart) & (F.col("at") - F.col("__line") <= apart)
    free = first.withColumn("__cell", cell(0.0)).alias("f").join(around.alias("a"), (F.col(f"f.{key}") == F.col(f"a.{key}")) & (F.col("f.__cell") == F.col("a.__cell")) & near, "left_anti")

    def fold(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """The rest are as many as copies in one frame: each is far from those that were added before it, or goes."""
        at, room = rows["at"].to_numpy(), rows["room"].to_numpy()
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            added: list[int] = []
            for i in range(lo, hi):
                if len(added) < room[i] and all(abs(at[i] - at[j]) > apart for j in added):
                    added.append(i)
            out += added
        kept = pa.array(out, pa.int64())
        return pa.RecordBatch.from_arrays([rows[key].combine_chunks().take(kept), rows["at"].combine_chunks().take(kept)], [key, "at"])

    return in_groups(free.select(key, "k", "at", (F.col("most") - F.col("lines")).alias("room")), [key], ["k"], fold, f"{key} {free.schema[key].dataType.simpleString()}, at double")


def nearest_line(readings: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Readings with the number (nth) of the line (key, at, nth) nearest to t, of two as near the earlier; null without lines.

    Readings and lines stand in one order of time: the last line before a reading, and from the other end the first one after it.
    """
    spots = lines.groupBy(key, "at").agg(F.min("nth").alias("nth"))
    line = spots.select(key, F.col("at").alias("t"), F.struct("at", "nth").alias("line"))
    both = readings.withColumn("line", F.lit(None).cast(line.schema["line"].dataType)).unionByName(line, allowMissingColumns=True)
    is_line = F.col("line").isNotNull()
    up = Window.partitionBy(key).orderBy("t", F.when(is_line, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("t"), F.when(is_line, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("before", F.last("line", ignorenulls=True).over(up)).withColumn("after", F.last("line", ignorenulls=True).over(down)).where(~is_line)
    later = F.col("before").isNull() | (F.abs(F.col("after.at") - F.col("t")) < F.abs(F.col("before.at") - F.col("t")))
    return met.select(*readings.columns, F.when(F.coalesce(later, F.lit(False)), F.col("after.nth")).otherwise(F.col("before.nth")).alias("nth"))


def merged(df: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One event for each line of each stretch.

    A line is a second that timed readings show, or copies in one frame. Each reading is of the line nearest in time. A timed
    line's event comes from the readings of its second, and how often and long it was seen from the readings nearest to it; a
    line of copies alone comes from those nearest to it. A stretch without either is one event.
    """
    df = df if "key" in df.columns else df.withColumn("key", key_of(*HIT, "stretch"))
    known = df.where("second is not null").groupBy("key", "second").agg(F.min("t").alias("at"))
    frames = df.where("ft is not null").groupBy("key", "ft", "pass").agg(F.count("*").alias("n")).groupBy("key", F.col("ft").alias("at")).agg(F.max("n").alias("n"))
    extra = copies(frames, known.select("key", "at"), "key", cfg.copy_apart)
    lines = known.select("key", "at", "second").unionByName(extra.withColumn("second", F.lit(None).cast("double")))
    # a timed line comes before a line of copies at the same time
    nth = F.row_number().over(Window.partitionBy("key").orderBy("at", F.col("second").isNull(), "second")) - 1
    lines = staged(lines.withColumn("nth", nth))
    by_line = staged(summed(nearest_line(df, lines, "key").withColumn("nth", F.coalesce("nth", F.lit(0))), "key", "nth"))
    mine = told(by_line, "mine", "key", "nth")
    own = told(summed(df.where("second is not null"), "key", "second"), "own", "key", "second")
    line = lines.join(mine, ["key", "nth"], "full").join(own, ["key", "second"], "left")
    # a line of copies to which no reading is nearest tells of the whole stretch; there are few such
    bare = F.col("second").isNull() & F.col("at").isNotNull()
    lost = staged(lines.where("second is null").join(by_line.select("key", "nth"), ["key", "nth"], "left_anti").select("key").distinct())
    every = by_line.join(lost, "key", "left_semi").groupBy("key", "flags").agg(F.sum("votes").alias("votes"), F.min("met").alias("met"), F.min("base").alias("base"), F.min("from").alias("from"), F.max("to").alias("to"))
    line = line.join(staged(told(every, "whole", "key")), "key", "left")
    line = line.withColumn("s", F.coalesce("own", "mine", "whole")).withColumn("b", F.coalesce("mine", "own", "whole")).withColumn("base", F.col("s.base.r"))
    fighter, incoming = F.col("base.fighter"), F.col("base.dir") == "in"
    return line.select(
        "base.clip_id", F.col("s.base.seq").alias("seq"), F.col("base.pass").alias("pass"), "base.ft", "base.wall_s",
        F.when(bare, tenths(F.col("at"))).otherwise(F.col("s.base.t")).alias("t"), "base.exact", "base.kind", "base.dir",
        F.when(incoming, fighter).otherwise(F.col("base.who")).alias("who"), F.when(incoming, F.col("base.target")).otherwise(fighter).alias("target"),
        fighter.alias("fighter"), "base.amount", "base.ability", F.col("s.flags").alias("flags"), "base.raw", F.col("b.seen").alias("seen"),
        tenths(F.col("b.to") - F.col("b.from")).alias("span"), F.col("b.to").alias("last"),
    )


def single(df: DataFrame) -> DataFrame:
    """The events of stretches of one reading, as merged() would have them: an untimed reading's line is a copy in its frame."""
    bare, incoming = F.col("second").isNull() & F.col("ft").isNotNull(), F.col("dir") == "in"
    return df.select(
        "clip_id", "seq", "pass", "ft", "wall_s", F.when(bare, tenths(F.col("ft"))).otherwise(F.col("t")).alias("t"), "exact", "kind", "dir",
        F.when(incoming, F.col("fighter")).otherwise(F.col("who")).alias("who"), F.when(incoming, F.col("target")).otherwise(F.col("fighter")).alias("target"),
        "fighter", "amount", "ability", "flags", "raw", F.lit(1).cast("long").alias("seen"), tenths(F.col("read_at") - F.col("read_at")).alias("span"), F.col("read_at").alias("last"),
    )


def events(readings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The events that the readings tell of; those without a fighter go.

    Only runs that may be joined are scanned. A stretch of one reading, of which a fast fight has most, is its event as it stands;
    only the others are summed up.
    """
    df = staged(apart(stretches(readings.where("fighter is not null and fighter <> ''"), cfg), 2 * cfg.visible))
    scanned = rejoined(df.where("stretch is null").drop("stretch", "alone"), HIT, 2 * cfg.visible)
    scanned = staged(scanned.withColumn("key", F.min("key").over(Window.partitionBy(*HIT, "stretch"))))
    df = df.where("stretch is not null").unionByName(scanned)
    return single(df.where("alone")).unionByName(merged(df.where("not alone"), cfg))
