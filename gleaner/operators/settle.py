"""Amounts: numbers that one frame reads otherwise than its neighbours are put right by the company they stand in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions.text import one_glyph_off
from gleaner.operators.scan import in_groups
from gleaner.sources.staging import staged

COMPANY = ["clip_id", "kind", "dir", "fighter"]
#: How many times as long as the reach of settling a stretch of time is that one group holds.
REACHES = 50
DIGITS = "0123456789"
#: Rows that one task of the band join holds, about.
TASK_ROWS = 1 << 19


def bare() -> Column:
    """Whether a row has no tag."""
    return F.coalesce(F.size("flags"), F.lit(0)) == 0


def _fair(amount: Column, n: Column, bare: Column, other: Column, m: Column) -> Column:
    """Whether a row of an amount read n times may be one of another read m times.

    A number read once yields to one a glyph off that was read twice; a repeated one without a tag yields to the number it
    extends by one last digit, if that was read more than twice as often.
    """
    a, b = amount.cast("string"), other.cast("string")
    longer = F.substring(a, 1, 9).startswith(b) & (F.length(a) == F.length(b) + 1)
    return F.when(n == 1, one_glyph_off(a, b) & (m >= 2)).otherwise(bare & longer & (m >= 2 * n + 1))


def settled_by_join(readings: DataFrame, visible: float = 12.0, company: list[str] | None = None, order: str = "seq", time: str = "t") -> DataFrame:
    """Readings with amounts settled from the counts as they were read, by a band join within each company.

    Only rows whose amount may yield meet others, and only those of an amount that it may yield to. Times are cut into cells as
    wide as the band, so that a row meets its own cell and both neighbours alone; equal rows of a cell meet as one. Rows are
    dealt out in parts by their number, so that a task's memory doesn't grow with the table.
    """
    company = company or COMPANY
    rows = readings.where(F.col(company[-1]).isNotNull()).select(*company, F.col(order).alias("__seq"), F.col(time).alias("__t"), "amount", "flags")
    met = staged(chances(rows, company, glyphs="-" + DIGITS))
    pairs = met.select(*company, "amount", "__n", F.explode("__chances").alias("__x")).select(*company, "amount", "__n", "__x.__m", "__x.__other")
    parts = max(int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)
    rows = rows.withColumn("__bare", bare()).drop("flags").withColumn("__cell", F.floor(F.col("__t") / visible))
    odd = rows.join(pairs, [*company, "amount"]).where(_fair(F.col("amount"), F.col("__n"), F.col("__bare"), F.col("__other"), F.col("__m")))
    odd = odd.select(*company, "__seq", "__t", "__m", "__other", F.explode(F.array(*[F.col("__cell") + i for i in (-1, 0, 1)])).alias("__cell"))
    others = rows.join(pairs.select(*company, F.col("__other").cast(rows.schema["amount"].dataType).alias("amount")).distinct(), [*company, "amount"], "left_semi")
    others = others.select(*company, "__seq", "__t", "__cell", F.col("amount").cast("long").alias("__other")).repartition(parts, *company, "__other", "__cell")
    others = others.groupBy(*company, "__cell", "__other", F.col("__t").alias("__ot")).agg(F.min("__seq").alias("__oseq"))
    near = odd.join(others, [*company, "__other", "__cell"]).where(F.abs(F.col("__t") - F.col("__ot")) <= visible)
    best = staged(near.groupBy(*company, F.col("__seq").alias(order)).agg(F.max_by("__other", F.struct("__m", -F.col("__oseq"))).alias("__best")))
    out = readings.join(best, [*company, order], "left").withColumn("amount", F.coalesce(F.col("__best").cast(readings.schema["amount"].dataType), "amount"))
    return out.select(*readings.columns)


def near_numbers(number: Column, glyphs: str = DIGITS) -> Column:
    """All strings of glyphs one off a number's: one less, more, or other (not of a number of one digit)."""
    n, digits = F.length(number), F.array(*[F.lit(d) for d in glyphs])
    at = F.sequence(F.lit(1), n)
    without = lambda i: F.concat(F.left(number, i - 1), F.substr(number, i + 1))
    less = F.filter(F.transform(at, without), lambda x: x != "")
    more = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(digits, lambda d: F.concat(F.left(number, i), d, F.substr(number, i + 1)))))
    other = F.when(n > 1, F.flatten(F.transform(at, lambda i: F.transform(digits, lambda d: F.concat(F.left(number, i - 1), d, F.substr(number, i + 1)))))).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.concat(less, more, other), F.array(number))


def chances(readings: DataFrame, by: list[str], mine: Column | None = None, glyphs: str = DIGITS) -> DataFrame:
    """(by, amount, __n, __chances): how often each amount was read, and the amounts that a row of it may yield to, as (m, other).

    With mine, which tells the rows to settle, amounts that no such row may leave are left out.
    """
    mine = F.lit(True) if mine is None else F.coalesce(mine, F.lit(False))
    tally = readings.groupBy(*by, "amount").agg(F.count("*").alias("__n"), F.max(mine).alias("__any"), F.max(mine & bare()).alias("__bare"))
    tally = staged(tally.withColumn("__s", F.col("amount").cast("string")))
    # numbers are few beside the rows that hold them, so their neighbours are worked out once
    once = tally.where("__n = 1 and __any")
    near = once.select("__s").distinct().withColumn("__o", F.explode(near_numbers(F.col("__s"), glyphs)))
    near = staged(near.join(tally.where("__n > 1").select(F.col("__s").alias("__o")).distinct(), "__o", "left_semi"))
    once = once.join(near, "__s").select(*tally.columns, "__o")
    often = tally.where("__n > 1 and __bare and length(__s) > 1").withColumn("__o", F.expr("left(__s, length(__s) - 1)"))
    to = tally.where("__n > 1").select(*by, F.col("__s").alias("__o"), F.col("__n").alias("__m"), F.col("amount").alias("__other"))
    met = once.unionByName(often).join(to, [*by, "__o"]).where((F.col("__n") == 1) | (F.col("__m") >= 2 * F.col("__n") + 1))
    # a number has a few dozen neighbours at most
    return met.groupBy(*by, "amount", "__n").agg(F.collect_list(F.struct("__m", F.col("__other").cast("long").alias("__other"))).alias("__chances"))


def _fold(rows: pa.Table, cuts: np.ndarray, visible: float) -> pa.RecordBatch:
    """Settles the open rows of each group in order; columns: seq, t, amount, now, own, chances."""
    seq, times, amount = (rows[c].to_numpy() for c in ("seq", "t", "amount"))
    now, own, chance = rows["now"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False), rows["chances"].combine_chunks()
    known, live = ~np.isnan(now), np.diff(chance.offsets.to_numpy()) > 0
    current, out = amount.astype(np.int64), []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        t, value = times[lo:hi], current[lo:hi]
        by_time = np.argsort(t, kind="stable")
        ordered = t[by_time]
        for i in np.flatnonzero(np.where(own[lo:hi], live[lo:hi], known[lo:hi])).tolist():
            if not own[lo + i]:  # settled by its own group, and so it stands for rows after it
                value[i] = int(now[lo + i])
                continue
            first, last = np.searchsorted(ordered, t[i] - visible - 1e-6), np.searchsorted(ordered, t[i] + visible + 1e-6, "right")
            near = by_time[first:last]
            near = near[np.abs(t[near] - t[i]) <= visible]
            votes = {c["__other"]: c["__m"] for c in chance[lo + i].as_py()}
            fit = near[np.isin(value[near], np.fromiter(votes, np.int64, len(votes)))]
            if len(fit):
                value[i] = value[max(fit.tolist(), key=lambda k: (votes[int(value[k])], -k))]
            out.append(lo + i)
    at = np.array(out, np.int64)
    return pa.RecordBatch.from_arrays([rows["by"].combine_chunks().take(pa.array(at)), pa.array(seq[at]), pa.array(amount[at]), pa.array(current[at])], ["by", "seq", "amount", "now"])


def changes(df: DataFrame, by: list[str], mine: Column, visible: float, reaches: int = REACHES) -> DataFrame:
    """(by, seq, now): the rows of the groups of by that settle to another amount, one after the other; mine tells the rows to settle.

    What a row may become depends on how often each amount was read, and on the rows near it in time as they stand by then. So
    time is cut into stretches, of which each also sees the rows within reach of its ends, with what these have become in their
    own stretch; a stretch is settled again where that has changed. As a row depends on rows before it alone, this ends with what
    one fold over all would give, mostly after two rounds, and no group holds more than a stretch. Only rows whose amount may
    yield, or may be yielded to, travel, and from round to round those that have changed.
    """
    width = reaches * visible
    met = staged(chances(df, by, mine))
    others = met.select(*by, F.explode("__chances.__other").alias("amount")).withColumn("amount", F.col("amount").cast(df.schema["amount"].dataType))
    listed = met.unionByName(others, allowMissingColumns=True).groupBy(*by, "amount").agg(F.max("__n").alias("__n"), F.first("__chances", ignorenulls=True).alias("__chances"))
    rows = df.where("amount is not null and t is not null").select(*by, "seq", F.col("t").cast("double").alias("t"), "amount", F.coalesce(mine, F.lit(False)).alias("__mine"), bare().alias("__bare"))
    rows = rows.join(listed, [*by, "amount"]).select(
        F.to_json(F.array(*[F.col(c).cast("string") for c in by])).alias("by"), "seq", "t", F.col("amount").cast("long").alias("amount"),
        F.when(F.expr("__mine and (__n = 1 or __bare)"), F.col("__chances")).alias("chances"), F.floor(F.col("t") / width).alias("cell"),
    )
    rows = staged(rows)
    touched = F.array_distinct(F.array(*[F.floor((F.col("t") + d) / width) for d in (0.0, -visible - 1e-6, visible + 1e-6)]))
    seen = rows.withColumn("__home", F.col("cell")).withColumn("cell", F.explode(touched)).withColumn("own", F.col("cell") == F.col("__home")).drop("__home")

    def folded(cells: DataFrame, now: DataFrame | None) -> DataFrame:
        """The rows to settle of these stretches, with what they were read as and have become."""
        given = cells.withColumn("now", F.lit(None).cast("double")) if now is None else cells.join(now.select("by", "seq", F.col("now").cast("double").alias("now")), ["by", "seq"], "left")
        given = given.select("by", "seq", "t", "amount", F.when(~F.col("own"), F.col("now")).alias("now"), "own", F.coalesce("chances", F.array().cast(rows.schema["chances"].dataType)).alias("chances"), "cell")
        return in_groups(given, ["by", "cell"], ["seq"], lambda table, cuts: _fold(table, cuts, visible), f"by string, seq {dict(rows.dtypes)['seq']}, amount long, now long")

    now = staged(folded(seen, None).where("now <> amount"))
    changed = now.select("by", "seq")
    while True:
        again = staged(seen.where("not own").join(changed, ["by", "seq"], "left_semi").select("by", "cell").distinct())
        if again.isEmpty():
            break
        cells = staged(folded(seen.join(again, ["by", "cell"], "left_semi"), now))
        was = now.select("by", "seq", F.col("now").alias("was"))
        changed = staged(cells.join(was, ["by", "seq"], "left").where("now <> coalesce(was, amount)").select("by", "seq"))
        now = staged(now.join(cells, ["by", "seq"], "left_anti").unionByName(cells.where("now <> amount")))
    of = F.from_json("by", "array<string>")
    return now.select(*[of[i].cast(df.schema[c].dataType).alias(c) for i, c in enumerate(by)], "seq", "now")


def put(df: DataFrame, better: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the amounts (by, seq, now) that they have settled to."""
    return df.join(better, [*by, "seq"], "left").withColumn("amount", F.coalesce(F.col("now").cast(df.schema["amount"].dataType), "amount")).select(*df.columns)


def step(df: DataFrame, by: list[str], mine: Column, visible: float, reaches: int = REACHES) -> DataFrame:
    """Rows of the groups of by with amounts settled one after the other; mine tells the rows to settle."""
    return put(df, changes(df, by, mine, visible, reaches), by)


def settled(readings: DataFrame, cfg: Settings = Settings(), reaches: int = REACHES) -> DataFrame:
    """Readings with amounts settled in the order of reading: named fighters' first, then those of "Unknown" among all of a clip
    that have a fighter. Readings without a fighter take no part. seq must tell a clip's readings apart.

    Both folds go over a few columns alone; whole readings meet the amounts of both at the end.
    """
    known = readings.where("fighter is not null and fighter <> ''").select(*COMPANY, "seq", "t", "amount", "flags")
    first = staged(changes(known, COMPANY, F.col("fighter") != "Unknown", cfg.visible, reaches).select("clip_id", "seq", "now"))
    second = changes(put(known, first, ["clip_id"]), ["clip_id"], F.col("fighter") == "Unknown", cfg.visible, reaches)
    return put(readings, staged(first.unionByName(second)), ["clip_id"])
