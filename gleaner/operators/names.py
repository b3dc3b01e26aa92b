"""Names: the roster of each clip from the frequency of what was read, and every reading's place in it.

Likeness is checked for few pairs: words are found for each other by an index of their letters, as a pair can only reach a
likeness if it has letters enough in common, and are then bounded by their common letters and pairs of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import text
from gleaner.functions.similarity import ratio
from gleaner.sources.staging import staged

#: Letters of words, rare ones first; where the index begins to look.
RARE_FIRST = "zqxjkvbpgwyfmucdhlrsnoate"
#: Likeness of most misreadings to their name: a word that finds one so near needn't look for others less near.
NEAR = 0.8


def frequencies(readings: DataFrame) -> DataFrame:
    """(clip_id, name, n, first) of actors and targets that may be names, without "You"."""
    both = F.explode(F.array(F.struct(F.col("who").alias("name"), F.lit(0).alias("i")), F.struct(F.col("target").alias("name"), F.lit(1).alias("i")))).alias("x")
    df = readings.select("clip_id", "seq", both).select("clip_id", F.col("x.name").alias("name"), (F.col("seq") * 2 + F.col("x.i")).alias("at"))
    fair = F.col("name").isNotNull() & (F.col("name") != "You") & ~text.is_junk(F.col("name"))
    return df.where(fair).groupBy("clip_id", "name").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def cut_in_word(full: Column, tail: Column) -> Column:
    """Whether a tail of a name begins within a word of it, going by capitals; a tail that isn't one, or is all of it, by its own first letter."""
    begin = F.length(full) - F.call_function("locate", F.reverse(F.lower(tail)), F.reverse(F.lower(full))) - F.length(tail) + 2
    inside = F.contains(F.lower(full), F.lower(tail)) & (begin > 1)
    return F.when(inside, F.substr(full, begin, F.lit(1)).rlike("^[a-z]")).otherwise(tail.rlike("^[a-z]"))


def _numbered(parts: Column) -> Column:
    """The parts of a word, each with how often it has stood by then, so that what two words have in common is a set."""
    return F.transform(parts, lambda x, i: F.concat((9 - F.least(F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: y == x)), F.lit(9))).cast("string"), x, F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: y == x)).cast("string")))


def indexed(words: DataFrame, word: str, cutoff: float) -> DataFrame:
    """The words' letters and pairs of letters, and a row for each letter by which a word as like as the cutoff can be found.

    Two words of s and t letters that are so like have cutoff * (s + t) / 2 letters in common at least, and t is no less than
    cutoff * s / (2 - cutoff); so of each word's letters, rare ones first, it takes all but that many, and one more.
    """
    ranked = F.translate(F.col(word), RARE_FIRST, "abcdefghijklmnopqrstuvwxyz"[: len(RARE_FIRST)])
    df = words.withColumn("__letters", F.array_sort(_numbered(F.filter(F.split(ranked, ""), lambda x: x != ""))))
    twos = F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(F.col(word), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__pairs", _numbered(twos))
    n = F.size("__letters")
    least = F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9).cast("int")
    return df.withColumn("__first", F.slice("__letters", 1, F.greatest(n - least + 1, F.lit(0)))).withColumn("__token", F.explode("__first"))


def bound(letters: Column, others: Column, pairs: Column, other_pairs: Column) -> Column:
    """What the likeness of two words is at most.

    Blocks hold no more letters than the words have in common. With M letters in k blocks they have M - k pairs in common,
    and between two blocks at least one letter is in none, so k is s + t - 2 M + 1 at most.
    """
    both = F.size(letters) + F.size(others)
    most = F.least(F.size(F.array_intersect(letters, others)), F.floor((F.size(F.array_intersect(pairs, other_pairs)) + both + 1) / 3))
    return F.lit(2.0) * most / both


def alike(words: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """(clip_id, word, other, ratio): pairs of a clip's (distinct) words and others whose likeness reaches the cutoff."""
    x = indexed(words.select("clip_id", "word"), "word", cutoff)
    y = indexed(others.select("clip_id", "other"), "other", cutoff)
    y = y.select("clip_id", "other", F.col("__letters").alias("__l"), F.col("__pairs").alias("__p"), F.col("__first").alias("__f"), "__token")
    once = F.get(F.array_intersect("__first", "__f"), F.lit(0)) == F.col("__token")
    met = x.join(y, ["clip_id", "__token"]).where(once & (bound(F.col("__letters"), F.col("__l"), F.col("__pairs"), F.col("__p")) >= cutoff - 1e-9))
    met = staged(met.select("clip_id", "word", "other"))
    pairs = met.select("word", "other").distinct()  # clips have many pairs in common
    exact = pairs.withColumn("ratio", ratio("word", "other")).where(F.col("ratio") >= cutoff)
    return met.join(exact, ["word", "other"]).select("clip_id", "word", "other", "ratio")


def conflicts(fair: DataFrame, cfg: Settings) -> DataFrame:
    """(clip_id, name, by): the names that a name falls to, should they be true ones.

    It falls to one before it in order that is much alike, or that it is the beginning of or a tail cut out of, if that one was
    read several times as often.
    """
    a = fair.select("clip_id", "name", "n", "first", "key")
    k = fair.select("clip_id", F.col("name").alias("by"), F.col("n").alias("__n"), F.col("first").alias("__first"), F.col("key").alias("__key"))
    keys = fair.select("clip_id", F.col("key").alias("word")).distinct()
    near = alike(keys, keys.withColumnRenamed("word", "other"), cfg.anchor_fold)
    before = (F.col("__n") > F.col("n")) | (F.col("__n") == F.col("n")) & ((F.col("__first") < F.col("first")) | (F.col("__first") == F.col("first")) & (F.col("by") < F.col("name")))
    much = near.join(a.withColumnRenamed("key", "word"), ["clip_id", "word"]).join(k.withColumnRenamed("__key", "other"), ["clip_id", "other"]).where(before)
    often = F.col("__n") >= F.col("n") * cfg.fragment_ratio
    parts = lambda of: k.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("__key")), of)))
    front = a.join(parts(lambda i: F.left("__key", i)), ["clip_id", "key"]).where(often)
    back = a.join(parts(lambda i: F.right("__key", i)), ["clip_id", "key"]).where(often & cut_in_word(F.col("by"), F.col("name")))
    found = [df.select("clip_id", "name", "by") for df in (much, front, back)]
    return found[0].unionByName(found[1]).unionByName(found[2]).where("name <> by").distinct()


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of the nodes (clip_id, name), taken in order, those that fall to none of the ones already taken.

    edges (clip_id, name, by) lead to earlier nodes. In each round a node is out if one that it falls to is in, and in if all of
    those are out; so rounds are as many as the longest chain of nodes that depend on each other, not as many as nodes.
    """
    state = staged(nodes.join(edges.select("clip_id", "name").distinct().withColumn("__open", F.lit(True)), ["clip_id", "name"], "left").select("clip_id", "name", F.when(F.col("__open"), F.lit(0)).otherwise(F.lit(1)).alias("state")))
    while not state.where("state = 0").isEmpty():
        of = state.select("clip_id", F.col("name").alias("by"), F.col("state").alias("__s"))
        told = edges.join(of, ["clip_id", "by"]).groupBy("clip_id", "name").agg(F.max(F.col("__s") == 1).alias("__falls"), F.max(F.col("__s") == 0).alias("__waits"))
        now = F.when(F.col("state") != 0, F.col("state")).when(F.col("__falls"), F.lit(2)).when(F.col("__waits"), F.lit(0)).otherwise(F.lit(1))
        state = staged(state.join(told, ["clip_id", "name"], "left").select("clip_id", "name", now.alias("state")))
    return state.where("state = 1").select("clip_id", "name")


def anchors(named: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(clip_id, key, canonical): the true names of each clip, by their folded form.

    They are the roster, or else the names read often enough (the most frequent one where none is) that fall to no other.
    """
    if cfg.roster:
        place = {}
        for name in cfg.roster:
            place[name] = len(place)
        listed = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("canonical")) for name, i in place.items()])).alias("x")
        rows = named.select("clip_id").distinct().select("clip_id", listed).select("clip_id", "x.*").withColumn("key", text.norm(F.col("canonical")))
        return rows.groupBy("clip_id", "key").agg(F.max_by("canonical", "at").alias("canonical"))  # of two with one key the last
    top = named.groupBy("clip_id").agg(F.max("n").alias("__most"), F.min(F.struct((-F.col("n")).alias("n"), "first", "name")).alias("__top"))
    fair = named.join(top, "clip_id").where((F.col("n") >= cfg.anchor_min) | (F.col("__most") < cfg.anchor_min) & (F.col("name") == F.col("__top.name"))).select(*named.columns)
    fair = staged(fair)
    kept = first_independent(fair.select("clip_id", "name"), staged(conflicts(fair, cfg)))
    return fair.join(kept, ["clip_id", "name"], "left_semi").select("clip_id", "key", F.col("name").alias("canonical"))


def name_map(counts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(clip_id, reading, canonical): the anchor that each counted name stands for, or null.

    That is the one with the name's own folded form, or else the likest one, of equals the last in the alphabet.
    """
    named = staged(counts.withColumn("key", text.norm(F.col("name"))))
    of = staged(anchors(named, cfg))
    rest = named.select("clip_id", F.col("key").alias("word")).distinct().join(of.select("clip_id", F.col("key").alias("word")), ["clip_id", "word"], "left_anti")
    others, found = of.select("clip_id", F.col("key").alias("other")), of.select("clip_id", F.col("key").alias("word"), F.col("key").alias("other"))
    for cutoff in sorted({max(NEAR, cfg.name_cutoff), cfg.name_cutoff}, reverse=True):
        near = staged(alike(rest, others, cutoff).groupBy("clip_id", "word").agg(F.max(F.struct("ratio", "other")).alias("__best")).select("clip_id", "word", F.col("__best.other").alias("other")))
        found, rest = found.unionByName(near), rest.join(near, ["clip_id", "word"], "left_anti")
    to = found.join(of.withColumnRenamed("key", "other"), ["clip_id", "other"]).select("clip_id", F.col("word").alias("key"), "canonical")
    return named.join(to, ["clip_id", "key"], "left").select("clip_id", F.col("name").alias("reading"), "canonical")


def canonical(readings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Readings with canonical names; names that are junk or like no anchor become null."""
    to = staged(name_map(frequencies(readings), cfg))
    for column in ("who", "target"):
        own = to.select("clip_id", F.col("reading").alias(column), F.col("canonical").alias("__c"))
        fixed = F.col(column).isNull() | F.col(column).isin("You", "")
        readings = readings.join(own, ["clip_id", column], "left").withColumn(column, F.when(fixed, F.col(column)).otherwise(F.col("__c"))).drop("__c")
    fighter = F.when(F.col("dir") == "in", F.col("who")).otherwise(F.col("target"))
    return readings.withColumn("fighter", fighter)
