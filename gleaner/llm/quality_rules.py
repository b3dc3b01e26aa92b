"""Rule bitmask ledger [native].

Each rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit i says that
rule i failed. A policy is a named, versioned mask of rules; applying one, or leaving a rule out of one, is bitwise
arithmetic on the ledger and never reads a text again.

Defined results: a null or empty text has no words and fails the rule too_few_words; documents with any number of rows,
repeated or not, get a row each; other columns of the input are not looked at; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored

#: (name, failed as a condition on the measurements). Bit i of a ledger is rule i; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("odd_word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    ("shouting", "n_words > 0 and 2 * n_upper > word_chars"),
    ("exclaiming", "4 * n_exclaims > n_words and n_words > 0"),
)
BASE = ("too_few_words", "repeated_windows")
#: Policies by (name, version); a later version never changes an earlier one.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): BASE,
    ("web", 1): (*BASE, "symbol_heavy", "repeated_lines"),
    ("web", 2): (*BASE, "symbol_heavy", "repeated_lines", "odd_word_length", "shouting", "exclaiming"),
}
WINDOW = 8
_BLANKS = "[\\x20\\x09-\\x0D]+"


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in set(rules))


def _tail(values: Column, skip: int) -> Column:
    return F.slice(values, F.lit(skip + 1), F.greatest(F.size(values) - skip, F.lit(0)))


def _head(values: Column, less: int) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - less, F.lit(0)))


def _windows(df: DataFrame, values: str, to: str, join) -> DataFrame:
    """Column to: an entry for each window of 8, neighbours joined to 2, to 4, to 8.

    Each step is a column of its own: written as one expression, every use of a step would work it out again. The last
    7 entries join what is left; having fewer words, each equals no other entry.
    """
    for step in (1, 2, 4):
        v = F.col(values)
        df = df.withColumn(to, F.zip_with(v, _tail(v, step), join))
        values = to
    return df


def _covered(df: DataFrame, words: str, to: str) -> DataFrame:
    """Words within windows whose text stands twice or more: equal windows meet by sorting, then come their places."""
    df = _windows(df, words, "__texts", lambda a, b: F.concat_ws(" ", a, b))
    df = df.withColumn("__placed", F.sort_array(F.transform("__texts", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    p = F.col("__placed")
    pair = lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(F.zip_with(_head(p, 1), _tail(p, 1), pair)))))
    at = F.col("__at")
    gaps = F.zip_with(_head(at, 1), _tail(at, 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x))
    return df.withColumn(to, covered.cast("long")).drop("__texts", "__placed", "__at")


def measured(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and all measurements; the text is split into words and lines once."""
    df = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    t = F.col("__text")
    df = df.withColumn("__bare", F.trim(F.regexp_replace(t, _BLANKS, " ")))
    df = df.withColumn("__words", F.when(F.col("__bare") == "", F.array().cast("array<string>")).otherwise(F.split("__bare", " ")))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    lines, words = F.size("__lines"), F.size("__words")
    df = df.select(
        *keys,
        "__words",
        words.cast("long").alias("n_words"),
        F.when(words == 0, 0).otherwise(F.length("__bare") - words + 1).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_lines"),
        (lines - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.regexp_replace(t, "[!?]", ""))).cast("long").alias("n_exclaims"),
    )
    # Equal windows have equal codes; where no code stands twice the texts of the windows needn't be built.
    df = _windows(df, "__words", "__codes8", lambda a, b: F.xxhash64(a, b))
    doubled = F.size(F.array_distinct("__codes8")) < F.size("__codes8")
    df = df.withColumn("__doubled", F.when(doubled, F.col("__words")).otherwise(F.array().cast("array<string>")))
    df = _covered(df, "__doubled", "n_repeat_words")
    return df.drop("__words", "__codes8", "__doubled")


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Measurements and fail_bits of each document, each rule evaluated once."""
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, keys, text).withColumn("fail_bits", bits)


def apply_policy(of: DataFrame, name: str, version: int) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return of.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[name, version])).cast("long")) == 0)


def ablation(of: DataFrame, name: str, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it removes, so that are kept without it."""
    held = mask(POLICIES[name, version])
    tally = of.groupBy(F.col("fail_bits").bitwiseAND(F.lit(held).cast("long")).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (rule, _) in enumerate(RULES) if held >> i & 1])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return tally.select("bits", "count", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_this"),
        F.sum(F.when(F.col("bits") == 0, F.col("count")).otherwise(0)).alias("kept"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: the base measurements, the base verdict and that of the newest web policy.

    The ledger is stored once; verdicts and ablations are read from it.
    """
    out = apply_policy(stored(ledger(docs)), "web", 2)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0).alias("base_failed"),
        "kept", "fail_bits", "n_lines", "n_upper", "n_exclaims",
    )


def ablations(docs: DataFrame) -> DataFrame:
    """For each policy and each of its rules: what fails it, what it alone removes, what the policy keeps; from a stored ledger."""
    of, out = stored(ledger(docs)), None
    for name, version in POLICIES:
        one = ablation(of, name, version).select(F.lit(name).alias("policy"), F.lit(version).alias("version"), "rule", "failed", "only_this", "kept")
        out = one if out is None else out.unionByName(one)
    return out
