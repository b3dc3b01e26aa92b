"""Scalar functions on the text of a reading, as columns. ASCII digits, letters and blanks are meant throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed as X


def squeezed(c: Column) -> Column:
    """Blanks at the ends dropped, others single."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clock_seconds(raw: Column) -> Column:
    """Second of the day of the first h:mm:ss in a line; null where there is none or it is out of range."""
    h, m, s = (F.regexp_extract(raw, X.CLOCK, i).try_cast("int") for i in (1, 2, 3))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), (h * 3600 + m * 60 + s).cast("double"))


def after_clock(raw: Column) -> Column:
    """What stands after the first h:mm:ss, valid or not; the whole line where there is none."""
    return F.regexp_replace(raw, "^(?s).*?" + X.CLOCK, "")


def without_channels(c: Column) -> Column:
    """The body without marks before it and without channel words, wherever they stand. Most lines have none of the words."""
    bare = F.regexp_replace(c, r"^[\s(\[{|:.,]+", "")
    out = bare
    for word in X.CHANNELS:
        out = F.regexp_replace(out, rf"(?i)[\[({{]?\s*{word}\s*[\])}}1lI]?", " ")
    return squeezed(F.when(bare.rlike("(?i)" + "|".join(X.CHANNELS)), out).otherwise(bare))


def amount_found(body: Column) -> Column:
    """The stretch of a line that has its number: after a free-standing "for", else after any; null without one."""
    free, any_ = (F.regexp_extract(body, start + X.AMOUNT, 0) for start in (r"(?i)\b", "(?i)"))
    return F.coalesce(F.nullif(free, F.lit("")), F.nullif(any_, F.lit("")))


def eats_bracket(tail: Column, digits: Column) -> Column:
    """Whether the last digit is the bracket before a body part: the part follows at once, or after a gap a 1."""
    gap, word = (F.lower(F.regexp_extract(tail, r"^(\s*)([A-Za-z]{2,})", i)) for i in (1, 2))
    part = reduce(lambda a, b: a | b, [F.startswith(F.lit(p), word) | F.startswith(word, F.lit(p)) for p in X.BODY_PARTS])
    return (word != "") & ((gap == "") | digits.endswith("1")) & part


def amount(body: Column) -> Column:
    """The number of a line; null where it can't be told."""
    return amount_in(amount_found(body))


def amount_in(found: Column) -> Column:
    """The number of what amount_found gave."""
    gap, read, tail = (F.regexp_extract(found, "^(?i)" + X.AMOUNT, i) for i in (1, 2, 3))
    read = F.translate(read, "'’", "")
    crowded = ~gap.rlike(r"\s") & read.rlike(r"^[A-Za-z][0-9]+$")
    read = F.when(crowded, F.substring(read, 2, 8)).otherwise(read)
    digits = F.translate(read, *X.DIGIT_LETTERS)
    sound = digits.rlike(f"^[0-9]{{1,{X.MAX_DIGITS}}}$")
    eaten = ~tail.rlike(r"[\[({]") & (F.length(digits) > 1) & eats_bracket(tail, digits)
    return F.when(sound, F.when(eaten, F.left(digits, F.length(digits) - 1)).otherwise(digits).try_cast("int"))


def tidy_name(c: Column) -> Column:
    """A name's own characters; of an owner and weapon run together, the owner."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_'\-]", "")
    owner, thing = (F.regexp_extract(c, "^(.{2,})'s(.+)$", i) for i in (1, 2))
    return F.when(F.lower(thing).isin(*X.WEAPONS), owner).otherwise(c)


def is_weapon(c: Column, strict: bool = False) -> Column:
    """Whether a word is a weapon's. The letter s and the apostrophe go at both ends first, unless strict."""
    return (F.lower(c) if strict else F.btrim(F.lower(c), F.lit("'s"))).isin(*X.WEAPONS)


def is_junk(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    channel = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in X.CHANNELS])
    return (F.length(low) < 3) | channel | ~low.rlike("[aeiou]")


def norm(c: Column) -> Column:
    """A name with alike glyphs folded, to compare by."""
    c = F.lower(c)
    for pair, one in X.NORM_PAIRS:
        c = F.replace(c, F.lit(pair), F.lit(one))
    c = F.regexp_replace(F.translate(c, *X.NORM_DIGITS), "[^a-z]", "")
    return F.replace(c, F.lit("i"), F.lit("l"))


def one_glyph_off(a: Column, b: Column) -> Column:
    """One character more, less or other; numbers of one character each are never so."""
    return (F.levenshtein(a, b) == 1) & ~((F.length(a) == 1) & (F.length(b) == 1))


def day_shift(offset: Column, middle: Column) -> Column:
    """Whole days that bring a clock offset nearest to the middle one."""
    return F.bround((middle - offset) / 86400.0).cast("long")


def minutes(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def position_percent(t: Column, span: Column) -> Column:
    return F.round(t / span * 100, 2)


def seek_time(t: Column) -> Column:
    return F.greatest(F.lit(0.0), t - 4)


def html_escaped(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def frame_time(name: Column, fps: float) -> Column:
    """Seconds at which a frame was taken, from the number in its name."""
    return (F.regexp_extract(name, r"(\d+)", 1).try_cast("int") - 1) / F.lit(float(fps))


def is_combat_line(c: Column) -> Column:
    return c.rlike(X.COMBAT_LINE)


def tenths(x: Column) -> Column:
    """A number at one decimal, halves to even, judged by its exact binary value.

    8 x and 2 x are exact; their sum is rounded, and what that loses is worked out, so that a sum that looks like a half is told
    from one just beside it.
    """
    a, b = x * 8.0, x * 2.0
    s = a + b
    part = s - a
    lost = (a - (s - part)) + (b - part)
    whole = F.rint(s)
    off = s - whole
    up, down = (off == 0.5) & (lost > 0), (off == -0.5) & (lost < 0)  # rounded down, or up, but in truth beyond the half
    # a half that was rounded to the even side, but lies beyond it
    return (whole + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / 10.0
