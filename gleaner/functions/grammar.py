"""The grammar of combat lines: nine shapes, of which the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed as X
from gleaner.functions.columns import computed
from gleaner.functions.text import is_weapon, tidy_name

_END = X.GAP + X.FOR + X.GAP + X.NUMBER
_TO_YOU = X.GAP + X.YOU + _END
_MOB = "(?:" + "|".join(X.MOB_VERBS) + ")"

#: The shapes in order of precedence.
HEAL_IN = X.NAME + X.POSSESSIVE + X.SPELL + r"\s*" + X.HEAL + _TO_YOU
HEAL_NAMELESS = r"\b" + X.SPELL + r"\s*" + X.HEAL + _TO_YOU
HEAL_BY_SPELL = r"\byour\s*" + X.SPELL + r"\s*" + X.HEAL + r"\s+" + X.NAME + _END
HEAL_OUT = r"\b" + X.YOU + r"\s+" + X.HEAL + r"\s+" + X.NAME + _END
HIT_BY_SPELL = r"\byour\s*" + X.SPELL + r"\s*" + X.HIT + X.GAP + X.NAME + _END
HIT_OUT = r"\b" + X.YOU + r"\s*" + X.HIT + X.GAP + X.NAME + _END
HIT_BY_THING = X.NAME + X.POSSESSIVE + r"([A-Za-z]{2,18})\s*" + X.HIT + r"s?" + _TO_YOU
HIT_BY_DAMAGED_THING = X.NAME + r"[^A-Za-z0-9\n]{0,4}([A-Za-z][A-Za-z']{1,17})\s+" + X.HIT + r"(?![sz])" + _TO_YOU
HIT_IN = X.NAME + r"(?:\s+[A-Za-z]{3,12}ly)?(?:\s+(?:" + X.HITS + r"?|" + _MOB + r")|(?:" + X.HITS + r"|" + _MOB + r"))" + _TO_YOU

#: For each shape: pattern, kind, dir, group of the other's name (0: not told), group of the ability, and what can reject it.
SHAPES = (
    (HEAL_IN, "heal", "in", 1, 2, False),
    (HEAL_NAMELESS, "heal", "in", 0, 1, False),
    (HEAL_BY_SPELL, "heal", "out", 2, 1, True),
    (HEAL_OUT, "heal", "out", 1, 0, True),
    (HIT_BY_SPELL, "hit", "out", 2, 1, False),
    (HIT_OUT, "hit", "out", 1, 0, False),
    (HIT_BY_THING, "hit", "in", 1, 2, False),
    (HIT_BY_DAMAGED_THING, "hit", "in", 1, 2, True),
    (HIT_IN, "hit", "in", 1, 0, True),
)
#: Shapes whose actor may be the weapon left of a lost name.
ARMED = (7, 8)

_HEALS_YOU, _HITS_YOU = X.HEAL + _TO_YOU, X.HIT + r"s?" + _TO_YOU
#: What a line must have for each shape, without the names whose length is open: tests that take one pass over a line.
NEEDED = (
    _HEALS_YOU, _HEALS_YOU, X.HEAL + r"\s+[A-Za-z]", X.HEAL + r"\s+[A-Za-z]", r"\byour\s*[A-Za-z]", r"\b" + X.YOU + r"\s*" + X.HIT,
    _HITS_YOU, X.HIT + r"(?![sz])" + _TO_YOU, r"(?:" + X.HITS + r"?|" + _MOB + r")" + _TO_YOU,
)


def shape(body: Column) -> Column:
    """The place in SHAPES of the first that fits and isn't rejected for naming you; null if none does."""
    out = None
    for i, (pattern, kind, _, name, _, picky) in enumerate(SHAPES):
        fits = body.rlike("(?i)" + NEEDED[i]) & body.rlike("(?i)" + pattern)
        if picky:
            own = F.regexp_replace(F.regexp_extract(body, "(?i)" + pattern, name), r"[^A-Za-z0-9_'\-]", "")
            fits = fits & ~own.rlike("^(?i)you")
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out


def _of(shape_: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shape_ + 1)


def other_name(body: Column, shape_: Column) -> Column:
    """The name on the line besides yours, as it stands there."""
    out = F.when(shape_ == 0, F.regexp_extract(body, "(?i)" + HEAL_IN, 1))
    for i, (pattern, _, _, name, _, _) in enumerate(SHAPES):
        if i and name:
            out = out.when(shape_ == i, F.regexp_extract(body, "(?i)" + pattern, name))
    return out


def ability(body: Column, shape_: Column) -> Column:
    out = F.when(shape_ == 0, F.regexp_extract(body, "(?i)" + HEAL_IN, 2))
    for i, (pattern, _, _, _, group, _) in enumerate(SHAPES):
        if i and group:
            out = out.when(shape_ == i, F.regexp_extract(body, "(?i)" + pattern, group))
    return F.trim(out)


def told(df: DataFrame, body: str, place: str) -> DataFrame:
    """Rows with what their shape says: kind, dir, who, target, fighter and ability."""
    s = F.col(place)
    df = computed(df, __raw=other_name(F.col(body), s), ability=ability(F.col(body), s), kind=_of(s, [x[1] for x in SHAPES]), dir=_of(s, [x[2] for x in SHAPES]))
    df = computed(df, __name=F.when(F.col("__raw").isNull(), F.lit("Unknown")).otherwise(tidy_name(F.col("__raw"))))
    df = computed(df, fighter=F.when(s.isin(*ARMED) & is_weapon(F.col("__name")), F.lit("Unknown")).otherwise(F.col("__name")))
    you, incoming = F.lit("You"), F.col("dir") == "in"
    return df.withColumn("who", F.when(incoming, F.col("fighter")).otherwise(you)).withColumn("target", F.when(incoming, you).otherwise(F.col("fighter")))
