"""The words, classes and patterns of the log's language, which results depend on."""

CHANNELS = ("combat", "nave", "local", "global", "say", "yell", "guild", "party", "whisper", "help", "trade")

WEAPONS = (
    "arrow", "arrows", "bolt", "bolts", "dagger", "sword", "axe", "mace", "spear", "javelin", "hammer", "bow", "blade", "lance", "club",
    "staff", "knife", "pike", "halberd", "shield", "fist", "fists",
)

TAGS = (
    "Torso", "Head", "Arm", "Arms", "Hand", "Hands", "Leg", "Legs", "Foot", "Feet", "Left Limb", "Right Limb", "Lower Body", "Upper Body",
    "Parry", "Blocked", "Handle", "Equipment", "Impale", "Sting", "Armor Pierced", "Counter Reduced", "Spread Shot", "Forceful Strike",
    "Off-Hand", "Snap Shot", "Hack", "Underhew", "Sling Thrust", "Piercing Shot", "Resist", "Mind",
)

BODY_PARTS = ("torso", "head", "arms", "arm", "legs", "leg", "hands", "hand", "feet", "foot", "left", "right", "lower", "upper", "parry", "blocked")

MOB_VERBS = (
    "bites", "slashes", "mauls", "slices", "claws", "stings", "gores", "pecks", "kicks", "stomps", "crushes", "smashes", "strikes", "swipes",
    "rams", "charges", "tramples", "rips", "tears", "punches", "headbutts", "lashes", "chomps", "bashes", "stabs",
)

#: Letter pairs and digits that stand for letters, folded in this order.
NORM_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("vy", "w"))
NORM_DIGITS = ("05821", "osbzl")
#: Letters that stand for digits.
DIGIT_LETTERS = ("SsOoIilZzBGq", "550011122869")

MAX_DIGITS = 3

CLOCK = r"(\d{1,2})\s*[:.]\s*(\d{2})\s*[:.]\s*(\d{2})"
TAG = r"[\[\(\{]([A-Za-z][A-Za-z0-9 .,'’!\-]{1,18})[\]\)\}]"
NAME = r"([A-Za-z][A-Za-z0-9_'\-\(\) ]{1,22}?)"
SPELL = r"([A-Za-z][A-Za-z']{1,13}(?:\s+[A-Za-z][A-Za-z']{1,13})?)"
HIT = r"[hlnbk]i[tf]"
HITS = r"[hlnbk]i[tf][sz]"
HEAL = r"[hn]ea[lI][sz5]?"
YOU = r"y[o0p]u"
FOR = r"f[o0][ri]"
GAP = r"[\s@#.,:;'\"\-]*"
POSSESSIVE = r"\s*['’;:]\s*s\s*"
NUMBER = r"[0-9SsOoIilZzBGq]{1,4}"
AMOUNT = FOR + "(" + GAP + r")([0-9SsOoIilZzBGq'’]{1,8})([^0-9\n]{0,3})"
COMBAT_LINE = r"(?i)\b(?:hits?|lit|nit)\b.{0,40}?\bfor\b"
