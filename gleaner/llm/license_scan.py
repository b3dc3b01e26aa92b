"""License scan: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

One automaton over each text's lower-cased words, joined by single spaces, finds notice phrases. One over the lower-cased
text finds identifier tags; what follows a tag on its line, up to the next tag, is read as an expression of identifiers,
and, or, with and brackets, put into postfix order by a shunting yard and evaluated against the known identifiers. The work
on a text grows with its length and number of places, however many tags or phrases one line holds.

Defined results: a null text counts as empty and has no places; rows are independent, so repeated rows get equal results and
an empty table gives none; an expression that doesn't parse yields the known identifiers in it and no verdict; one without a
known licence counts as none; whole texts are read at any length; other columns are not looked at. The score is 1 where an
expression names a known licence, else 1 - 1 / 2**n for n notices.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import LOWER, NOT_WORD, sliced

#: The phrases that the contract names, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method's own, as words, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "sil open font license": "ofl",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "open data commons": "odc",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "wtfpl": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the apache license": "apache",
    "this program is free software": "gpl",
    "proprietary and confidential": "proprietary",
    "creative commons zero": "cc0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifiers as in expressions, lower case, and whether each allows reuse without further terms.
KNOWN = {
    "mit": True, "apache-2.0": True, "bsd-2-clause": True, "bsd-3-clause": True, "isc": True, "cc0-1.0": True, "unlicense": True, "zlib": True,
    "cc-by-4.0": True, "cc-by-3.0": True, "mpl-2.0": False, "gpl-2.0": False, "gpl-2.0-only": False, "gpl-2.0-or-later": False, "gpl-3.0": False,
    "gpl-3.0-only": False, "gpl-3.0-or-later": False, "lgpl-2.1": False, "lgpl-2.1-only": False, "lgpl-2.1-or-later": False, "lgpl-3.0": False,
    "lgpl-3.0-only": False, "lgpl-3.0-or-later": False, "agpl-3.0": False, "agpl-3.0-only": False, "agpl-3.0-or-later": False, "epl-2.0": False,
    "0bsd": True, "bsl-1.0": True, "mit-0": True, "postgresql": True, "python-2.0": True, "psf-2.0": True, "wtfpl": True, "x11": True, "ncsa": True, "ms-pl": True,
    "apache-1.1": True, "bsd-4-clause": True, "artistic-2.0": True, "afl-3.0": True, "cc-by-2.0": True, "cc-by-2.5": True, "cc-pddc": True, "unicode-3.0": True, "upl-1.0": True,
    "epl-1.0": False, "mpl-1.1": False, "cddl-1.0": False, "cddl-1.1": False, "eupl-1.1": False, "eupl-1.2": False, "osl-3.0": False, "ms-rl": False, "ofl-1.1": False,
    "gpl-1.0": False, "gpl-1.0-only": False, "gpl-1.0-or-later": False, "lgpl-2.0": False, "lgpl-2.0-only": False, "lgpl-2.0-or-later": False, "agpl-1.0": False,
    "gfdl-1.3": False, "gfdl-1.3-only": False, "gfdl-1.3-or-later": False, "odbl-1.0": False, "sspl-1.0": False, "busl-1.1": False, "elastic-2.0": False,
    "cc-by-sa-2.0": False, "cc-by-sa-2.5": False, "cc-by-sa-3.0": False, "cc-by-nc-3.0": False, "cc-by-nd-3.0": False, "cc-by-nc-sa-3.0": False, "cc-by-nc-nd-3.0": False,
    "cc-by-sa-4.0": False, "cc-by-nc-4.0": False, "cc-by-nd-4.0": False, "cc-by-nc-sa-4.0": False, "cc-by-nc-nd-4.0": False,
}
#: Exceptions that lift the terms that the licence before "with" would set on a combined work.
EXCEPTIONS = {"classpath-exception-2.0": True, "llvm-exception": True, "gcc-exception-3.1": True, "bison-exception-2.2": True}
BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
#: Bytes to spaces where they are no part of a word, and A-Z to a-z.
_WORDS = bytes(0x20 if NOT_WORD[i] else int(LOWER[i]) for i in range(256))
_LOWER = bytes(int(x) for x in LOWER)


def postfix(text: str) -> list[str] | None:
    """The expression at the start of a text in postfix order by a shunting yard; None where it is none.

    It ends before the first token that can't follow, as prose may stand after it on the line.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in BINDS:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            if not operand_next:
                break
            out.append(token.rstrip("."))
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[bool, set[str]]:
    """Whether the expression allows reuse without further terms, and the known identifiers in it."""
    stack: list[bool] = []
    found: set[str] = set()
    for token in order:
        if token in BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token in ("or", "with") else a and b)
        else:
            name = token.removesuffix("+")
            found |= {name} & (KNOWN.keys() | EXCEPTIONS.keys())
            stack.append(KNOWN.get(name, EXCEPTIONS.get(name, False)))
    return stack[0], found


@lru_cache(maxsize=1)
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in BASE_PHRASES.keys() | PHRASES.keys():
        phrases.add_word(f" {p} ", p)
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> dict:
    """All that one text shows: places of base phrases, labels, expressions with their verdicts, score."""
    phrases, tags = _automata()
    low = (text or "").encode().translate(_LOWER).decode()
    words = [w for w in low.encode().translate(_WORDS).split(b" ") if w]
    line = b"".join((b" ", b" ".join(words), b" ")).decode()
    base, own, at = set(), set(), []
    notices = blanks = read = 0
    for end, phrase in phrases.iter(line):  # in order of their ends, so blanks are counted once
        notices += 1
        if phrase in BASE_PHRASES:
            base.add(BASE_PHRASES[phrase])
            blanks, read = blanks + line.count(" ", read, end + 1), end + 1
            at.append(blanks - phrase.count(" ") - 2)
        if phrase in PHRASES:
            own.add(PHRASES[phrase])
    expressions = []
    found = [(end + 1, end + 1 - len(tag)) for end, tag in tags.iter(low)]
    for (begin, _), (_, following) in zip(found, [*found[1:], (0, len(low))]):
        stop = low.find("\n", begin, following)
        shown = low[begin : following if stop < 0 else stop]
        if (order := postfix(shown)) is None:
            own |= {t for t in (x.rstrip(".") for x in _TOKEN.findall(shown)) if t in KNOWN}
        else:
            free, names = evaluate(order)
            own |= names
            if names & KNOWN.keys():  # words after a tag that name no licence are prose
                expressions.append((" ".join(order), free))
    score = 1.0 if expressions else 1 - 0.5**notices
    return {
        "n_words": len(words), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | own)), "score": score,
        "expressions": ",".join(x for x, _ in expressions), "reusable": all(v for _, v in expressions) if expressions else None,
    }


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("reusable", pa.bool_())])


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each document with what its whole text shows."""

    def run(batches):
        for batch in sliced(batches):
            found = [scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {n: [x[n] for x in found] for n in SCHEMA.names[1:]}, schema=SCHEMA)

    spec = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, reusable boolean"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, spec)
