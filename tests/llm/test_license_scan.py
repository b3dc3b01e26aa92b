import re

import pytest

from gleaner.llm import license_scan as ls


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in ls.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "CC BY", "cc by cc by", "xcc by", "All rights reserved. ALL RIGHTS\nRESERVED all rights reserved", "GNU General-Public   License v3",
    "é CC BY-NC 4.0 is not ccby", "cc byé", "general public general public license", "all rights " * 3000 + "reserved",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_against_brute_force(text):
    got = ls.scan(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base(text)
    assert 0 <= got["score"] <= 1 and set(got["base_labels"].split(",")) <= set(got["labels"].split(",")) | {""}


@pytest.mark.parametrize(
    "text, order",
    [
        ("mit", ["mit"]),
        ("mit or apache-2.0 and isc", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("(mit or apache-2.0) and isc", ["mit", "apache-2.0", "or", "isc", "and"]),
        ("gpl-2.0-only with classpath-exception-2.0 or mit", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"]),
        ("mit. this file is free", ["mit"]),
        ("mit or", None),
        ("(mit", None),
        ("or mit", None),
        ("", None),
    ],
)
def test_shunting_yard(text, order):
    assert ls.postfix(text) == order


def test_verdicts():
    of = lambda t: ls.evaluate(ls.postfix(t))[0]
    assert of("mit or gpl-3.0-only") and not of("mit and gpl-3.0-only") and of("gpl-2.0-only with classpath-exception-2.0") and not of("unknown-1.0")


def test_tags():
    got = ls.scan("// SPDX-License-Identifier: (MIT OR GPL-3.0-only)\nx")
    assert got["labels"] == "gpl-3.0-only,mit" and got["reusable"] and got["score"] == 1.0
    assert ls.scan("SPDX-License-Identifier: MIT OR")["labels"] == "mit"


def test_tags_on_one_line():
    got = ls.scan("spdx-license-identifier: mit or isc spdx-license-identifier: gpl-3.0-only SPDX-License-Identifier: bsd-3-clause and\nzlib")
    assert got["expressions"] == "mit isc or,gpl-3.0-only" and not got["reusable"]
    assert got["labels"] == "bsd-3-clause,gpl-3.0-only,isc,mit"


def test_one_long_line_of_many_places():
    n = 60_000
    got = ls.scan("CC BY, spdx-license-identifier: mit or; " * n)
    assert (got["n_base"], got["first_word"], got["last_word"]) == (n, 0, 7 * (n - 1)) and got["n_words"] == 7 * n
    assert got["labels"] == "cc-by,mit"


def test_frame(docs, rows, none):
    got = sorted((str(r.doc_id), r.n_words) for r in ls.scanned(docs).collect())
    assert got == sorted((str(r[0]), base(r[1])[0]) for r in rows) and ls.scanned(none).count() == 0


@pytest.mark.parametrize("text", ["SPDX-License-Identifier: banana", "License-Expression: see the file", "SPDX-License-Identifier: x AND y"])
def test_words_that_name_no_licence_are_no_expression(text):
    got = ls.scan(text)
    assert got["score"] == 0.0 and got["reusable"] is None and got["labels"] == "" and got["expressions"] == ""
