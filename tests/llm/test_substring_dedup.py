import hashlib

import numpy as np
import pytest

from gleaner.llm import substring_dedup as sd


def brute(rows):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - sd.K + 1):
            if i is not None:
                x = tuple(w[k : k + sd.K])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - sd.K + 1):
            if i is not None and least[tuple(w[k : k + sd.K])] < i:
                gone |= set(range(k, k + sd.K))
        line = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(line).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [sd.LIMIT, 1, 2000])
def test_against_brute_force(docs, rows, limit):
    got = sd.kept(docs, sd.removed(docs, bin_bytes=4000, limit=limit)).collect()
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_equal_hashes_are_told_apart(docs, rows, monkeypatch):
    monkeypatch.setattr(sd, "_ODD", np.zeros(sd.K, np.uint64))
    strings = [b" ".join(b"%d" % (i * 100 + k) for k in range(14)) for i in range(3)] + [b" ".join(b"%d" % k for k in range(1, 15))]
    found, first, count = sd.least_docs(strings, np.array([5, 6, 7, 2]))
    assert found.tolist() == [5, 2, 6, 6, 7, 7, 2, 2] and first.tolist() == [0, 2, 4, 6] and count.tolist() == [2, 2, 2, 2]


def test_pack_round_trip():
    got = sd.unpack(sd.pack([b"a b", b"c"], np.array([0, 1, 0]), np.array([-5, 2**40, 3]), np.array([1, 2**32 - 1, 0], np.uint32), np.array([0, 9, 2])))
    assert got[0] == [b"a b", b"c"] and [x.tolist() for x in got[1:]] == [[0, 1, 0], [-5, 2**40, 3], [1, 2**32 - 1, 0], [0, 9, 2]]


def test_empty(none):
    assert sd.report(none).count() == 0
