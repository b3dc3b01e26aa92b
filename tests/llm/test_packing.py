import binascii
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import packing
from gleaner.llm.common import text_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def whole(encoder, text):
    return [*encoder.of.encode(text or "", add_special_tokens=False).ids, packing.END]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\r  　\u0085ab1'sé漢ß.!\x1c<|>", max_size=40)), max_size=6))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    import pyarrow as pa

    encoder = packing.Encoder(PATH)
    ids, at = encoder.ids(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [whole(encoder, t) for t in texts]


def test_special_tokens_are_ordinary_text(encoder):
    assert len(whole(encoder, "<|endoftext|>")) > 2


def check(pieces, texts, encoder, length=packing.LENGTH):
    """Every id in exactly one piece, sequences without gaps, none padded."""
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(whole(encoder, t))
    got = defaultdict(list)
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"]) and 0 < p["length"] <= length
        got[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    assert set(got) == set(want)
    for i, lists in want.items():
        assert sorted(t for _, ids, _ in got[i] for t in ids) == sorted(t for ids in lists for t in ids)
        if len(lists) == 1:
            at = 0
            for start, ids, total in sorted(got[i]):
                assert start == at and ids == lists[0][at : at + len(ids)] and total == len(lists[0])
                at += len(ids)
            assert at == len(lists[0])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    return sequences


def test_pieces(spark, docs, rows, encoder):
    got = [r.asDict() for r in packing.packed(docs, PATH).collect()]
    check(got, [(r[0], r[1]) for r in rows], encoder)
    told = packing.report(docs, PATH)
    assert told.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in told.collect()), key=key) == sorted(((p["doc_id"], p["start"], p["length"], binascii.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in got), key=key)


def test_many_small_groups(spark, docs, rows, encoder):
    got = [r.asDict() for r in packing.packed(docs, PATH, length=64, group=500).collect()]
    check(got, [(r[0], r[1]) for r in rows], encoder, 64)


def test_one_long_text_and_none(spark, none, encoder):
    text = "word and ünother, " * 60_000
    df = spark.createDataFrame([("a", text), ("b", None), ("b", None)], "doc_id string, text string")
    sequences = check([r.asDict() for r in packing.packed(df, PATH).collect()], [("a", text), ("b", None), ("b", None)], encoder)
    assert sum(max(o + n for o, n in s) == packing.LENGTH for s in sequences.values()) > 100
    assert packing.packed(none, PATH).count() == 0


def test_costs_are_balanced_and_descending():
    rng = np.random.default_rng(1)
    packer = packing.Packer()
    for i in range(3000):
        n = int(rng.integers(1, 900))
        packer.add(i, 0, n, np.zeros(n, np.uint32))
    dealt = list(packer.full())
    costs = defaultdict(float)
    for *_, ids, sequence, _ in dealt:
        costs[sequence] += packing.cost(len(ids))
    assert max(costs.values()) < 1.02 * min(costs.values())
    assert packer.tokens == sum(len(p[3]) for p in packer.waiting) < packing.LENGTH
    # few documents are cut: no more pieces than documents and sequences
    assert len(dealt) <= 3000 + len(costs)
