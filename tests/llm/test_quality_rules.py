import re
from collections import Counter

from gleaner.llm import quality_rules as q


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_against_brute_force(docs, rows):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.report(docs).collect())
    assert got == sorted((r[0] or -1, *base(r[1])) for r in rows)


def test_kept_needs_the_base(docs):
    assert all(not r.kept for r in q.report(docs).collect() if r.base_failed)


def test_overlapping_and_first_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 3), (2, "x " * 9), (3, "a b c d e f g h i")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in q.report(df).collect()} == {1: 24, 2: 9, 3: 0}


def test_ablation_counts_what_only_a_rule_removes(docs):
    led = q.ledger(docs).cache()
    bits = [r.fail_bits & q.mask(q.POLICIES["web", 2]) for r in led.collect()]
    for r in q.ablation(led, "web", 2).collect():
        bit = 1 << [n for n, _ in q.RULES].index(r.rule)
        assert (r.failed, r.only_this, r.kept) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b == 0 for b in bits))


def test_versions_stay(docs):
    first = q.apply_policy(q.ledger(docs), "web", 1).where("kept").count()
    assert first >= q.apply_policy(q.ledger(docs), "web", 2).where("kept").count()


def test_empty(none):
    assert q.report(none).count() == 0
