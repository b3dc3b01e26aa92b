import random
import zlib

import numpy as np
import pyarrow as pa

from gleaner.llm import quality_classifier as qc


def made(words, n=300, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        if not good:
            w = [[x + "$$$" for x in w], [w[0]] * len(w), [x.upper() + "!!" for x in w]][i % 3]
        docs.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, words):
    docs, labels = made(words)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.report(d, y).collect()}
    assert len(got) == len(docs)
    known = {i: q for i, q, _ in labels}
    held = [i for i in known if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([got[i].predicted == known[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in qc.report(d, other).collect()} == {i: r.score for i, r in got.items()}


def test_features_do_not_cross_texts():
    one = [f.tolist() for f in qc.feature_lists(pa.array(["abc abc", None, "", "x", "abc abc"]))]
    assert one[0] == one[4] == qc.feature_lists(pa.array(["abc abc"]))[0].tolist() and one[1] == one[2] == one[3] == []


def test_odd_inputs(spark, docs, rows, none):
    y = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = qc.report(docs, y).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 for r in got)
    assert qc.report(none, y).count() == 0 and qc.accepted(docs, y.limit(0)).columns == docs.columns


def test_one_row_of_a_repeated_doc_id_is_learnt_from(spark, words, monkeypatch):
    docs, labels = made(words, 60)
    learnt = []
    real = qc.fit
    monkeypatch.setattr(qc, "fit", lambda own, y, **more: learnt.append(len(own)) or real(own, y, **more))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = docs + [(7, f"another text {i}") for i in range(200)]
    models = [qc.trained(spark.createDataFrame(rows, "doc_id long, text string"), y) for rows in (more, more[::-1])]
    known = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert 7 in known and learnt == [len(known)] * 2
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1:] == models[1][1:]


def test_working_names_of_the_operator_may_be_columns(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    wide = docs.select(F.lit("u").alias("__score"), "doc_id", "text", F.lit("v").alias("__id"), F.lit("w").alias("a.b"))
    got = qc.accepted(wide, labels)
    assert got.columns == wide.columns and all((r["__score"], r["__id"], r["a.b"]) == ("u", "v", "w") for r in got.collect())


def test_labels_without_documents_use_up_no_sample(spark, words, monkeypatch):
    monkeypatch.setattr(qc, "SAMPLE", 40)
    said = [(i, " ".join(words[(i * 7 + k) % 400] for k in range(30)) + (" good" * 9 if i % 2 else " BAD!!" * 9)) for i in range(60)]
    df = spark.createDataFrame(said, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(20_000)], "doc_id long, quality int, toxic int")
    right = sum(r.predicted == r.doc_id % 2 for r in qc.report(df, labels).collect())
    assert right >= 55
