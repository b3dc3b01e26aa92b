import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def test_symmetric_qr_agrees_with_the_library():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33, 64):
        a = rng.normal(size=(n, n)) @ np.diag(rng.uniform(0.1, 9, n)) @ rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-13)
        assert np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-12 * values[0])
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([3.0, 0.0, 3.0]), np.ones((6, 6))):
        values, vectors = whitening.eigen(a)
        assert np.allclose(vectors.T @ np.diag(values) @ vectors, a, atol=1e-13)


def test_states_merge_as_if_streamed_at_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 7)) * [1, 2, 3, 4, 5, 6, 7] + 100_000
    parts = []
    for part in np.split(x, [13, 13, 200]):
        parts.append(whitening.Moments(7))
        parts[-1].update(part)
    for other in parts[1:]:
        parts[0].merge(other)
    assert parts[0].n == 500 and np.allclose(parts[0].covariance(), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ base / 5).tolist()) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[9][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [None] + [1.0] * 11), (904, [math.nan] + [1.0] * 11), (905, [math.inf] + [1.0] * 11)]
    return spark.createDataFrame(rows + bad, SCHEMA).withColumns({"n": F.lit("x"), "whitened": F.lit(1)}).repartition(9), rows


def test_against_plain_arithmetic(spark, vectors):
    df, rows = vectors
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    cov = np.cov(x.T.astype(float), bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    far = ((n * x - s).astype(object) ** 2).sum(1)
    want = (x - s / n) @ v / np.sqrt(e)
    got = whitening.report(df)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = got.collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {c: None for c in range(1, 9)}
    for i, row in enumerate(rows):
        for c in range(1, 9):
            r = by[row[0], c][0]
            assert r["deviation"] == far[i] and math.isclose(r["explained"], e[c - 1] / cov.trace(), rel_tol=1e-9)
            sign[c] = sign[c] or (1 if (r["whitened"] > 0) == (want[i, c - 1] > 0) else -1)
            assert math.isclose(r["whitened"], sign[c] * want[i, c - 1], rel_tol=1e-7, abs_tol=1e-8)


def test_own_columns_stay(spark, vectors):
    df, rows = vectors
    out = whitening.whitened(df, whitening.fit(df))
    assert out.columns[:4] == df.columns and out.count() == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.report(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_flat_dimensions_and_huge_entries(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 3) * 1e3]) for i in range(60)]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} <= {1, 2} and all(r["identity_error"] < 1e-4 for r in got)
    huge = whitening.report(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])], SCHEMA)).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge} == {1: None, 2: None, 3: 2048**2 + 3072**2}
