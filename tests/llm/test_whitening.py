"""Whitening against numpy's eigenvectors: conditioning, vectors without variance, unusable rows, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, deviation int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def wanted(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    rows = (n * x - s) / n
    values, directions = np.linalg.eigh(rows.T @ rows / n)
    return ((n * x - s) ** 2).sum(1), rows, values[::-1], directions[:, ::-1]


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_whitening_equals_eigenvectors(spark, spread):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(400, 12)) * spread ** (np.arange(12) / 11) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    vectors = (mixed * 30).tolist()
    vectors[7] = vectors[8]
    df = frame(spark, vectors + [None, [np.nan] * 12, [None] * 12, [np.inf] + [0.0] * 11, [1.0], []]).repartition(5)
    model = whitening.fit(df)
    deviations, rows, values, directions = wanted(vectors)
    assert model.n == 400 and np.allclose(model.variances, values, rtol=1e-9)
    got = whitening.whiten(df, model, components=8).orderBy("vec_id")
    assert got.columns == ["vec_id", "embedding", "label", "whitened", "deviation"]
    out = got.collect()
    assert [r.deviation for r in out] == deviations.tolist()
    found = np.array([r.whitened for r in out])
    exact = rows @ directions[:, :8] / np.sqrt(values[:8])
    assert np.abs(found * np.sign((found * exact).sum(0)) - exact).max() < 1e-6
    assert whitening.identity_error(got, 8).first()[0] < 1e-9
    assert np.allclose(model.explained, values / values.sum(), rtol=1e-9)


def test_directions_without_variance(spark):
    rng = np.random.default_rng(2)
    plane = rng.normal(size=(100, 2)) @ rng.integers(-4, 5, (2, 5))
    whole = np.round(plane[:, :2]) @ rng.integers(1, 4, (2, 5))  # exactly two directions after rounding down
    model = whitening.fit(frame(spark, whole.tolist()))
    assert model.rank == 2
    rows = whitening.whiten(frame(spark, whole.tolist()), model)
    assert all(len(r.whitened) == 5 and r.whitened[2:] == [None] * 3 for r in rows.collect())
    assert whitening.identity_error(rows, 5).first()[0] < 1e-9
    same = frame(spark, [[1.0, 2.0]] * 30)
    model = whitening.fit(same)
    assert model.rank == 0 and model.explained == [None, None]
    assert {(tuple(r.whitened), r.deviation) for r in whitening.whiten(same, model).collect()} == {((None, None), 0)}


def test_entries_beyond_double_precision(spark):
    vectors = [[1e12, 1.0], [-1e12, 2.0], [5e11, 3.0]]
    df = frame(spark, vectors)
    model = whitening.fit(df)
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    assert model.sums == sums
    exact = [sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [r.deviation for r in whitening.whiten(df, model).orderBy("vec_id").collect()] == [
        e if e < 2**63 else None for e in exact
    ]


def test_empty_table_and_query(spark, tmp_path):
    none = frame(spark, [None, []])
    model = whitening.fit(none)
    assert model.n == 0 and whitening.whiten(none, model).count() == 0
    for name, df in (("none", none), ("some", frame(spark, np.eye(4).tolist() * 3))):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    assert whitening.op11_whitening(spark, f"{tmp_path}/none").count() == 0
    rows = whitening.op11_whitening(spark, f"{tmp_path}/some").collect()
    assert len(rows) == 48 and {r.component for r in rows} == {1, 2, 3, 4} and {r.n for r in rows} == {12}
    assert all(r.whitened is None for r in rows if r.component == 4)
    assert np.isclose(sum({r.component: r.explained for r in rows if r.component < 4}.values()), 1)
