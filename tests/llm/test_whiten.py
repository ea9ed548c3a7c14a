import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsig.llm import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component string"


def plain(vectors):
    """Distinct whole vectors, their moments and an eigendecomposition by another method."""
    x = np.floor(64.0 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = (n * fitted - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def rows_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, 0, "x", "y") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_components_of_degenerate_and_graded_matrices(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    twice = np.diag(np.r_[np.ones(d // 2), np.full(d - d // 2, 2.0)])
    for v in (a @ a.T, np.eye(d), np.ones((d, d)), twice, np.zeros((d, d)), a[:, :1] @ a[:, :1].T):
        values, vectors = whiten.components(v)
        size = max(np.linalg.norm(v), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * size


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-12])
    assert np.allclose(whiten.polar(a), np.diag([1, -1, 1, -1]), atol=1e-10)


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((400, 20)) @ rng.standard_normal((20, 20))).tolist()
    vectors += vectors[:40] + [vectors[0]] * 100  # a third of the rows is repeated
    got = whiten.whitened(rows_of(spark, vectors), "vec_id", "embedding").toPandas()
    x, n, sums, values, comps = plain(vectors)
    assert len(got) == len(vectors) * 16 and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (n * x - sums) / n @ comps[:, :16] / np.sqrt(values[:16])
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-8
    shares = got.drop_duplicates("component").sort_values("component")["explained"]
    assert np.allclose(shares, values[:16] / values.sum(), rtol=1e-10)
    deviation = got[got.component == 1].sort_values("vec_id")["deviation"].tolist()
    assert deviation == [sum(int(v) ** 2 for v in n * row - sums) for row in x]


def test_rows_without_a_usable_vector(spark):
    nan, inf = math.nan, math.inf
    vectors = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [0.5, 1.0], [2.0, -1.0], [0.5, 1.0]]
    vectors += [[0.0, 0.0], [1.0, 2.0, 3.0]]
    ids = [0, 1, 2, 3, 4, None, 6, 7, 7, 9]
    got = whiten.whitened(rows_of(spark, vectors, ids), "vec_id", "embedding").collect()
    # Zero vectors take part; another length is a fit of its own.
    assert sorted((r.vec_id or -1, r.component, r.n) for r in got) == sorted(
        [(i, c, 3) for i in (-1, 6, 7, 7) for c in (1, 2)] + [(9, c, 1) for c in (1, 2, 3)]
    )
    alone = [r for r in got if r.vec_id == 9]
    assert all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in alone)
    assert {r.explained for r in alone} == {0.0}


def test_fewer_vectors_than_dimensions(spark):
    got = whiten.whitened(rows_of(spark, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), "vec_id", "embedding").collect()
    by = {c: [r for r in got if r.component == c] for c in (1, 2, 3)}
    assert {round(abs(r.whitened), 12) for r in by[1]} == {1.0}
    assert all(r.whitened is None for r in by[2] + by[3]) and by[1][0].identity_error < 1e-12


def test_empty_table_and_wide_deviation(spark):
    assert whiten.whitened(rows_of(spark, []), "vec_id", "embedding").count() == 0
    model = whiten.Model(10**8, np.array([0, 0]), np.zeros(0), np.zeros((2, 0)), 0.0)
    assert model.deviation(np.array([[100, 0], [3, 4]])) == [None, 25 * 10**16]


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    df = rows_of(spark, rng.standard_normal((64, 4)).tolist())
    one, many = (
        whiten.whitened(df.repartition(k), "vec_id", "embedding").filter(F.col("component") == 1)
        for k in (1, 16)
    )
    a, b = (d.orderBy("vec_id").toPandas() for d in (one, many))
    assert a["deviation"].tolist() == b["deviation"].tolist()
    sign = np.sign((a["whitened"] * b["whitened"]).sum())
    assert np.allclose(a["whitened"], sign * b["whitened"], atol=1e-9)
