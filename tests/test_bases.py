import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import bases, encoders


def samples(spark, n=40, d=6, clients=2):
    draw = np.random.default_rng(3)
    return spark.createDataFrame([(i % clients, i, draw.normal(size=d).tolist()) for i in range(n)], "client int, y int, w array<double>")


def test_gram_is_the_product(spark):
    df = samples(spark)
    m = np.array([r.w for r in df.collect()])
    assert np.allclose(bases.matrix(bases.gram(df)), m.T @ m)


def test_top_basis_is_orthonormal_and_best():
    draw = np.random.default_rng(0)
    m = draw.normal(size=(50, 8)) * np.arange(1, 9)
    cov = m.T @ m
    b = bases.top_basis(cov, 3)
    assert np.allclose(b.T @ b, np.eye(3))
    energy = np.trace(b.T @ cov @ b)
    for seed in range(5):
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(8, 3)))[0]
        assert np.trace(q.T @ cov @ q) <= energy + 1e-6


def test_signs_are_canonical():
    b = bases.canonical_signs(np.array([[0.1, -0.5], [-0.9, 0.5]]))
    assert b[1, 0] > 0 and b[0, 1] > 0


def test_nothing_gives_zero_or_unit_vectors():
    assert np.abs(bases.top_basis(np.zeros((4, 4)), 2)).max() == 0
    b = bases.top_basis(np.zeros((4, 4)), 2, reference=np.eye(4)[:, :2], fill=True)
    assert np.allclose(b.T @ b, np.eye(2)) and np.allclose(b[:2], 0)


def test_personal_bases_are_orthogonal_to_the_shared_one(spark):
    df = samples(spark)
    common, extra, energy = bases.shared_basis(df, 1, 1)
    ref = np.hstack([common, extra])
    own = bases.per_client(df, "client", "w", 2, ref).orderBy("client", "r").collect()
    assert len(own) == 4 and 0 < energy <= 1
    for c in (0, 1):
        b = np.array([r.b for r in own if r.client == c]).T
        assert np.allclose(b.T @ b, np.eye(2)) and np.allclose(ref.T @ b, 0)
    assert np.isclose(bases.principal_angle(ref, ref), 0, atol=1e-4)


def test_completion_reaches_the_rank():
    b = bases.complete(np.zeros((5, 0)), 5)
    assert np.allclose(b.T @ b, np.eye(5))


def test_projection(spark):
    df = samples(spark)
    b = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))[0]
    got = bases.project(df, b, "w", "z").select("w", "z").collect()
    assert np.allclose([np.linalg.norm(r.w) for r in got], [np.linalg.norm(r.z) for r in got])
    assert df.select(F.size("w")).first()[0] == 6


def test_policies_and_random_completion(spark):
    draw = np.random.default_rng(4)
    m = draw.normal(size=(3, 6))
    rows = spark.createDataFrame([(1, y, r.tolist()) for y, r in enumerate(m)], "client int, y int, w array<double>")
    for policy in ("gram", "reduced_svd", "full_svd"):
        b = np.array([r.b for r in bases.per_client(rows, "client", "w", 5, policy=policy).orderBy("r").collect()]).T
        assert np.allclose(b.T @ b, np.eye(5), atol=1e-8)
        assert np.allclose(np.abs(np.linalg.svd(m)[2][:3] @ b[:, :3]), np.eye(3), atol=1e-6)
    with pytest.raises(ValueError):
        bases.per_client(rows, "client", "w", 5, policy="half")
    one = bases.orthonormal(draw.normal(size=(6, 2)))
    full = bases.complete(one, 5, seed=3)
    assert np.allclose(full.T @ full, np.eye(5)) and np.array_equal(full, bases.complete(one, 5, seed=3)) and not np.allclose(full, bases.complete(one, 5))


def test_groups_and_fitted_encoders(spark):
    for mode in ("contiguous_partition", "random_partition"):
        assert sorted(np.concatenate(encoders.group_masks(mode, 11, 3)).tolist()) == list(range(11))
    assert [len(g) for g in encoders.group_masks("random_topk", 11, 3, topk=4)] == [4, 4, 4]
    with pytest.raises(ValueError):
        encoders.group_masks("none", 3, 1)
    draw = np.random.default_rng(1)
    w = draw.normal(size=(6, 12))
    rows = spark.createDataFrame([(i, int(i % 2), (draw.normal(size=6) + i % 2).tolist()) for i in range(40)], "sample int, y int, x array<double>")
    plain = encoders.PackedEncoder(w, "random_partition", 3, seed=2).encode(rows)
    assert all(np.isclose(np.linalg.norm(r.h), 1, atol=1e-6) for r in plain.collect())
    learned = encoders.PackedEncoder(w, "mlp", 2, topk=3)
    with pytest.raises(RuntimeError):
        learned.encode(rows)
    assert learned.fit(rows, 2).encode(rows).count() == 40


def test_right_vectors_span_the_leading_directions(spark):
    draw = np.random.default_rng(4)
    left, _ = np.linalg.qr(draw.normal(size=(300, 40)))
    right, _ = np.linalg.qr(draw.normal(size=(40, 40)))
    m = left @ np.diag([50.0, 40, 30, 20, 10, *(1e-3 * 0.9 ** np.arange(35))]) @ right.T
    df = spark.createDataFrame([(row.tolist(),) for row in m] + [(None,)], "w array<double>").repartition(40)  # a tree of two levels
    values, basis = bases.right_vectors(df, 5)
    _, exact, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(values, exact[:5], rtol=1e-9)
    assert np.degrees(np.linalg.norm(basis - vt[:5].T @ (vt[:5] @ basis), 2)) < 1e-6  # sine of the largest angle
    assert np.allclose(basis, bases.canonical_signs(vt[:5].T), atol=1e-6)
    assert bases.right_vectors(df.where("false"), 5)[1].shape == (0, 0)
    assert np.allclose(bases.covariance(df), m.T @ m)


def test_group_relevance():
    first, second = np.array([[1.0, 0, 2, 0], [0, 3, 0, 0], [1, 0, 0, -4]]), np.array([[1.0, -1], [2, 0], [0, 0], [1, 1]])
    masks, shares = encoders.group_relevance(first, second, 2, 1)  # units 0 and 2, 1 and 3
    assert [m.tolist() for m in masks] == [[0], [2]] and np.allclose(shares, [2 / 9, 7 / 9])
