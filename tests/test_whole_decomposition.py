"""Decompositions over all rows against the same in memory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prowave.operators import decomp
from prowave.plans import registry


def test_all_rows_count(spark):
    n = 60_000
    wide = spark.range(n).select("id", F.array(*[((F.col("id") * k) % 7 - 2.0).cast("double") for k in (1, 2, 3)]).alias("embedding"))
    i = np.arange(n)
    x = np.stack([(i * k) % 7 - 2.0 for k in (1, 2, 3)], 1)
    assert decomp.singular_values(wide, 3) == pytest.approx(np.linalg.svd(x, compute_uv=False))


def test_rsvd_query(spark, data):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()], float)
    got = [r["value"] for r in registry.QUERIES["rsvd"](spark, data).orderBy("turn").collect()]
    assert got == pytest.approx(np.linalg.svd(x, compute_uv=False)[:8])


def test_pursuit_over_rows(spark):
    """The rows' version gives what the one in memory gives; few gross errors on a matrix of rank 2 are found."""
    rng = np.random.default_rng(5)
    truth = rng.standard_normal((200, 2)) @ rng.standard_normal((2, 60))
    errors = np.where(rng.random(truth.shape) < 0.03, rng.choice([-20.0, 20.0], truth.shape), 0.0)
    errors[rng.random(200) < 0.08, 7] = 20.0
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(truth + errors)], "id long, embedding array<double>").repartition(3)
    low, sparse = decomp.robust_pca(truth + errors, rounds=20, tolerance=1e-4)
    got = decomp.sparse_norms(wide, rounds=20, tolerance=1e-4)
    assert got == pytest.approx(np.linalg.norm(sparse, axis=0), rel=1e-9)
    low, sparse = decomp.robust_pca(truth + errors, rounds=300, tolerance=1e-5)
    assert np.linalg.norm(truth + errors - low - sparse) <= 1e-5 * np.linalg.norm(truth + errors)
    assert np.linalg.norm(low - truth) <= 1e-3 * np.linalg.norm(truth) and np.linalg.norm(sparse, axis=0).argmax() == 7
    least, theta = decomp.principal_bases(wide, 2)
    assert 7 not in least and theta.count() == 2 * 58
    assert decomp.sparse_norms(wide.limit(0)).size == 0


def test_weights_by_least_deviations(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5))
    x[:, 3] = 2 * x[:, 0] - x[:, 1]
    x[rng.random(300) < 0.1, 3] += 50  # gross errors don't move the weights
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    theta = decomp.deviation_weights(wide, [0, 1], 20)
    assert theta[:, 3] == pytest.approx([2, -1], abs=1e-3)
    assert theta[:, [0, 1]] == pytest.approx(np.eye(2), abs=1e-6)


def test_bases_query(spark, data):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()], float)
    norms = np.linalg.norm(decomp.robust_pca(x, rounds=decomp.ROUNDS)[1], axis=0)
    got = registry.QUERIES["rpca_bases"](spark, data).toPandas()
    assert set(got["base"]) == set(np.argsort(norms)[:3].tolist()) and len(got) == 61 * 3
