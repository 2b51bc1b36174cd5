"""Queries that answer for all features of the vectors."""

from __future__ import annotations

import pytest

from prowave.plans import registry


@pytest.mark.parametrize("name", ["rpca_bases", "reuse_push", "pca_push"])
def test_all_features(spark, data, name):
    got = {r["feat"] for r in registry.QUERIES[name](spark, data).select("feat").distinct().collect()}
    assert len(got) == (61 if name == "rpca_bases" else 64)
