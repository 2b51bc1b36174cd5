"""Repeated passages among rows that share an id or have none: rows are told apart by whole hashes of their texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prowave.llm import substring_dedup


@pytest.mark.parametrize("hot", [1000, 3])
def test_thousands_of_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SALTS", 4)
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(6000):
        words = [rng.choice(vocab) for _ in range(25)]
        if i % 7 == 0:
            words[12:12] = passage
        rows.append((None if i % 3 else 5, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup(docs).collect())
    order = sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "text").alias("h")).collect()})
    seen, want = {}, Counter()
    for n, (i, _, t) in enumerate(order):
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (n, p)) != (n, p):
                gone[p : p + 20] = [True] * 20
        want[(None if i < 0 else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert got == want
    assert sum(n for _, _, n, _ in want.elements()) > 20_000
