"""Near-duplicate classes of large groups whose members differ from each other."""

from __future__ import annotations

import random

import pytest

from prowave.llm import near_dedup

SCHEMA = "doc_id long, text string"


def test_links_within_a_large_bucket_are_found(spark):
    """x is 0.8 similar to y alone, and y to the bucket's head: a chain, in buckets of many texts."""
    rng = random.Random(3)
    hub = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    rows = [(0, " ".join(hub))]
    for i in range(60):
        y = list(hub)
        places = rng.sample(range(1, 39), 9)
        y[places[0] * 10] = f"y{i}"
        x = list(y)
        for p in places[1:]:
            x[p * 10] = f"x{i}_{p}"
        x[3] = f"x{i}"  # 44 of 396 k-mers differ from y: 352 / (792 - 352) = 0.8
        rows += [(100 + i, " ".join(y)), (200 + i, " ".join(x))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: 0 for i, _ in rows}


def test_unlike_texts_of_one_bucket_stay_apart(spark, monkeypatch):
    """Texts that share a bucket but no link: every round of heads ends, and none are joined."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10_000)}" for _ in range(60)])) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i for i, _ in rows}


def _changed(words: list[str], places: list[int], tag: str) -> list[str]:
    out = list(words)
    for p in places:
        out[p] = f"{tag}_{p}"
    return out


@pytest.mark.parametrize("block", [256, 30])
def test_pairs_of_one_family(spark, monkeypatch, block):
    """Texts of one original, all in the same buckets, of which hardly any but planted pairs are 0.8 similar: brute force finds no other links."""
    from test_operators import jaccard_classes

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
    rows = []
    for i in range(100):
        places = rng.sample(range(400), 9)
        pair = _changed(base, places[:3], f"p{i}")
        rows += [(2 * i, " ".join(_changed(pair, places[3:6], f"a{i}"))), (2 * i + 1, " ".join(_changed(pair, places[6:], f"b{i}")))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = jaccard_classes([(i, t, None) for i, t in rows])
    assert got == want and len(set(want.values())) > 50


def test_a_drifting_group_is_one_class(spark):
    """Each text is 0.8 similar to the one before and to the one after alone."""
    rng = random.Random(7)
    now, rows = [f"w{rng.randrange(100_000)}" for _ in range(400)], []
    for i in range(60):
        rows.append((i, " ".join(now)))
        now = _changed(now, [(37 * i + 50 * j) % 400 for j in range(8)], f"d{i}")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: 0 for i, _ in rows}


def test_long_texts(spark):
    """Texts of tens of thousands of words are aligned whole."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(100_000)}" for _ in range(30_000)]
    near, far = list(words), list(words)
    near[100:600] = []
    near[20_000] = "other"
    far[5000:15_000] = [f"x{i}" for i in range(10_000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
