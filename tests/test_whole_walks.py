"""Cached walks without a limit on hops or neighbours."""

from __future__ import annotations

import numpy as np

from prowave.operators import walks


def test_walks_go_on_until_the_coin_stops_them(spark):
    n, alpha = 4000, 0.4
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    hops = np.array([(r["end_id"] - r["id"]) % n for r in walks.walk_cache(ring, alpha).collect()])
    assert len(hops) == n
    for k in range(1, 9):
        p = alpha * (1 - alpha) ** (k - 1)
        assert abs((hops == k).sum() - n * p) <= 5 * np.sqrt(n * p)
    assert (hops > 8).any()


def test_a_hub_keeps_its_walks_apart(spark):
    hub = spark.createDataFrame([(0, i) for i in range(2, 5002)] + [(1, 9000)], "src long, dst long")
    got = sorted(map(tuple, walks.walk_cache(hub, 0.2).collect()))
    assert [(i, k) for i, k, _ in got] == [(0, k) for k in range(5000)] + [(1, 0)] and got[-1][2] == 9000
    ends = {e for _, _, e in got[:-1]}
    assert ends <= set(range(2, 5002)) and 2900 < len(ends) < 3400  # of 5000 random picks with repeats
