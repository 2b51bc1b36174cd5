"""The language models against plain dictionaries of counts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from prowave.llm import url_filter as u


def plain_scores(rows):
    """Score by page id of (id, url, verdict of a rule or None)."""
    grams, contexts = Counter(), Counter()
    parts = lambda url: [(b, [None] * max(0, 4 - i) + list(url[max(0, i - 4) : i])) for i, b in enumerate(url)]
    for _, url, verdict in rows:
        raw = url.encode()
        if verdict and zlib.crc32(raw) % 5:
            for b, before in parts(raw):
                for k in range(5):
                    context = tuple(before[4 - k :])
                    grams[verdict, k, context, b] += 1
                    contexts[verdict, k, context] += 1

    def log_p(verdict, b, before):
        p = 1 / 256
        for k in range(5):
            context = tuple(before[4 - k :])
            p = (grams[verdict, k, context, b] + u.SMOOTHING * p) / (contexts[verdict, k, context] + u.SMOOTHING)
        return math.log(p)

    return {i: sum(log_p("allow", *x) - log_p("block", *x) for x in parts(url.encode())) / max(1, len(url.encode())) for i, url, _ in rows}


def test_scores_and_threshold(spark, monkeypatch):
    monkeypatch.setattr(u, "SLICE_BYTES", 3000)
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(500):
        kind = i % 3
        rows.append((i, f"https://{word('abcde' if kind else 'vwxyzé')}.{['com/en', 'net/de', 'info/xx'][kind]}/{word('abcxyz')}", ["block", "allow", None][kind]))
    rows += [(500, "", None), (501, "a", None), (502, "https://" + "long" * 5000 + ".info/", None)]
    t = spark.createDataFrame([(i, url, "h") for i, url, _ in rows] * 2, "page_id long, url string, host string").repartition(3)
    got = {r["page_id"]: r for r in u.judge(t).collect()}
    want = plain_scores([r for r in rows for _ in range(2)])
    assert all(got[i]["score"] == pytest.approx(want[i], abs=1e-9) for i, *_ in rows)
    held = [(want[i], v == "allow") for i, url, v in rows if v and zlib.crc32(url.encode()) % 5 == 0]
    accuracy = lambda cut: sum((s >= cut) == yes for s, yes in held if yes) / sum(yes for _, yes in held) + sum((s >= cut) == yes for s, yes in held if not yes) / sum(not yes for _, yes in held)
    allowed = [s for i, s in want.items() if got[i]["rule"] is None and got[i]["verdict"] == "allow"]
    blocked = [s for i, s in want.items() if got[i]["rule"] is None and got[i]["verdict"] == "block" and got[i]["host"]]
    assert max(blocked) < min(allowed)
    assert accuracy(min(allowed)) >= max(accuracy(c) for c, _ in held) - 1e-9


def test_one_kind_alone_tells_nothing(spark):
    t = spark.createDataFrame([(i, f"https://a.net/de/{i}") for i in range(9)] + [(9, "https://b.info/x"), (10, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["score"]) for r in u.judge(t).collect()}
    assert got[9] == ("allow", 0.0) and got[10] == ("block", 0.0) and got[3] == ("allow", 0.0)
