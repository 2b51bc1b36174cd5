"""Operators on small tables: brute force, nulls, empty tables, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from prowave.llm import ann, decontaminate, html_extract, line_dedup, mixing, near_dedup, quality, secret_scan, substring_dedup, url_filter

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id int, size string, gone string, score int, path int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Rows of (doc_id, text, source), beside nulls and clashing columns, over several partitions."""
    return spark.createDataFrame([(i, t, "en", s, None, "r", 1, "x", "g", 7, 3) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = text(26), "All rights reserved, see the license."
    rows = []
    for i in range(120):
        t = text(rng.randrange(5, 120))
        if i % 5 == 0:
            t = text(10) + " " + passage + " " + text(10)
        if i % 3 == 0:
            t += "\n" + line
        rows.append((i, t, f"s{i % 16}" if i % 17 else None))
    for i in range(120, 150):  # copies, exact and near
        w = WORD.findall(rows[i - 119][1])
        if i % 2 and len(w) > 40:
            w[20] = "changed"
        rows.append((i, " ".join(w), "s0"))
    rows += [(200, None, "s1"), (201, "", None), (202, " \n\t ", "s2"), (203, "one", "s3"), (204, "word " * 5000, "s4"), (205, "one", "s5"), (3, rows[3][1], rows[3][2])]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_dedup(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r["doc_id"]: r for r in substring_dedup.dedup(table(spark, corpus)).collect()}
    seen, want = {}, {}
    for i, t in sorted({(i, t or "") for i, t, _ in corpus}):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in got.items()} == want
    assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in got.values())
    assert sum(n for _, n, _ in want.values()) > 500
    assert substring_dedup.dedup(table(spark, corpus)).count() == len(corpus)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_one_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(25)), " ".join(f"b{i}" for i in range(25))
    got = substring_dedup.dedup(table(spark, [(1, a, "s"), (1, b, "s"), (None, a, "s"), (None, None, "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 0, 0), (0, 25, 0), (1, 25, 0), (1, 25, 25)]
    got = near_dedup.classes(table(spark, [(1, a, "s"), (1, b, "s"), (None, a, "s"), (None, None, "s")])).collect()
    assert len(got) == 4 and sorted(r["keep"] for r in got) == [False, True, True, True]


def jaccard_classes(rows):
    seq = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        seq[i] = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
    ids = sorted(seq)
    label = {g: n for n, g in enumerate({g for s in seq.values() for g in s})}
    arr = {i: np.array([label[g] for g in seq[i]], np.uint64) for i in ids}
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near_dedup.aligned(arr[a], arr[b]) >= 0.8:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [256, 2])
def test_near_dedup(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = {r["doc_id"]: r for r in near_dedup.classes(table(spark, corpus)).collect()}
    want = jaccard_classes(corpus)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(want) - 10
    kept = near_dedup.keep_one(table(spark, corpus), ("doc_id", "text", "source")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))  # equal rows once
    assert near_dedup.classes(empty(spark)).count() == 0
    alone = near_dedup.classes(table(spark, [(1, "a b c d e f", "s"), (2, "g h i j k l", "s")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["keep"]) for r in alone) == [(1, 1, True), (2, 2, True)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_chains_and_hubs_are_one_component(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "LINKS_PER_TASK", most)
    node = lambda i: (i, 0)
    pairs = [(node(i), node(i + 1)) for i in range(40)] + [(node(100), node(i)) for i in range(101, 130)]
    links = spark.createDataFrame(pairs, "u struct<_id:long,_of:long>, v struct<_id:long,_of:long>")
    got = {r["node"]["_id"]: r["label"]["_id"] for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_line_dedup(spark, corpus):
    got = line_dedup.dedup(table(spark, corpus), keep=("source",), min_sites=10).collect()
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(corpus, key=lambda r: r[0]):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                sites[x].add(s)
                first[x] = min(first.get(x, (i, k)), (i, k))
    want = Counter()
    for i, t, s in corpus:
        parts = [] if t is None else t.split("\n")
        left = [x for k, x in enumerate(parts) if not (x.strip(" ") and len(sites[x]) >= 10 and first[x] != (i, k))]
        want[(i, None if t is None else "\n".join(left), s, len(parts), len(parts) - len(left))] += 1
    assert Counter(map(tuple, got)) == want
    assert sum(r["n_removed"] for r in got) > 20
    assert line_dedup.dedup(empty(spark)).count() == line_dedup.digest(empty(spark)).count() == 0


def test_mixing(spark, corpus):
    got = mixing.copies(table(spark, corpus)).collect()
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, rest, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    goal |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    by_id = {i: s for i, _, s in corpus}
    assert len(got) == len(corpus)
    for r in got:
        s = by_id[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (sizes[s], pytest.approx(goal[s]))
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    longest = max(r["size"] for r in got if by_id[r["doc_id"]] != "s4")
    assert all(abs(taken[s] - goal[s]) <= 2 * longest for s in names if s != "s4")
    again = mixing.copies(table(spark, corpus).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.emit(table(spark, corpus), ("doc_id", "text", "source"))
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.copies(empty(spark)).count() == mixing.emit(empty(spark), ("doc_id",)).count() == 0


@pytest.mark.parametrize("block", [200_000, 1])
def test_decontamination(spark, corpus, block):
    shared = " ".join(WORD.findall(corpus[5][1])[8:30]).upper()
    items = [(1, shared), (2, shared), (3, "one"), (4, None), (5, "..."), (None, "two words"), (12, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[p : p + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t, _ in corpus:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    got = decontaminate.search(table(spark, corpus), bench, keep=("source",), cut=True, block_windows=block)
    assert Counter(map(tuple, got.drop("row", "text").collect())) == want
    assert sum(k[5] for k in want) > 10
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[200] is None and texts[203] == "" and shared.lower() not in (texts[5] or "").lower()
    for i, t, _ in corpus:
        if i not in (3, 203, 205) and not any(k[0] == i and k[5] for k in want):
            assert texts[i] == t
    assert decontaminate.search(empty(spark), bench).count() == 0
    assert decontaminate.search(table(spark, corpus), bench.limit(0)).filter("contaminated").count() == 0


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[50:80] = x[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(None, x[0].tolist(), 1), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] * 16, 1), (906, [1.0] * 3, 1), (907, [], 1)]
    schema = "vec_id long, embedding array<float>, rank int"
    t = spark.createDataFrame(rows + bad, schema)
    got = defaultdict(list)
    for r in ann.search(t, t.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q in got:
        s = np.zeros(300)
        for d in range(16):
            s += y[q, d] * y[:, d]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert got[q] == [(i, s[i]) for i in best]
    few = spark.createDataFrame(rows[:5], schema)
    assert ann.search(few, few.filter("vec_id = 0")).count() == 4
    assert ann.search(t.limit(0), t).count() == ann.search(t, t.limit(0)).count() == 0


def test_ann_recall(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet")
    q = t.filter("vec_id % 20 = 0")
    assert ann.recall(ann.search(t, q, depth=100), t, q) >= 0.9


def test_ann_in_passes(spark, monkeypatch):
    """Many rows beyond DEPTH, more queries than a pass takes, one vector that a third of the rows have."""
    monkeypatch.setattr(ann, "PASS", 60)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50_000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5).cache()
    q = t.filter("vec_id % 400 = 7")
    found = ann.search(t, q).cache()
    got = {(r["query_id"], r["rank"]): r for r in found.collect()}
    assert len(got) == 125 * 20
    asked = np.arange(7, 50_000, 400)
    score = x[asked].astype(float) @ x.astype(float).T
    score[np.arange(125), asked] = -9
    right = 0
    for i, a in enumerate(asked.tolist()):
        top = np.lexsort((np.arange(50_000), -score[i]))[:20]
        right += len(set(top.tolist()) & {got[a, k]["vec_id"] for k in range(1, 21)})
        assert all(got[a, k]["score"] >= got[a, k + 1]["score"] for k in range(1, 20))
    assert right >= 0.95 * 125 * 20
    assert {(r["query_id"], r["rank"]): r for r in ann.search(t.repartition(3), q).collect()} == got


def test_html_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "e"), (None, None, None, "e"), (1, "u", "<article><p>x</p></article>", "e")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.extract(t).collect()), key=str) == sorted([(1, "u", "x", 1), (None, None, "", 0), (1, "u", "x", 1)], key=str)
    assert html_extract.extract(t.limit(0)).count() == 0


def test_urls(spark):
    urls = {
        1: ("http://A.Example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        3: ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        4: ("https://b.net/de/?x", "b.net", "/de/", "net/de/", "allow"),
        5: ("https://org?/es/", "org", "", None, None),
        6: ("https://notexample.com#/en/7", "notexample.com", "", None, None),
        7: ("no scheme/en/", "", "", None, "block"),
        8: (None, "", "", None, "block"),
        9: ("", "", "", None, "block"),
        10: ("http://u:p@É.com:80/en/a://b", "u:p@É.com:80", "/en/a://b", None, None),
        11: ("http://org/es/\n?a", "org", "/es/\n", "org/es/", "block"),
        12: ("://net/de/", "net", "/de/", "net/de/", "allow"),
    }
    t = spark.createDataFrame([(i, u[0], "h", 1) for i, u in urls.items()] * 2, "page_id long, url string, host string, rule int")
    got = url_filter.judge(t).collect()
    assert len(got) == 24
    for r in got:
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(t.limit(0)).count() == 0


def test_url_models_tell_sites_apart(spark):
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(6))
    rows = [(i, f"https://{word('abcde')}.net/de/{i}" if i % 2 else f"https://{word('vwxyz')}.com/en/{i}") for i in range(600)]
    rows += [(1000 + i, f"https://{word('abcde' if i % 2 else 'vwxyz')}.info/xx/{i}") for i in range(60)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(60)) >= 54


def test_quality(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).drop("row")
    pairs = got.join(labels, "doc_id").select("held_out", "quality", "predicted").collect()
    right = [r["quality"] == r["predicted"] for r in pairs if r["held_out"]]
    assert sum(right) >= 0.8 * len(right)
    assert got.filter("score < 0 or score > 1 or isnan(score)").count() == 0
    odd = table(spark, [(None, None, None), (1, "", "a"), (1, "", "b"), (2, "x " * 20000, "c")])
    out = quality.score(odd, labels, keep=("source", "score"), with_text=True).collect()
    assert len(out) == 4 and len({r["score"] for r in out if not r["text"]}) == 1
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0


def test_secrets(spark):
    texts = ['aa token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" bb', "a card 4929348385146306 was used", None, "", "x" * 100000]
    got = secret_scan.scan(table(spark, [(i, t, None) for i, t in enumerate(texts)] * 2)).collect()
    assert sorted((r["doc_id"], r["start"], r["secret"]) for r in got) == [(0, 12, True)] * 2 + [(1, 7, False)] * 2
    assert secret_scan.scan(empty(spark)).count() == 0
