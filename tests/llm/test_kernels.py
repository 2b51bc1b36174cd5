"""The NumPy parts against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from prowave.llm import ann, decontaminate, near_dedup, quality, secret_scan, substring_dedup
from prowave.llm import textkernel as tk
from prowave.llm.fm_index import FMIndex
from prowave.llm.html_extract import main_text

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n.,7\x00中", max_size=30)), max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words(texts):
    for table, lower, pattern in ((tk.SPACE_WORDS, False, r"[^\x20\x09-\x0D]+"), (tk.ALNUM_WORDS, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        fold = (lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)) if lower else (lambda t: t)
        want = [re.findall(pattern, fold(t or "")) for t in texts]
        got, same = [], {}
        for lo, hi, w in tk.each_slice(pa.array(texts, pa.string()), table, lower, limit=16):
            h = w.hashes()
            for i in range(hi - lo):
                ids = range(w.first[i], w.first[i + 1])
                got.append([w.text(j) for j in ids])
                for j in ids:
                    assert same.setdefault(w.text(j), int(h[j])) == int(h[j])
        assert got == want and len(set(same.values())) == len(same)


def test_sliced_arrow_columns_with_nulls():
    a = pa.array(["x", None, "a b", "", "c"], pa.string()).slice(1, 3)
    (_, _, w), *_ = tk.each_slice(a, tk.SPACE_WORDS)
    assert np.diff(w.first).tolist() == [0, 2, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all(text, patterns):
    index = FMIndex(np.array(text, np.int64), 4)
    padded = np.zeros((len(patterns), 4), np.int64)
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    low, high = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_shard_search_with_short_and_shared_items():
    block = decontaminate.make_block([("1", "a b c d e f g h i j k"), ("2", "Zz"), ("3", "b c d e f g h i j k"), ("4", "...")])
    (_, _, words), *_ = tk.each_slice(pa.array(["x A b C d e f g h i j! k zz y", "zz zz"]), tk.ALNUM_WORDS, lower=True)
    first, size, window = decontaminate.search_shard(words, block)
    assert sorted(zip(first.tolist(), size.tolist(), strict=True)) == [(1, 10), (2, 10), (12, 1), (14, 1), (15, 1)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def test_alignment_is_exact_over_the_threshold():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(3)] = [rng.randrange(30) for _ in range(rng.randrange(3))]
        m = lcs(a, b)
        true = m / (len(a) + len(b) - m)
        got = near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(true) if true >= 0.8 else got < 0.8


def test_order_counts_in_sketches():
    words = [f"w{i}" for i in range(60)]
    half = " ".join(words[30:] + words[:30])
    k, off = near_dedup.kmers(next(tk.each_slice(pa.array([" ".join(words), " ".join(words), half, "a b", "a b c"]), tk.SPACE_WORDS))[2])
    keys, _ = near_dedup.bands(k, off)
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).mean() < 0.6
    assert len({tuple(r) for r in keys.tolist()}) == 4


def test_repeated_kmers_are_labelled():
    k = np.array([5, 5, 7, 5], np.uint64)
    assert len(set(near_dedup.labelled(k, np.zeros(4, np.int64)).tolist())) == 4
    assert len(set(near_dedup.labelled(k, np.array([0, 1, 1, 2])).tolist())) == 2


def test_kept_texts():
    (_, _, w), *_ = tk.each_slice(pa.array([" a  b\tc", None, "d e"]), tk.SPACE_WORDS)
    assert substring_dedup.kept_texts(w, np.array([False, True, True, True, False])) == [b"b c", b"", b"d"]


def test_quantiser_recall_and_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware, plain = ann.Quantiser.fit(x, 0.3), ann.Quantiser.fit(x, 0.0)

    def parallel(q):
        c = q.encode(x)
        back = np.concatenate([q.books[m][c[:, m]] for m in range(c.shape[1])], 1)[:, :32]
        return float((((x - back) * x).sum(1) ** 2).mean())

    assert parallel(aware) < parallel(plain)
    best = ann.Best(aware, x[:50], 300)
    for at in range(0, 3000, 700):
        best.add(np.arange(at, min(3000, at + 700)), aware.pack(x[at : at + 700]))
    row, ids, _ = best.cut()
    assert np.bincount(row).tolist() == [300] * 50
    exact = x[:50] @ x.T
    top = np.argsort(-exact, axis=1)[:, :10]
    assert sum(len(set(ids[row == i]) & set(top[i])) for i in range(50)) / 500 > 0.95


def test_blocks_dont_change_the_best():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[100:700] = x[5]  # ties at the edge go to the smaller ids
    q = ann.Quantiser.fit(x)
    near = q.scan(x[:9], q.pack(x))
    for size in (900, 250, 31):
        best = ann.Best(q, x[:9], 40)
        for at in rng.permutation(range(0, 900, size)):
            best.add(np.arange(at, min(900, at + size)), q.pack(x[at : at + size]))
        row, ids, _ = best.cut()
        for i in range(9):
            assert ids[row == i].tolist() == np.lexsort((np.arange(900), -near[i]))[:40].tolist()


def test_quality_gradients_and_attention():
    rng = np.random.default_rng(0)
    m = quality.train([rng.random((3, quality.WIDTH)) for _ in range(4)], np.array([0.0, 1, 1, 0]), epochs=1)
    x, start, y = rng.standard_normal((7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0, 1])

    def loss():
        p = m.forward(x, start)["p"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = m.gradients(x, start, y)
    for k, w in m.w.items():
        at = (0,) * w.ndim
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    f = m.forward(x, start)
    assert np.add.reduceat(f["a"], start) == pytest.approx([1, 1, 1])


def test_every_passage_is_read():
    text = " ".join(["word"] * 63) + " LAST!! " + "x | " * 100
    (_, _, w), *_ = tk.each_slice(pa.array([text, None, "a"]), tk.SPACE_WORDS)
    x, owner = quality.passages(w)
    assert np.bincount(owner).tolist() == [5, 1, 1] and np.isfinite(x).all()
    assert quality.train([x[:1], x[1:2]], np.array([1.0, 1.0])).score(x, owner).tolist() == [1.0, 1.0, 1.0]


def test_forest_on_held_out_findings():
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr nonumy eirmod tempor invidunt labore magna aliquyam".split()
    c = secret_scan.Corpus(np.log(np.full((27, 27), 1 / 27)), frozenset(w for w in words if 4 <= len(w) <= 12))
    forest = secret_scan.fit(c, secret_scan.labelled_findings(words, 1500, seed=1))
    test = secret_scan.labelled_findings(words, 400, seed=2)
    score = forest.score(np.array([secret_scan.features(t, s, e, p, c) for t, s, e, p, _ in test]))
    assert ((score >= 0.5) == np.array([f[4] for f in test])).mean() > 0.95


def test_candidates():
    text = 'x token = "04dbebab91ab85687d33" y = "abcdefghijklmnopqrst" abcdefghijklmnopqrst 12345 ' + "k" * 15 + "1"
    assert [text[s:e] for s, e in secret_scan.candidates(text)] == ["04dbebab91ab85687d33", "abcdefghijklmnopqrst", "k" * 15 + "1"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<nav>menu</nav><script>var a='<p>x</p>'</script><style>p{}</style>", ""),
        ("<html><head><title>t</title></head><body><header>h</header><article><h1>A &amp; B</h1><p>one<br>two<p><b>th</b>ree</article><aside>s</aside><footer>f</footer>", "A & B\none two\nthree"),
        ("<article><p>x</p><div class='ad'>buy</div><form>f</form><p>y</p><section class=comments><article>hi</article></section></article>", "x\ny"),
        ("<div class='page with-sidebar'><div class=menu><a>a</a></div><p>A long enough text of this page, with words.</p><p>z</p></div>", "A long enough text of this page, with words.\nz"),
        ("<main><p title='a>b'>q&nbsp; r</p><!-- <p>no</p> --><noscript>js</noscript><div class=cookie-notice>c</div></main>", "q r"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<form id=aspnetForm><div class=SideBar>s</div><article><p>in a form</p><form>mail</form></article></form>", "in a form"),
        ("<div role=alert>a</div><div hidden>h</div><article><p>y</p><div id=navMenu>n</div></article>", "y"),
        ("<nav><ul><li><a href=x>m</a><article><p>left open</p></article>", "left open"),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


def test_deep_and_broken_markup_is_quick():
    assert main_text("<div>" * 20000 + "x" + "</b>" * 20000) == "x"
    assert main_text("<p" * 5000) == "" and main_text("<a '" * 3000 + "text")[-4:] in ("", "text")
