"""Surge and dive points against a plain version, and pages on which they decide."""

from __future__ import annotations

import random

import pytest

from prowave.llm import html_extract as h


def plain(lines, window=h.WINDOW_LINES, share=h.SURGE_SHARE):
    """Every window summed anew; a span grows line by line from a line that has weight."""
    n = len(lines)
    marked = any(art and not skip for _, _, art, skip in lines)
    base = []
    for text, linked, art, skip in lines:
        if skip:
            base.append(0)
        elif art:
            base.append(len(text))
        else:
            base.append(max(0, len(text) - 2 * linked) * (h.OUTSIDE if marked else 1))
    surge = share * max([sum(base[i : i + window]) for i in range(n)], default=0)
    if not surge:
        return ""
    weight = [b + (surge if art and not skip else 0) for b, (_, _, art, skip) in zip(base, lines, strict=True)]
    ahead = [sum(weight[i : i + window]) for i in range(n)]
    behind = [sum(weight[max(0, i - window + 1) : i + 1]) for i in range(n)]
    inside = lambda i: bool(lines[i][2])
    out, done = [], -1
    for i in range(n):
        if i <= done or not weight[i]:
            continue
        span = [i]
        while (k := span[-1] + 1) < n and ahead[k] > 0 and inside(k) == inside(i):
            span.append(k)
        done = span[-1]
        heavy = [k for k in span if weight[k]]
        if max(ahead[k] for k in heavy) < surge:
            continue
        for k in span:
            if weight[k] or (k < heavy[-1] and not lines[k][3] and behind[k] >= surge and ahead[k] >= surge):
                out.append(lines[k][0])
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_same_as_the_plain_version(seed):
    rng = random.Random(seed)
    text = lambda: "word " * rng.choice([1, 2, 4, 20, 60, 200])
    parts = []
    for _ in range(rng.randrange(1, 30)):
        parts.append(rng.choice([lambda: f"<p>{text()}</p>", lambda: f"<div><a href=x>{text()}</a></div>", lambda: f"<nav>{text()}</nav>", lambda: f"<p>{text()}<a href=y>{text()}</a></p>", lambda: f"<div class=ad>{text()}</div>", lambda: f"<article><p>{text()}</p><ul><li>{text()}</ul></article>" if seed % 2 else "<p>x</p>"])())
    html = "".join(parts)
    assert h.main_text(html) == plain(h.page_lines(html))


LONG = "A sentence of the article that goes on for quite a while. " * 6


def test_windows_decide_on_pages_without_marks():
    p = f"<p>{LONG}</p>"
    short = "<div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>About</a></div><div><a href=d>More</a></div>"
    assert h.main_text(short + p * 4 + short + "<div>x.</div>") == "\n".join([LONG.strip()] * 4)
    # a heading and a short last line belong to the span; a line far from any text doesn't
    assert h.main_text(f"<h1>Title</h1>{p}{p}<p>End.</p>{short}<div>Imprint</div>") == "\n".join(["Title", LONG.strip(), LONG.strip(), "End."])


def test_a_linked_paragraph_between_texts_stays():
    p, link = f"<p>{LONG}</p>", "<p>See <a href=x>all that was said about this at the time and later</a>.</p>"
    want = "See all that was said about this at the time and later."
    assert h.main_text(p + link + p) == "\n".join([LONG.strip(), want, LONG.strip()])
    assert want not in h.main_text(link + p)


def test_a_teaser_marked_as_article_gives_way_to_dense_text():
    """Outside a marked article text counts little, but not nothing: windows decide."""
    body = "".join(f"<p>{LONG * 5}</p>" for _ in range(6))
    assert h.main_text(f"<article><p>Tiny.</p></article><hr><div>{body}</div>") == "\n".join(["Tiny.", *[(LONG * 5).strip()] * 6])
    assert h.main_text(f"<article><p>{LONG}</p></article><p>{LONG}</p>") == LONG.strip()


@pytest.mark.parametrize("mark", ["class='share-price'", "id='alert-level'", "class='related-work'", "class='notice-of-death'", "class='searching'"])
def test_names_that_only_contain_a_mark_are_text(mark):
    assert h.main_text(f"<article><p>{LONG}</p><p {mark}>Short line</p></article>").endswith("\nShort line")


@pytest.mark.parametrize("mark", ["class='share-buttons'", "id=cookieBanner", "class='ad-300x250 wide'", "class='user-comments'", "class='related-posts'", "class=newsletter-signup", "class='main nav-bar'"])
def test_marks_are_furniture(mark):
    assert h.main_text(f"<article><p>{LONG}</p><div {mark}>Short line</div></article>") == LONG.strip()
