"""Main text of web pages by line-block distribution.

A page is stripped of markup into *lines*, one for each block element. Each
line has a weight: the length of its text; 0 in page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments); a small share of
it outside the article of a page that marks one; less its links' text where no
article is marked. The weights are summed over sliding windows of lines. The
text surges where that sum reaches a share of the page's peak and dives where it
falls to nothing or the article ends; a line inside a marked article is lifted
by as much as a surge needs. What lies between is the main text, without the
furniture inside it, and with lines of links if the text is dense on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: HTML's names, as the public HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "noframes", "svg", "object", "select", "button", "audio", "video", "canvas", "math")
FURNITURE = frozenset("nav footer header aside menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars rail "
    "widget widgets related recommended recommendations share sharing social comment comments disqus reply replies respond footer header "
    "masthead login search toolbar pager pagination skip disclaimer alert".split()
)

#: A class mark by one of these holds whatever the element contains.
FIRM_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising comment comments disqus reply replies respond related recommended recommendations cookie cookies consent gdpr notice notices newsletter".split())
#: Words that say where or how big a part is: a class of these and the words above is a mark; one with any other word (as in share-price) isn't.
NEUTRAL_WORDS = frozenset(
    "box block list lists item items wrap wrapper container content area bar section panel region zone slot unit row col column inner outer top bottom left right center main head body foot "
    "site page global post posts article articles story stories user users reader readers form field input btn button buttons link links icon icons img image text title heading label count "
    "module component view group holder fixed sticky mobile desktop small large primary secondary first last next prev previous media policy google for you more the of and js is has new all "
    "up down message messages thread threads feed to in on close open toggle wide narrow".split()
)

#: Other class marks, and forms, give way on an element around an article; on a page without one, around more than this share of its text.
WRAPPER_SHARE = 0.6

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

WINDOW_LINES = 3
SURGE_SHARE = 0.25
#: What a line outside the article of a page that marks one counts.
OUTSIDE = 0.05


def _is_furniture(name: str, attrs: str) -> tuple[bool, int]:
    """Whether an element's name or role marks page furniture; 1 if its class or id does, 2 if firmly, else 0."""
    soft = int(name == "form")  # some pages are one form
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, 0
        for name_ in value.split() if key in ("class", "id") else ():
            words = [x.lower() for w in _WORDS.findall(name_) for x in ([w] if w.lower() in FURNITURE_WORDS else _CAMEL.findall(w))]
            found = FURNITURE_WORDS.intersection(words)
            if found and all(len(w) == 1 or w in found or w in NEUTRAL_WORDS for w in words):
                soft = max(soft, 2 if found & FIRM_WORDS else 1)
    return name in FURNITURE, soft if name not in ("html", "body", "main") and (name != "article" or soft == 2) else 0


def page_lines(html: str) -> list[tuple[str, int, int, bool]]:
    """(text, text in links, outermost article or 0, furniture) of each block line, in page order."""
    lines: list[tuple[str, int, int, bool]] = []
    soft_of: list[list[int]] = []  # the class-marked elements around each line
    parts: list[str] = []
    linked = 0
    stack: list[str] = []
    marks: list[tuple[bool, int, int]] = []  # furniture, class mark, article; inherited
    open_names: dict[str, int] = {}
    firm: set[int] = set()
    wrappers: set[int] = set()
    softs: list[int] = []
    articles = soft_count = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                hard, _, art = marks[-1] if marks else (False, 0, 0)
                lines.append((text, min(linked, len(text)), art, hard))
                soft_of.append(list(softs))
            parts.clear()
        linked = 0

    def pop_to(name: str) -> None:
        while stack:
            top = stack.pop()
            open_names[top] -= 1
            if (m := marks.pop())[1]:
                softs.pop()
            if top == name:
                return

    def text_of(s: str) -> None:
        nonlocal linked
        if s:
            s = unescape(s) if "&" in s else s
            parts.append(s)
            if open_names.get("a"):
                linked += len(s.strip())

    at = 0
    for m in _TAG.finditer(html):
        text_of(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("title", "noscript", "textarea", "button"):
                flush()
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"] or m["end2"]:
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            if open_names.get(name):
                pop_to(name)
            continue
        if name in BLOCK:
            flush()
            if open_names.get("p"):
                pop_to("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1] == name:
                pop_to(name)
            if name in ("article", "main"):
                for left_open in ("nav", "header"):
                    if open_names.get(left_open):
                        pop_to(left_open)
                if not (marks and marks[-1][2]):
                    wrappers.update(k for k in softs if k not in firm)
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/"):
            attrs = attrs[:-1]
        hard, soft = _is_furniture(name, attrs)
        above = marks[-1] if marks else (False, 0, 0)
        art = above[2]
        if name in ("article", "main") and not art and not above[0]:
            articles += 1
            art = articles
        mark = 0
        if soft:
            soft_count += 1
            mark = soft_count
            softs.append(mark)
            if soft == 2:
                firm.add(mark)
        stack.append(name)
        open_names[name] = open_names.get(name, 0) + 1
        marks.append((above[0] or hard, mark, art))
    text_of(html[at:])
    flush()
    held: dict[int, int] = {}
    for (t, _, _, hard), soft in zip(lines, soft_of, strict=True):
        for k in soft if not hard else ():
            held[k] = held.get(k, 0) + len(t)
    total = sum(len(t) for t, _, _, hard in lines if not hard)
    if not articles:
        wrappers.update(k for k, n in held.items() if n > WRAPPER_SHARE * total and k not in firm)
    return [(t, a, art, hard or any(k not in wrappers for k in soft)) for (t, a, art, hard), soft in zip(lines, soft_of, strict=True)]


def densities(weight: list[float], window: int) -> list[float]:
    """The sum of each line's weight and those of the ``window`` - 1 lines after it."""
    run = [0.0]
    for w in weight:
        run.append(run[-1] + w)
    return [run[min(len(weight), i + window)] - run[i] for i in range(len(weight))]


def main_text(html: str | None, window: int = WINDOW_LINES, share: float = SURGE_SHARE) -> str:
    """The main text of one page; '' for null, for no markup with no text, and for pages of furniture alone."""
    if not html:
        return ""
    lines = page_lines(html)
    n = len(lines)
    marked = any(art and not skip for _, _, art, skip in lines)
    weight = [0.0 if skip else float(len(t)) if art else max(0, len(t) - 2 * a) * (OUTSIDE if marked else 1) for t, a, art, skip in lines]
    surge = share * max(densities(weight, window), default=0)
    if not surge:
        return ""
    weight = [w + surge if art and not skip else w for w, (_, _, art, skip) in zip(weight, lines, strict=True)]
    after = densities(weight, window)
    before = densities(weight[::-1], window)[::-1]
    kept, i = [], 0
    while i < n:
        if not weight[i]:
            i += 1
            continue
        zone, j = lines[i][2] > 0, i
        while j < n and after[j] and (lines[j][2] > 0) == zone:
            j += 1
        while not weight[j - 1]:
            j -= 1
        if max(after[k] for k in range(i, j) if weight[k]) >= surge:
            kept += [lines[k][0] for k in range(i, j) if weight[k] or not lines[k][3] and before[k] >= surge <= after[k]]
        i = j
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; ids and urls pass as they are, null ones too.

    One narrow stage: no shuffle, one page in memory at a time beside its Arrow
    batch. A null or empty page gives '' and 0; repeated rows give repeated
    results; other columns are left out.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
