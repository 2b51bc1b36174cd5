"""Secrets in texts: candidate tokens judged by a random forest.

A candidate is a run of ``[A-Za-z0-9+/_-]`` of at least ``LEAST`` characters
(with up to two ``=`` after it) that has a digit, or that is assigned in quotes.
The forest sees its length and make-up, how its characters follow each other
against the letter transitions of the corpus, how much of it words of the
corpus' dictionary cover, the path it stands in, and the words beside it.

The tables hold no labelled findings, so the forest is trained on findings that
``labelled_findings`` writes from templates with a fixed seed; any list of
(text, start, end, path, label) can take their place. Transitions and dictionary
are counted over all documents; what is kept of them has a fixed bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk

LEAST = 16
DICTIONARY = 4096
TREES = 40
DEPTH = 8
FINDINGS = 6000
THRESHOLD = 0.5

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{%d,}={0,2}" % LEAST)
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"[=:]\s?[\"'`]?$")
_NEAR = re.compile(r"[^\W\d_]+")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
#: Words beside a token, or in a path, that tell for or against a secret.
SECRET_WORDS = frozenset("token secret key apikey password passwd pwd pass auth authorization bearer credential credentials private access api client session signing".split())
PLAIN_WORDS = frozenset("commit sha hash digest checksum md5 etag revision rev build version uuid guid id order invoice card phone tel account serial isbn example sample dummy placeholder blob tree image".split())
TEST_PATHS = frozenset("test tests testing example examples sample samples mock mocks fixture fixtures doc docs".split())


@dataclass
class Corpus:
    """Log-probabilities of letter transitions (27 by 27, 26 is the edge of a word) and the dictionary."""

    transitions: np.ndarray
    words: frozenset[str]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """('', transition, count) and (word, -1, count) of a partition's lower-cased words of letters a-z."""
    grid = np.zeros(27 * 27, np.int64)
    words: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        at = np.flatnonzero(grid)
        names, n = list(words), len(words)
        out = pa.RecordBatch.from_arrays([pa.array([""] * len(at) + names, pa.string()), pa.array([*at.tolist(), *[-1] * n], pa.int64()), pa.array([*grid[at].tolist(), *(words[w] for w in names)], pa.int64())], names=["word", "at", "n"])
        grid[:] = 0
        words.clear()
        return out

    letters = np.zeros(256, bool)
    letters[ord("a") : ord("z") + 1] = True
    for b in batches:
        for _, _, w in tk.each_slice(b.column("text"), tk.ALNUM_WORDS, lower=True):
            plain = letters[w.data]
            code = np.where(plain, w.data.astype(np.int64) - ord("a"), 26)
            grid += np.bincount(code[:-1] * 27 + code[1:], minlength=27 * 27)
            run = np.concatenate([[0], np.cumsum(plain)])
            size = w.end - w.start
            good = np.flatnonzero((run[w.end] - run[w.start] == size) & (size >= 4) & (size <= 12))
            _, first, n = np.unique(w.hashes()[good], return_index=True, return_counts=True)
            for i, k in zip(good[first].tolist(), n.tolist(), strict=True):
                words[w.text(i)] += k
        if len(words) > 200_000:
            yield flush()
    yield flush()


def corpus_of(docs: DataFrame, size: int = DICTIONARY) -> Corpus:
    """Counts over every document; 729 sums and the ``size`` most frequent words come to the driver."""
    counts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_count, "word string, at long, n long").groupBy("word", "at").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("at").desc(), F.col("n").desc(), "word").limit(size + 27 * 27).collect()
    grid = np.ones((27, 27))
    for r in top:
        if r["at"] >= 0:
            grid[divmod(r["at"], 27)] += r["n"]
    words = [r["word"] for r in top if r["at"] < 0][:size]
    return Corpus(np.log(grid / grid.sum(1, keepdims=True)), frozenset(words))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        if _DIGIT.search(text, s, e) or (s and text[s - 1] in "\"'`" and _ASSIGNED.search(text, max(0, s - 3), s)):
            yield s, e


FEATURES = (
    "length", "entropy", "digits", "hex", "upper", "lower", "distinct", "longest run", "kind changes", "kinds", "transitions", "dictionary", "longest word",
    "quoted", "assigned", "secret word before", "plain word before", "secret word near", "slashes", "in path or url", "test path", "uuid", "all digits", "length multiple",
)


def features(text: str, s: int, e: int, path: str, c: Corpus) -> list[float]:
    t = text[s:e].rstrip("=")
    n = len(t)
    count = Counter(t)
    p = np.array(list(count.values())) / n
    kind = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o" for x in t]
    low = t.lower()
    code = [26, *(ord(x) - 97 if "a" <= x <= "z" else 26 for x in low), 26]
    move = sum(c.transitions[i, j] for i, j in zip(code, code[1:], strict=False)) / (n + 1)
    covered, longest, at = 0, 0, 0
    while at < n:
        for size in range(min(12, n - at), 3, -1):
            if low[at : at + size] in c.words:
                covered, longest, at = covered + size, max(longest, size), at + size
                break
        else:
            at += 1
    run = best = 1
    for a, b in zip(t, t[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    before = [w.lower() for w in _NEAR.findall(text, max(0, s - 40), s)]
    after = [w.lower() for w in _NEAR.findall(text, e, e + 24)]
    parts = {w.lower() for w in _NEAR.findall(path)}
    lead = text[max(0, s - 3) : s]
    return [
        n, float(-(p * np.log2(p)).sum()), kind.count("d") / n, sum(x in "0123456789abcdefABCDEF" for x in t) / n, kind.count("u") / n, kind.count("l") / n, len(count) / n, best,
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, len(set(kind)), move, covered / n, longest,
        float(lead[-1:] in ("'", '"', "`") and bool(lead)), float(bool(_ASSIGNED.search(lead))), float(bool(before) and before[-1] in SECRET_WORDS), float(bool(before) and before[-1] in PLAIN_WORDS),
        float(any(w in SECRET_WORDS for w in before[-3:] + after[:2])), t.count("/"), float("/" in lead or "." in lead), float(bool(parts & TEST_PATHS)), float(bool(_UUID.fullmatch(t))), float(kind.count("d") == n), float(n % 4 == 0),
    ]


def labelled_findings(words: list[str], n: int = FINDINGS, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label) written from templates: half secrets, half what looks like one; ``words`` fill the texts."""
    rng = np.random.default_rng(seed)
    words = words or ["lorem", "ipsum", "dolor", "amet"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(int(k)))
    hexa, digits = "0123456789abcdef", "0123456789"
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret, plain = sorted(SECRET_WORDS), sorted(PLAIN_WORDS)
    out = []
    while len(out) < n:
        label = len(out) % 2
        if label:
            body = pick([lambda: some(hexa, pick([32, 40, 40, 64])), lambda: some(full, rng.integers(20, 48)), lambda: some(full + "+/", 4 * rng.integers(6, 16)) + pick(["", "=", "=="]), lambda: pick(["AKIA", "ASIA"]) + some(full[:26] + digits, 16), lambda: pick(["ghp_", "sk-", "xoxb-", "glpat-"]) + some(full, rng.integers(20, 40))])()
            left = pick([f'{pick(secret)} = "', f"{pick(secret)}={pick(['', '\"'])}", f"{pick(secret)}: ", f'"{pick(secret)}": "', f"{pick(secret)} "])
            if pick([0, 0, 0, 1]) and "-" not in left:
                left = f'{pick(words)}_{pick(secret)} = "'
            right = '"' if left.endswith('"') else " "
        else:
            body, left, right = pick([
                lambda: (some(digits, rng.integers(16, 21)), pick(["", f"{pick(plain)} ", f"{pick(words)} ", f"{pick(secret)} "]), " "),
                lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), pick([f"{pick(plain)}: ", f'{pick(plain)} = "', f"{pick(words)} "]), " "),
                lambda: (some(hexa, pick([32, 40, 64])), pick([f"{pick(plain)} ", f"{pick(plain)}: ", "/blob/", "/commit/", f'{pick(plain)} = "', f"{pick(words)} {pick(plain)} "]), " "),
                lambda: ("/".join([pick(words) for _ in range(4)]) + "/" + some(digits, 3), pick(["/", "./", "see "]), " "),
                lambda: ("_".join([pick(words) for _ in range(3)]) + some(digits, rng.integers(1, 4)), pick(["", f'{pick(secret)} = "', "= "]), " "),
                lambda: (pick("x01a") * int(rng.integers(16, 40)) + pick(["", "1"]), f'{pick(secret)} = "', '"'),
                lambda: (pick(["your", "my", "example", "changeme", "insert", "dummy"]) + "-" + pick(secret) + "-here-" + some(digits, 2) + "-" + pick(words), f'{pick(secret)} = "', '"'),
                lambda: ("".join(pick(words) for _ in range(5)) + pick(["1", "2", "42"]), pick([f"{pick(words)} ", f'{pick(secret)} = "']), " "),
                lambda: ("20" + some(digits, 6) + "T" + some(digits, 6) + pick(["Z", "-0000"]) + pick(words), f"{pick(words)} ", " "),
            ])()
        lead = " ".join(pick(words) for _ in range(4)) + " " + left
        text = lead + body + right + " ".join(pick(words) for _ in range(3))
        found = [(s, e) for s, e in candidates(text) if s < len(lead) + len(body) and e > len(lead)]
        if found:
            path = "/".join(pick(words) for _ in range(2)) + ("/tests/a" if not label and rng.random() < 0.15 else "/a")
            out.append((text, *found[0], path, label))
    return out


class Forest:
    """Classification trees on bootstrap samples, split by Gini impurity among a root of the features; flat arrays for quick scoring."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth = depth
        size = (1 << (depth + 1)) - 1
        self.feature, self.cut, self.value = np.full((trees, size), -1), np.zeros((trees, size)), np.full((trees, size), 0.5)
        for t in range(trees):
            pick = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, int)
            nodes = [(0, pick)]
            while nodes:
                at, rows = nodes.pop()
                if not len(rows):
                    continue
                mean = self.value[t, at] = y[rows].mean()
                if at >= size // 2 or mean in (0, 1) or len(rows) < 6:
                    continue
                best = (1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, left = x[rows, f][order], np.cumsum(y[rows][order])
                    k = np.arange(1, len(rows))
                    a, b = left[:-1] / k, (left[-1] - left[:-1]) / (len(rows) - k)
                    gain = np.where(v[1:] > v[:-1], mean * (1 - mean) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows), -1)
                    i = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[i] > best[0]:
                        best = (gain[i], f, (v[i] + v[i + 1]) / 2)
                if best[1] >= 0:
                    self.feature[t, at], self.cut[t, at] = best[1], best[2]
                    right = x[rows, best[1]] > best[2]
                    nodes += [(2 * at + 1, rows[~right]), (2 * at + 2, rows[right])]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(len(x)), f] > cut[at]))
            out += value[at]
        return out / len(self.feature)


def fit(c: Corpus, findings: list[tuple[str, int, int, str, int]] | None = None) -> Forest:
    findings = labelled_findings(sorted(c.words)) if findings is None else findings
    x = np.array([features(t, s, e, p, c) for t, s, e, p, _ in findings], float).reshape(-1, len(FEATURES))
    return Forest(x, np.array([f[4] for f in findings], float))


def scan(docs: DataFrame, path_col: str = "source", threshold: float = THRESHOLD, findings: list[tuple[str, int, int, str, int]] | None = None) -> DataFrame:
    """(doc_id, start, end, candidate, score, secret): a row for each candidate, offsets in code points.

    Null and empty texts have none; a null path counts as ''; repeated documents
    repeat their findings; ids pass as they are, null ones too; a text of any
    length is read whole. Tokens of under LEAST characters, and ones broken by
    other marks, are no candidates.
    """
    c = corpus_of(docs)
    forest = fit(c, findings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, str]] = []
            x: list[list[float]] = []
            ids = b.column("doc_id").to_pylist()
            for i, (text, path) in enumerate(zip(b.column("text").to_pylist(), b.column("path").to_pylist(), strict=True)):
                for s, e in candidates(text):
                    rows.append((i, s, e, text[s:e]))
                    x.append(features(text, s, e, path, c))
            score = forest.score(np.array(x, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array(score), pa.array(score >= threshold)],
                names=["doc_id", "start", "end", "candidate", "score", "secret"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, candidate string, score double, secret boolean")
