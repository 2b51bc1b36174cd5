"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the whole text, no
passage is left out). Each passage is described by how its kinds of bytes
follow each other and by a few figures of its words; a tanh layer encodes it,
gated attention weighs the passages, and the weighted mean is scored. Only
document labels train it, by gradients through all of that.

It is fitted on at most ``TRAIN_DOCS`` labelled documents (the ones whose hashed
ids are smallest, outside the held-out fold); every document is scored. A
score sees nothing but the text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkernel as tk

PASSAGE = 64
TRAIN_DOCS = 4000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 24
ATTENTION = 12
EPOCHS = 30

KINDS = 14


def _kinds() -> np.ndarray:
    """Kind of each byte: letters by case, digits, white space, the common marks one by one, other ASCII, beyond ASCII."""
    t = np.full(256, 12, np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[9:14] = 4
    t[0x20] = 3
    for i, marks in enumerate((".", ",;:", "!?", "|", "#$%&*@^~", "\"'`", "-_/\\")):
        for c in marks:
            t[ord(c)] = 5 + i
    t[0x80:] = 13
    return t


_KIND = _kinds()
FIGURES = 9
WIDTH = KINDS * KINDS + FIGURES


def passages(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of each passage of a slice; a text without words has one empty passage."""
    docs = len(words.offsets) - 1
    place = np.arange(len(words.start)) - words.first[words.doc]
    count = np.maximum(1, -(-np.diff(words.first) // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    n = int(base[-1])
    owner = np.repeat(np.arange(docs), count)
    of_word = base[words.doc] + place // PASSAGE
    jump = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(jump, words.offsets[1:-1], 1)  # a passage begins with each document
    np.add.at(jump, words.start[(place % PASSAGE == 0) & (place > 0)], 1)  # and with every 64th word
    of_byte = np.cumsum(jump)[:-1]
    kind = _KIND[words.data].astype(np.int64)
    pair = kind[:-1] * KINDS + kind[1:]
    same = of_byte[1:] == of_byte[:-1]
    grid = np.bincount(of_byte[1:][same] * (KINDS * KINDS) + pair[same], minlength=n * KINDS * KINDS).reshape(n, -1)
    size = np.maximum(1, np.bincount(of_byte, minlength=n))
    x = np.zeros((n, WIDTH), np.float32)
    x[:, : KINDS * KINDS] = np.sqrt(grid / size[:, None])
    total = np.maximum(1, np.bincount(of_word, minlength=n))
    length = (words.end - words.start).astype(float)
    h = words.hashes()
    mean = np.bincount(of_word, length, minlength=n) / total
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, minlength=n) / total - mean**2))
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (of_word[order[1:]] != of_word[order[:-1]])
    distinct = np.bincount(of_word[order[new]], minlength=n) / total
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    adjacent = np.bincount(of_word[repeat], minlength=n) / total
    initial = np.bincount(of_word, kind[words.start] == 1, minlength=n) / total
    final = np.bincount(of_word, (kind[words.end - 1] >= 5) & (kind[words.end - 1] <= 12), minlength=n) / total
    x[:, KINDS * KINDS :] = np.stack([np.log1p(mean), np.log1p(spread), distinct, adjacent, initial, final, np.log1p(np.bincount(of_word, minlength=n)), np.log1p(np.diff(words.first))[owner], np.log1p(size / total)], 1)
    return x, owner


def _segments(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(owner, prepend=-1))


@dataclass
class Model:
    """Weights by name, and the features' scale. Without labels of both kinds, ``constant`` is every score."""

    w: dict[str, np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        size = np.diff(np.append(start, len(x)))
        bag = np.repeat(np.arange(len(start)), size)
        e = np.tanh(x @ w["encode"] + w["encode_b"])
        v, g = np.tanh(e @ w["value"]), 1 / (1 + np.exp(-(e @ w["gate"])))
        s = (v * g) @ w["attend"]
        s = np.exp(s - np.maximum.reduceat(s, start)[bag])
        a = s / np.add.reduceat(s, start)[bag]
        z = np.add.reduceat(e * a[:, None], start)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return {"e": e, "v": v, "g": g, "a": a, "z": z, "p": p, "bag": bag}

    def gradients(self, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, start)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * w["out"]
        e, a, bag = f["e"], f["a"], f["bag"]
        de = a[:, None] * dz[bag]
        da = (e * dz[bag]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, start)[bag])
        vg = ds[:, None] * w["attend"]
        dv, dg = vg * f["g"] * (1 - f["v"] ** 2), vg * f["v"] * f["g"] * (1 - f["g"])
        de += dv @ w["value"].T + dg @ w["gate"].T
        du = de * (1 - e**2)
        return {"encode": x.T @ du, "encode_b": du.sum(0), "value": e.T @ dv, "gate": e.T @ dg, "attend": (f["v"] * f["g"]).T @ ds, "out": f["z"].T @ d, "out_b": d.sum(keepdims=True)}

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(_segments(owner)), self.constant)
        return self.forward((x - self.shift) / self.scale, _segments(owner))["p"]


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.004, decay: float = 1e-4) -> Model:
    """Adam over batches of documents; the last weights are averaged over the final third of the steps."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, np.zeros(WIDTH), np.ones(WIDTH), float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    n = sum(len(b) for b in bags)
    shift = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    m = Model({}, shift, np.sqrt(np.maximum(0, sum(((b - shift) ** 2).sum(0) for b in bags) / n)) + 0.02)
    init = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    m.w = {"encode": init(WIDTH, HIDDEN), "encode_b": np.zeros(HIDDEN), "value": init(HIDDEN, ATTENTION), "gate": init(HIDDEN, ATTENTION), "attend": init(ATTENTION), "out": init(HIDDEN), "out_b": np.full(1, np.log(labels.mean() / (1 - labels.mean())))}
    first, second = ({k: np.zeros_like(v) for k, v in m.w.items()} for _ in range(2))
    mean, kept, step, size = {k: np.zeros_like(v) for k, v in m.w.items()}, 0, 0, 64
    steps = epochs * -(-len(bags) // size)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x = (np.concatenate([bags[i] for i in pick]) - m.shift) / m.scale  # a batch at a time: the features stay 32-bit
            start = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            step += 1
            for k, g in m.gradients(x, start, labels[pick]).items():
                g = g + decay * m.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.w[k] = m.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            if step > steps * 2 // 3:
                kept += 1
                for k in mean:
                    mean[k] += m.w[k]
    m.w = {k: v / kept for k, v in mean.items()} if kept else m.w
    return m


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
            x, owner = passages(words)
            cut = [*_segments(owner).tolist(), len(x)]
            yield pa.RecordBatch.from_arrays(
                [b.column("quality").slice(lo, hi - lo), b.column("turn").slice(lo, hi - lo), pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["quality", "turn", "x"],
            )


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Train on at most ``most`` labelled documents outside the held-out fold. Labels that aren't 0 or 1 don't count; of several for one id, the most frequent does, 1 on a tie."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality")).withColumn("turn", F.xxhash64(F.lit("quality"), "doc_id")).orderBy("turn", "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most ``most`` rows of three numbers are broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "turn").mapInArrow(_features, "quality int, turn long, x binary")
    # The sample is bounded, so one task trains on it, and the driver gets the weights alone.
    return pickle.loads(bytes(rows.repartition(1).mapInArrow(_train, "model binary").first()["model"]))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches), pa.schema([("quality", pa.int32()), ("turn", pa.int64()), ("x", pa.binary())]))
    got = sorted(zip(t.column("turn").to_pylist(), t.column("x").to_pylist(), t.column("quality").to_pylist(), strict=True))
    model = train([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x, _ in got], np.array([q for *_, q in got], float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False, most: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, row[, text]) of each document; ``row`` holds the columns named by ``keep``.

    Null texts are scored like ''. Equal texts have equal scores; rows repeat; a
    text of any length is scored whole, one too long for a slice by itself. Without
    labels of both kinds every score is the one label there is, or 0.5.
    """
    model = fit(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
                p = model.score(*passages(words))
                same = {c: b.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out", "row", "text")}
                out = {**{c: same[c] for c in ("doc_id", "held_out", "row")}, "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))} | ({"text": same["text"]} if with_text else {})
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, f"doc_id long, held_out boolean, row {rows.schema['row'].dataType.simpleString()}, score double, predicted int" + ", text string" * with_text)
