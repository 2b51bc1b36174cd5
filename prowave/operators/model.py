"""The node classifier: an MLP with the first layer's output added to each hidden layer, in NumPy.

Training takes a bounded number of rows (the labelled training set of a graph,
at most ``MAX_ROWS``); prediction runs on the executors in Arrow batches with
the weights in the closure.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prowave.functions.scalar import lcg

MAX_ROWS = 200_000
#: What a hidden layer does to its product: nothing, a bias, batch normalisation, or both.
TRANSFORMS = ("none", "bias", "bn", "biasbn")
MOMENTUM, LEAST_VARIANCE = 0.1, 1e-5


@dataclass
class SkipMLP:
    """``layers`` linear layers; ``skip`` adds the first one's output (before its ReLU) to all hidden ones, and equal widths add their input.

    ``transform`` is one of TRANSFORMS and holds for all layers but the last.
    Batch normalisation takes a batch's mean and variance in training and their
    running averages afterwards.
    """

    inputs: int
    hidden: int
    classes: int
    layers: int = 2
    dropout: float = 0.0
    transform: str = "none"
    skip: bool = True
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    scales: list[np.ndarray] = field(default_factory=list)
    shifts: list[np.ndarray] = field(default_factory=list)
    running: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {self.transform!r}: one of {', '.join(TRANSFORMS)}")
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            sizes = [self.inputs, *[self.hidden] * (self.layers - 1), self.classes]
            self.weights = [rng.uniform(-1, 1, (a, b)) / np.sqrt(b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
            inner = sizes[1:-1]
            self.biases = [np.zeros(b) for b in inner]
            self.scales, self.shifts = [np.ones(b) for b in inner], [np.zeros(b) for b in inner]
            self.running = [np.stack([np.zeros(b), np.ones(b)]) for b in inner]

    @property
    def has_bias(self) -> bool:
        return self.transform in ("bias", "biasbn")

    @property
    def has_norm(self) -> bool:
        return self.transform in ("bn", "biasbn")

    def parameters(self) -> list[np.ndarray]:
        return [*self.weights, *(self.biases if self.has_bias else []), *([*self.scales, *self.shifts] if self.has_norm else [])]

    def _linear(self, k: int, x: np.ndarray, training: bool) -> tuple[np.ndarray, tuple | None]:
        """(output, (normalised, deviation) if there is a normalisation)."""
        out, kept = x @ self.weights[k], None
        if k < len(self.weights) - 1:
            if self.has_bias:
                out = out + self.biases[k]
            if self.has_norm:
                mean, var = (out.mean(0), out.var(0)) if training else self.running[k]
                if training:
                    self.running[k] = (1 - MOMENTUM) * self.running[k] + MOMENTUM * np.stack([mean, var * len(out) / max(1, len(out) - 1)])
                dev = np.sqrt(var + LEAST_VARIANCE)
                kept = ((out - mean) / dev, dev)
                out = kept[0] * self.scales[k] + self.shifts[k]
        return (out + x if x.shape[1] == out.shape[1] else out), kept

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None, training: bool = False) -> tuple[np.ndarray, list]:
        keep: list = []
        norms: list = []

        def layer(k: int, v: np.ndarray) -> np.ndarray:
            mask = None
            if rng is not None and self.dropout:
                mask = (rng.random(v.shape) >= self.dropout) / (1 - self.dropout)
                v = v * mask
            keep.append([v, mask])
            out, kept = self._linear(k, v, training)
            norms.append(kept)
            return out

        first = now = layer(0, x)
        pre = [now]
        now = np.maximum(now, 0)
        for k in range(1, len(self.weights) - 1):
            now = layer(k, now) + (first if self.skip else 0)
            pre.append(now)
            now = np.maximum(now, 0)
        return layer(len(self.weights) - 1, now), [keep, pre, norms]

    def gradients(self, x: np.ndarray, y: np.ndarray, multilabel: bool, rng) -> tuple[float, list[np.ndarray]]:
        """(loss, gradients in the order of ``parameters``)."""
        out, (keep, pre, norms) = self.forward(x, rng, training=True)
        if multilabel:
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            loss, d = float(np.mean(np.logaddexp(0, out) - y * out)), (p - y) / y.size
        else:
            e = np.exp(out - out.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            loss, d = float(-np.mean(np.log(np.maximum((p * y).sum(1), 1e-12)))), (p - y) / len(y)
        gw = [np.zeros_like(w) for w in self.weights]
        gb, gs, gt = ([np.zeros_like(v) for v in self.biases] for _ in range(3))
        to_first = 0
        for k in range(len(self.weights) - 1, -1, -1):
            inner = d
            if norms[k] is not None:
                flat, dev = norms[k]
                gs[k], gt[k] = (d * flat).sum(0), d.sum(0)
                g = d * self.scales[k]
                inner = (g - g.mean(0) - flat * (g * flat).mean(0)) / dev
            if k < len(gb):
                gb[k] = inner.sum(0)
            gw[k] = keep[k][0].T @ inner
            back = inner @ self.weights[k].T + (d if self.weights[k].shape[0] == self.weights[k].shape[1] else 0)
            if keep[k][1] is not None:
                back = back * keep[k][1]
            if k:
                d = back * (pre[k - 1] > 0)
                if k > 1 and self.skip:
                    to_first = to_first + d
                if k == 1:
                    d = d + to_first
        return loss, [*gw, *(gb if self.has_bias else []), *([*gs, *gt] if self.has_norm else [])]

    def dumps(self) -> str:
        parts = {n: [a.tolist() for a in getattr(self, n)] for n in ("weights", "biases", "scales", "shifts", "running")}
        return json.dumps({"shape": [self.inputs, self.hidden, self.classes, self.layers], "options": [self.dropout, self.transform, self.skip, self.seed]} | parts)

    @classmethod
    def loads(cls, text: str) -> SkipMLP:
        d = json.loads(text)
        return cls(*d["shape"], *d["options"], *([np.array(a) for a in d[n]] for n in ("weights", "biases", "scales", "shifts", "running")))


def train_mlp(
    x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray, model: SkipMLP, epochs: int = 100, patience: int = 20, batch: int = 64, lr: float = 0.005, decay: float = 0.0, multilabel: bool = False,
    keep: Callable[[str, int, SkipMLP], None] | None = None,
) -> tuple[SkipMLP, list[tuple[float, float]]]:
    """(best model, (loss, validation F1) of each epoch): Adam, halved rate after ``patience`` epochs at rest, and an early stop.

    The first epoch already counts as best. ``y`` is one-hot or multilabel.
    ``keep`` gets ("last" or "best", epoch, model) after each epoch.
    """
    rng = np.random.default_rng(model.seed + 1)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, best_at, text, history, step, still = -1.0, 0, model.dumps(), [], 0, 0
    for epoch in range(epochs):
        losses, order = [], rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            loss, grads = model.gradients(x[pick], y[pick], multilabel, rng)
            losses.append(loss)
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g + decay * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p -= lr * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        score = f1(model.forward(x_val)[0], y_val, multilabel)
        history.append((float(np.mean(losses)), score))
        if score > best + 1e-4:
            best, best_at, text, still = score, epoch, model.dumps(), 0
        else:
            still += 1
            if still % 20 == 0:
                lr /= 2
        if keep:
            keep("last", epoch, model)
            if best_at == epoch:
                keep("best", epoch, model)
        if epoch - best_at >= patience:
            break
    return SkipMLP.loads(text), history


def f1(logits: np.ndarray, y: np.ndarray, multilabel: bool = False) -> float:
    """Micro-F1; for one label a row that is accuracy. Multilabel guesses are logits over 0."""
    if not len(y):
        return 0.0
    if not multilabel:
        return float((logits.argmax(1) == y.argmax(1)).mean())
    guess = logits > 0
    tp = float((guess & (y > 0)).sum())
    return 2 * tp / max(1.0, float(guess.sum() + (y > 0).sum()))


def rows_of(df: DataFrame, most: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, one-hot labels) of (id, embedding, hot); at most ``most`` rows, in a reproducible order."""
    t = df.orderBy(lcg(F.col("id")), "id").limit(most).select(F.col("embedding").cast("array<double>").alias("x"), F.col("hot").cast("array<double>").alias("y")).toArrow()
    stack = lambda c: np.stack(t.column(c).to_numpy(zero_copy_only=False)) if t.num_rows else np.zeros((0, 1))
    return stack("x"), stack("y")


def predict(df: DataFrame, model: SkipMLP, multilabel: bool = False) -> DataFrame:
    """(id, hot, guess, label_guess): the largest logit's class, or all over 0."""
    text = model.dumps()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = SkipMLP.loads(text)
        for pdf in batches:
            if not len(pdf):
                continue
            out, _ = m.forward(np.stack(pdf["embedding"].to_numpy()))
            guess = (out > 0) if multilabel else (np.arange(out.shape[1]) == out.argmax(1)[:, None])
            yield pd.DataFrame({"id": pdf["id"], "hot": pdf["hot"], "guess": list(guess.astype(np.int32)), "label_guess": out.argmax(1).astype(np.int32)})

    return df.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("hot").cast("array<int>").alias("hot")).mapInPandas(run, "id long, hot array<int>, guess array<int>, label_guess int")
