"""Run parameters, from defaults, a mapping or a JSON file; unknown names are errors."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

ALGORITHMS = ("featpush", "featreuse", "featpca")
TRANSFORMS = ("none", "bias", "bn", "biasbn")
#: How nodes are split where no stored split is given; "restratify" deals a stored one anew, by its sizes.
SPLITS = ("stratified", "random", "by_label", "restratify")


@dataclass(frozen=True)
class Config:
    """The defaults of the propagation and training parameters."""

    algo: str = "featpush"
    epsilon: float = 0.5
    alpha: float = 0.2
    gamma: float = 0.2
    base_ratio: float = 0.04
    seed: int = 0
    rrz: float = 0.5
    epochs: int = 100
    patience: int = 20
    batch: int = 64
    lr: float = 0.005
    weight_decay: float = 0.0
    layer: int = 2
    hidden: int = 128
    dropout: float = 0.1
    bias: str = "none"
    multil: bool = False
    inductive: bool = False
    blocks: int = 10
    staged: bool = False
    split: str = "stratified"
    train: int = 0
    val: int = 0

    def __post_init__(self):
        if self.bias not in TRANSFORMS:
            raise ValueError(f"unknown bias {self.bias!r}: one of {', '.join(TRANSFORMS)}")
        if self.split not in SPLITS:
            raise ValueError(f"unknown split {self.split!r}: one of {', '.join(SPLITS)}")
        if self.algo not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algo!r}: one of {', '.join(ALGORITHMS)}")

    def having(self, values: Mapping) -> Config:
        if unknown := set(values) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return replace(self, **values)

    @classmethod
    def load(cls, path: str, **over) -> Config:
        """Values of a JSON file, over the defaults; keyword values over both."""
        with open(path) as f:
            return cls().having(json.load(f) | over)

    def dump(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    def score_name(self, part: str = "") -> str:
        """The folder of the embeddings that these parameters give; ``part`` is ``_train`` for those of the training nodes' own graph."""
        return f"{self.algo}{part}_{self.seed}/score_{self.alpha:g}_{self.epsilon:g}"
