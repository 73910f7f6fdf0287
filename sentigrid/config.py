"""Parameters of the jobs with their ranges and defaults."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Vocabularies are broadcast, so their size has a hard bound.
MAX_VOCABULARY = 10_000
# Class lists, lexicons and stopword lists are plan literals, so they are bounded too.
MAX_CLASSES = 1_000
MAX_WORD_LIST = 20_000


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, got {value}")


@dataclass(frozen=True)
class Preprocess:
    """Switches of the text preparation."""

    clean: bool = True
    stopwords: bool = True
    stem: bool = False

    @classmethod
    def compact(cls) -> "Preprocess":
        return cls(True, True, True)

    @classmethod
    def extended(cls) -> "Preprocess":
        return cls(True, True, False)


@dataclass(frozen=True)
class Training:
    """Naive Bayes training parameters."""

    test_ratio: float = 0.20
    max_features: int = 5000
    alpha_min: float = 0.1
    alpha_max: float = 2.0
    alpha_step: float = 0.1
    validation_share: float = 0.1
    seed: int = 42
    # "all": vocabulary and idf from every row; "train": from the training part alone.
    fit_on: str = "all"
    # part on which the best alpha is chosen: "test", or "val" for a part of its own
    choose_on: str = "test"

    def __post_init__(self) -> None:
        _within("test_ratio", self.test_ratio, 0.10, 0.50)
        _within("max_features", self.max_features, 1, MAX_VOCABULARY)
        _within("alpha_min", self.alpha_min, 0.1, 2.0)
        _within("alpha_max", self.alpha_max, self.alpha_min, 2.0)
        _within("validation_share", self.validation_share, 0.0, 1 - self.test_ratio)
        if self.fit_on not in ("all", "train"):
            raise ValueError("fit_on is 'all' or 'train'")
        if self.choose_on not in ("test", "val"):
            raise ValueError("choose_on is 'test' or 'val'")

    def alphas(self) -> list[float]:
        grid = np.arange(self.alpha_min, self.alpha_max + self.alpha_step, self.alpha_step)
        return [round(float(a), 10) for a in grid]


@dataclass(frozen=True)
class HeadTraining:
    """Parameters of the softmax head on dense document vectors."""

    max_length: int = 256
    score_length: int = 512
    batch_size: int = 16
    score_batch_size: int = 32
    learning_rate: float = 2e-5
    epochs: int = 3
    test_ratio: float = 0.20
    validation_share: float = 0.1
    seed: int = 42
    # "l-bfgs" and "gd" use all rows for each iteration; "adamw" takes the parameters below and the batch size
    solver: str = "l-bfgs"
    weight_decay: float = 0.01
    warmup: int = 100
    dropout: float = 0.3

    def __post_init__(self) -> None:
        _within("max_length", self.max_length, 3, 512)
        _within("epochs", self.epochs, 1, 10)
        _within("test_ratio", self.test_ratio, 0.10, 0.50)
        _within("dropout", self.dropout, 0.0, 0.5)
        if self.solver not in ("l-bfgs", "gd", "adamw"):
            raise ValueError("solver is 'l-bfgs', 'gd' or 'adamw'")
