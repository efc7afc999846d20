"""Weighted ensembles of scorers under linear, conical, affine or convex constraints."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisim.errors import EmptyEnsemble, InvalidWeight, NegativeWeight, NonFiniteWeight, WeightsDoNotSumToOne
from lexisim.functions.scorers import Scorer
from lexisim.functions.text import clip

#: How far a sum of weights may be from 1.
NEAR_ONE = 1e-4


class Mode(Enum):
    """What an ensemble asks of its weights."""

    LINEAR = "linear"
    CONICAL = "conical"
    AFFINE = "affine"
    CONVEX = "convex"


@dataclass
class WeightedFunction:
    """A named function of two Columns with a weight; it may need transcriptions."""

    name: str
    weight: float
    function: Callable[[Column, Column], Column]
    requires_transcription: bool = False

    @classmethod
    def from_function(cls, name: str, weight: float, requires_transcription: bool, function: Callable[[Column, Column], Column]) -> WeightedFunction:
        """Any function of two Columns, a UDF as well."""
        return cls(name, weight, function, requires_transcription)

    @classmethod
    def from_similarity(cls, scorer: Scorer, weight: float) -> WeightedFunction:
        return cls(scorer.name, weight, scorer.similarity, scorer.requires_transcription)

    @classmethod
    def from_normalized_distance(cls, scorer: Scorer, weight: float) -> WeightedFunction:
        return cls(scorer.name, weight, scorer.normalized_distance, scorer.requires_transcription)

    @classmethod
    def from_distance(cls, scorer: Scorer, weight: float) -> WeightedFunction:
        """The raw distance, which may be over 1."""
        return cls(scorer.name, weight, scorer.distance, scorer.requires_transcription)

    def score(self, x: Column, y: Column) -> Column:
        """The function's value, without its weight."""
        return self.function(x, y)


class Ensemble(Scorer):
    """A weighted combination of functions; a scorer itself, so ensembles nest."""

    def __init__(self, functions: Sequence[WeightedFunction], mode: Mode = Mode.LINEAR, validate: bool = True):
        self.functions, self.mode = list(functions), mode
        if validate:
            self.validate()

    @property
    def name(self) -> str:
        return "EnsembleAlgorithm"

    @property
    def weights(self) -> list[float]:
        """The weights in order."""
        return [f.weight for f in self.functions]

    def with_weights(self, weights: Sequence[float], validate: bool = True) -> Ensemble:
        """The same functions with other weights."""
        made = [WeightedFunction(f.name, float(w), f.function, f.requires_transcription) for f, w in zip(self.functions, weights, strict=True)]
        return Ensemble(made, self.mode, validate)

    def validate(self) -> None:
        if not self.functions:
            raise EmptyEnsemble("an ensemble needs a component")
        w = self.weights
        if not all(map(math.isfinite, w)):
            raise NonFiniteWeight(f"weights are {w}")
        if self.mode in (Mode.CONICAL, Mode.CONVEX) and min(w) < 0:
            raise NegativeWeight(f"weights are {w}")
        if self.mode in (Mode.LINEAR, Mode.CONICAL) and sum(w) == 0:
            raise InvalidWeight("weights sum to 0")
        if self.mode in (Mode.AFFINE, Mode.CONVEX) and not abs(sum(w) - 1) < NEAR_ONE:
            raise WeightsDoNotSumToOne(f"weights sum to {sum(w):g}")

    def similarity(self, x: Column, y: Column) -> Column:
        """Components with weight 0 are not part of the plan; all get the same two columns."""
        return combine([(f.weight, f.score(x, y)) for f in self.functions if f.weight])

    def to_dict(self) -> dict:
        return {"mode": self.mode.value, "weights": dict(zip([f.name for f in self.functions], self.weights, strict=True))}


def combine(parts: Sequence[tuple[float, Column]]) -> Column:
    """Sum of weight times score over the sum of absolute weights, limited to 0 and 1; 0 without weights."""
    most = sum(abs(w) for w, _ in parts)
    if not most:
        return F.lit(0.0)
    total = F.lit(0.0)
    for w, score in parts:
        total = total + F.lit(float(w)) * score
    return clip(total / F.lit(most))
