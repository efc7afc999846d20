"""A genetic search for an ensemble's weights; losses are one Spark job for each generation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.errors import EmptyEnsemble, InvalidFeatureSum, NegativeEpsilon
from lexisim.operators.ensemble import Ensemble, Mode
from lexisim.operators.loss import EDGE, Loss, population_losses
from lexisim.operators.matrix import as_vectors, ensemble_matrix

#: Score values that are searched on the driver; more stay distributed.
LOCAL_VALUES = 1 << 20


@dataclass
class GeneticConfig:
    """Size and pace of the search. ``selection`` min_loss keeps a tournament's best, max its worst."""

    population_size: int = 100
    generations: int = 50
    mutation_rate: float = 0.1
    mutation_step: float = 0.1
    tournament_size: int = 5
    elite_count: int = 2
    selection: str = "min_loss"

    def validate(self) -> None:
        """Raises if a parameter is out of range."""
        for name, wrong in (
            ("population_size", self.population_size <= 0),
            ("generations", self.generations <= 0),
            ("mutation_rate", not 0 <= self.mutation_rate <= 1),
            ("tournament_size", self.tournament_size <= 0),
            ("elite_count", not 0 <= self.elite_count <= self.population_size),
            ("selection", self.selection not in ("min_loss", "max")),
        ):
            if wrong:
                raise InvalidFeatureSum(f"{name} is {getattr(self, name)}")
        if self.mutation_step < 0:
            raise NegativeEpsilon(f"mutation_step is {self.mutation_step:g}")


def normalize(w: np.ndarray, mode: Mode) -> np.ndarray:
    """Weights brought into the mode's region; what is not finite becomes 0."""
    w = np.where(np.isfinite(w), w, 0.0)
    if mode in (Mode.CONICAL, Mode.CONVEX):
        w = np.maximum(w, 0.0)
    if mode in (Mode.AFFINE, Mode.CONVEX):
        total = w.sum()
        small = total <= 1e-6 if mode is Mode.CONVEX else abs(total) <= 1e-6
        w = np.full(len(w), 1 / len(w)) if small else w / total
    return w


def initialize(rng: np.random.Generator, size: int, k: int, mode: Mode) -> np.ndarray:
    """``size`` vectors of ``k`` uniform weights, normalised."""
    return np.stack([normalize(rng.random(k), mode) for _ in range(size)])


def tournament(rng: np.random.Generator, losses: np.ndarray, config: GeneticConfig) -> int:
    """One of ``tournament_size`` individuals drawn with replacement."""
    drawn = rng.integers(0, len(losses), config.tournament_size)
    pick = np.argmin if config.selection == "min_loss" else np.argmax
    return int(drawn[pick(losses[drawn])])


def blend(rng: np.random.Generator, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A random point between two parents."""
    share = rng.random()
    return share * a + (1 - share) * b


def mutate(rng: np.random.Generator, w: np.ndarray, rate: float, step: float) -> np.ndarray:
    """Each weight changed with probability ``rate`` by up to ``step``."""
    return w + (rng.random(len(w)) < rate) * rng.uniform(-step, step, len(w))


def _losses_of(scores: np.ndarray, labels: np.ndarray, people: np.ndarray, of: str) -> np.ndarray:
    """Summed losses of all individuals over a block of rows."""
    p = np.clip(scores @ people.T, 0, 1)
    y = labels[:, None]
    if of == "mse":
        return ((p - y) ** 2).sum(0)
    if of == "mae":
        return np.abs(p - y).sum(0)
    p = np.clip(p, EDGE, 1 - EDGE)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(0)


class Evaluator:
    """Losses of a population over rows of (label, scores), kept for all generations."""

    def __init__(self, rows: DataFrame, of: str | Loss = "mse"):
        self.of = of
        self.rows = rows.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), "scores").persist()
        self.n = self.rows.count()
        width = self.rows.select(F.max(F.size("scores"))).first()[0] or 0
        self.local = None
        if isinstance(of, str) and self.n * width <= LOCAL_VALUES:
            got = self.rows.collect()
            self.local = np.array([r["scores"] for r in got], float).reshape(len(got), -1), np.array([r["label"] for r in got], float)

    def losses(self, people: np.ndarray) -> np.ndarray:
        """Mean loss of each individual; infinite without labels."""
        if not self.n:
            return np.full(len(people), np.inf)
        if self.local is not None:
            return _losses_of(*self.local, people, self.of) / self.n
        if not isinstance(self.of, str):
            got = {r["ind"]: r["loss"] for r in population_losses(self.rows, people.tolist(), self.of).collect()}
            return np.array([got[k] for k in range(len(people))])
        of = self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(people))
            for b in batches:
                width = people.shape[1]
                total += _losses_of(b.column(1).flatten().to_numpy().reshape(-1, width), b.column(0).to_numpy(), people, of)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(people))), pa.array(total)], ["ind", "v"])

        got = self.rows.mapInArrow(run, "ind long, v double").groupBy("ind").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(people))
        for r in got:
            out[r["ind"]] = r["v"] / self.n
        return out

    def close(self) -> None:
        """Drops the kept rows."""
        self.rows.unpersist()


def optimize(ensemble: Ensemble, config: GeneticConfig, rows: DataFrame, of: str | Loss = "mse", seed: int | None = None) -> tuple[Ensemble, float]:
    """The ensemble with the best weights found, and their loss.

    ``rows`` are pairs (they are scored first) or have label and scores.
    """
    if not ensemble.functions:
        raise EmptyEnsemble("an ensemble needs a component")
    config.validate()
    if "scores" not in rows.columns:
        rows = as_vectors(ensemble_matrix(rows, ensemble))
    rng, evaluator = np.random.Generator(np.random.PCG64(seed)), Evaluator(rows, of)
    try:
        people = initialize(rng, config.population_size, len(ensemble.functions), ensemble.mode)
        for _ in range(config.generations):
            losses = evaluator.losses(people)
            order = np.argsort(losses, kind="stable")
            people, losses = people[order], losses[order]
            made = [people[k] for k in range(min(config.elite_count, len(people)))]
            while len(made) < config.population_size:
                child = blend(rng, people[tournament(rng, losses, config)], people[tournament(rng, losses, config)])
                made.append(normalize(mutate(rng, child, config.mutation_rate, config.mutation_step), ensemble.mode))
            people = np.stack(made)
        losses = evaluator.losses(people)
        best = int(np.argmin(losses))
    finally:
        evaluator.close()
    return ensemble.with_weights(people[best].tolist()), float(losses[best])
