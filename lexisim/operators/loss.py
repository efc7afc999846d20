"""Losses of weighted scores against labels, as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisim.functions.text import clip

#: How close a prediction may come to 0 or 1 in the cross entropy.
EDGE = 1e-7
Loss = Callable[[Column, Column], Column]


def predict(scores: Column, weights: Column | Sequence[float]) -> Column:
    """Sum of score times weight, limited to 0 and 1; it is not divided by the weights' sum."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(v)) for v in weights])
    return clip(F.aggregate(F.zip_with(scores, w, lambda s, v: s * v), F.lit(0.0), lambda a, v: a + v))


def squared(p: Column, label: Column) -> Column:
    """Squared error of a row."""
    return (p - label) * (p - label)


def absolute(p: Column, label: Column) -> Column:
    """Absolute error of a row."""
    return F.abs(p - label)


def cross_entropy(p: Column, label: Column) -> Column:
    """Binary cross entropy of a row."""
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return -(label * F.ln(q) + (1 - label) * F.ln(1 - q))


LOSSES: dict[str, Loss] = {"mse": squared, "mae": absolute, "bce": cross_entropy}


def loss(rows: DataFrame, weights: Sequence[float], of: str | Loss = "mse") -> float:
    """Mean loss over labelled rows of (label, scores); infinite without labels."""
    each = LOSSES[of] if isinstance(of, str) else of
    value = rows.where(F.col("label").isNotNull()).agg(F.avg(each(predict(F.col("scores"), weights), F.col("label").cast("double")))).first()[0]
    return float("inf") if value is None else float(value)


def population_losses(rows: DataFrame, population: Sequence[Sequence[float]], of: str | Loss = "mse") -> DataFrame:
    """ind and loss of each individual of a population, in one pass over the rows.

    The population is a literal array (its size is a parameter of the search), so each row makes one partial result
    for each individual, summed before the shuffle.
    """
    each = LOSSES[of] if isinstance(of, str) else of
    people = F.array(*[F.struct(F.lit(k).alias("ind"), F.array(*[F.lit(float(v)) for v in w]).alias("w")) for k, w in enumerate(population)])
    wide = rows.where(F.col("label").isNotNull()).select("label", "scores", F.explode(people).alias("p"))
    value = each(predict(F.col("scores"), F.col("p.w")), F.col("label").cast("double"))
    return wide.select(F.col("p.ind").alias("ind"), value.alias("v")).groupBy("ind").agg(F.avg("v").alias("loss"))
