"""Score matrices: pairs with a column of scores for each scorer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisim.errors import InvalidDatasetShape, MissingTranscription
from lexisim.functions.scorers import Scorer
from lexisim.operators.ensemble import Ensemble, combine
from lexisim.sources.schema import PAIR_SCHEMA

INPUTS = ("x_1", "x_2", "label")


@dataclass
class Row:
    """A pair of strings, with a label and transcriptions if known."""

    x_1: str
    x_2: str
    label: float | None = None
    t_1: str | None = None
    t_2: str | None = None

    def labelled(self, label: float) -> Row:
        """The same pair with a label."""
        return Row(self.x_1, self.x_2, label, self.t_1, self.t_2)

    def transcribed(self, t_1: str, t_2: str) -> Row:
        """The same pair with transcriptions."""
        return Row(self.x_1, self.x_2, self.label, t_1, t_2)


def pairs(spark: SparkSession, rows: Sequence[Row]) -> DataFrame:
    """The rows as a DataFrame of pairs."""
    return spark.createDataFrame([(r.x_1, r.x_2, r.label, r.t_1, r.t_2) for r in rows], PAIR_SCHEMA)


def pair_for(requires_transcription: bool, name: str, strict: bool = True) -> tuple[Column, Column]:
    """The columns that a scorer reads; a missing transcription raises when read (or gives null)."""
    if not requires_transcription:
        return F.col("x_1"), F.col("x_2")
    said = F.raise_error(F.lit(f"{MissingTranscription.__name__}: {name} needs t_1 and t_2")).cast("string")
    missing = F.col("t_1").isNull() | F.col("t_2").isNull()
    wrap = lambda c: F.when(missing, said).otherwise(F.col(c)) if strict else F.when(~missing, F.col(c))
    return wrap("t_1"), wrap("t_2")


def weight_text(w: float) -> str:
    """A weight as it stands in a column name: the shortest form as 32 bits, without a final .0."""
    return np.format_float_positional(np.float32(w), trim="-")


def unique_names(names: Sequence[str]) -> list[str]:
    """The names, with __2, __3... after those that came before."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return out


def _with_all(df: DataFrame) -> DataFrame:
    for c, kind in (("label", "float"), ("t_1", "string"), ("t_2", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df


def score_columns(df: DataFrame, scorers: Sequence[Scorer], strict: bool = True) -> DataFrame:
    """x_1, x_2, label and the similarity of each scorer."""
    names = unique_names([s.name for s in scorers])
    scores = [s.similarity(*pair_for(s.requires_transcription, s.name, strict)).alias(n) for s, n in zip(scorers, names, strict=True)]
    return _with_all(df).select(*INPUTS, *scores)


def ensemble_matrix(df: DataFrame, ensemble: Ensemble, strict: bool = True) -> DataFrame:
    """x_1, x_2, label, ensemble and a column name_weight for each component, with transcriptions where they are needed."""
    names = unique_names([f"{f.name}_{weight_text(f.weight)}" for f in ensemble.functions])
    scores = [f.score(*pair_for(f.requires_transcription, f.name, strict)).alias(n) for f, n in zip(ensemble.functions, names, strict=True)]
    parts = _with_all(df).select(*INPUTS, *scores)
    value = combine([(f.weight, F.col(f"`{n}`")) for f, n in zip(ensemble.functions, names, strict=True)])
    return parts.select(*INPUTS, value.alias("ensemble"), *[F.col(f"`{n}`") for n in names])


def from_precomputed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """x_1, x_2, label and the score columns ``names`` of ``df``; raises where one is missing or not a number."""
    kinds = dict(df.dtypes)
    if wrong := [n for n in (*INPUTS[:2], *names) if n not in kinds]:
        raise InvalidDatasetShape(f"no such columns: {', '.join(wrong)}")
    if wrong := [n for n in names if not kinds[n].startswith(("double", "float", "int", "bigint", "decimal"))]:
        raise InvalidDatasetShape(f"not numbers: {', '.join(wrong)}")
    return _with_all(df).select(*INPUTS, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def score_names(matrix: DataFrame) -> list[str]:
    """The score columns but the leading ensemble."""
    return [c for c in matrix.columns if c not in (*INPUTS, "ensemble")]


def as_vectors(matrix: DataFrame) -> DataFrame:
    """label and scores (an array of the component columns), for learning."""
    return matrix.select("label", F.array(*[F.col(f"`{c}`").cast("double") for c in score_names(matrix)]).alias("scores"))
