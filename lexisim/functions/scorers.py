"""Scorers of string pairs as lazy Column expressions.

A scorer is a small configuration with ``similarity(x, y)`` and, where defined,
``distance`` and ``normalized_distance``; each takes and gives Columns. What
built-in expressions can do runs in the JVM; alignments whose state they can't
carry run as Arrow UDFs over batches. Nulls give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisim.errors import DistanceNotSupported, InvalidNGramSize, InvalidPrefixScale, InvalidTverskyParameter, UnknownToken
from lexisim.functions import kernels
from lexisim.functions.aline import AlineTables
from lexisim.functions.text import chars, clip, common_prefix, folded, grams, letters, longest, sounds


def _pair_udf(encode: Callable[[object], np.ndarray], kernel: kernels.Kernel) -> Callable[[Column, Column], Column]:
    """The kernel as an Arrow UDF of two columns of strings, or of arrays of strings."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        freeze = lambda v: tuple(v) if isinstance(v, list) else v
        pairs = [None if a is None or b is None else (freeze(a), freeze(b)) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        return pa.array(kernels.over_pairs(pairs, encode, kernel), pa.float64())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def _string_udf(kernel: kernels.Kernel) -> Callable[[Column, Column], Column]:
    """The kernel as an Arrow UDF of two columns of strings, over their code points."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return kernels.over_strings(x, y, kernel)

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def _unknown(tokens: Column, known: Callable[[Column], Column], scorer: str, kind: str, side: str) -> tuple[Column, Column]:
    """Whether all ``tokens`` are known, and an error that names the first that is not, its place from 0 and its side."""
    odd = F.filter(F.transform(tokens, lambda t, k: F.struct(t.alias("t"), k.alias("k"))), lambda p: ~known(p["t"]))
    first = F.get(odd, F.lit(0))
    said = F.concat(F.lit(f"{UnknownToken.__name__}: {scorer} knows no {kind} "), first["t"], F.lit(" at "), first["k"].cast("string"), F.lit(f" of {side}"))
    return F.size(odd) == 0, F.raise_error(said)


def _known_or_null(v: Column, x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), v)


class Scorer:
    """What all scorers share."""

    requires_transcription: ClassVar[bool] = False

    @property
    def name(self) -> str:
        """The scorer's name, as used for columns."""
        return type(self).__name__

    def similarity(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def distance(self, x: Column, y: Column) -> Column:
        raise DistanceNotSupported(f"{self.name} has no distance")

    def normalized_distance(self, x: Column, y: Column) -> Column:
        raise DistanceNotSupported(f"{self.name} has no distance")

    def validate(self) -> None:
        """Raises if the configuration is not valid."""

    def to_dict(self) -> dict:
        """The configuration as plain values."""
        return asdict(self)


@dataclass
class Levenshtein(Scorer):
    """Weighted edit distance; normalised by the longer length."""

    costs: dict[str, float] = field(default_factory=lambda: {"insert": 1.0, "delete": 1.0, "substitute": 1.0})
    case_insensitive: bool = False

    def distance(self, x: Column, y: Column) -> Column:
        x, y = folded(x, self.case_insensitive), folded(y, self.case_insensitive)
        insert, delete, substitute = (float(self.costs[k]) for k in ("insert", "delete", "substitute"))
        if insert == delete == substitute >= 0:
            return F.levenshtein(x, y) * F.lit(insert)
        return _pair_udf(kernels.code_points, kernels.edit_distance(insert, delete, substitute))(x, y)

    def normalized_distance(self, x: Column, y: Column) -> Column:
        # Limited by least and greatest, which name the distance once: it is worked out once a pair.
        size = longest(folded(x, self.case_insensitive), folded(y, self.case_insensitive))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), self.distance(x, y) / size))
        return F.when(size == 0, F.lit(0.0)).when(size > 0, share)

    def similarity(self, x: Column, y: Column) -> Column:
        return F.lit(1.0) - self.normalized_distance(x, y)


@dataclass
class JaroWinkler(Scorer):
    """Jaro similarity with a prefix bonus that always counts."""

    prefix_scale: float = 0.1
    max_prefix_length: int = 4
    case_insensitive: bool = False

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        if not 0 <= self.prefix_scale <= 0.25:
            raise InvalidPrefixScale(f"prefix_scale is {self.prefix_scale:g}")

    def jaro(self, x: Column, y: Column) -> Column:
        """The Jaro similarity alone."""
        return _string_udf(kernels.jaro)(folded(x, self.case_insensitive), folded(y, self.case_insensitive))

    def similarity(self, x: Column, y: Column) -> Column:
        kernel = kernels.jaro_winkler(float(self.prefix_scale), self.max_prefix_length)
        return _string_udf(kernel)(folded(x, self.case_insensitive), folded(y, self.case_insensitive))

    def distance(self, x: Column, y: Column) -> Column:
        return clip(1 - self.similarity(x, y))

    def normalized_distance(self, x: Column, y: Column) -> Column:
        return self.distance(x, y)


def _shared_share(shared: Column, m: Column, n: Column) -> Column:
    """shared / longer, 1 for two empty sides, 0 for one; null for nulls."""
    most = F.greatest(m, n)
    return F.when(m.isNull() | n.isNull(), F.lit(None).cast("double")).when(most == 0, F.lit(1.0)).when(F.least(m, n) == 0, F.lit(0.0)).otherwise(shared / most)


@dataclass
class LCS(Scorer):
    """Longest common subsequence over the longer length."""

    case_insensitive: bool = False

    def similarity(self, x: Column, y: Column) -> Column:
        x, y = folded(x, self.case_insensitive), folded(y, self.case_insensitive)
        return _shared_share(_pair_udf(kernels.code_points, kernels.common_subsequence)(x, y), F.char_length(x), F.char_length(y))


@dataclass
class LCSuf(Scorer):
    """Longest common suffix over the longer length."""

    case_insensitive: bool = False

    def similarity(self, x: Column, y: Column) -> Column:
        return _string_udf(kernels.suffix_share)(folded(x, self.case_insensitive), folded(y, self.case_insensitive))


@dataclass
class Prefix(Scorer):
    """Common prefix over the longer length."""

    case_insensitive: bool = False

    def similarity(self, x: Column, y: Column) -> Column:
        x, y = folded(x, self.case_insensitive), folded(y, self.case_insensitive)
        return clip(_shared_share(common_prefix(x, y), F.char_length(x), F.char_length(y)))

    def kernel_udf(self) -> Callable[[Column, Column], Column]:
        """The similarity of two strings as they are, for many pairs: whole batches outside the JVM."""
        return _string_udf(kernels.prefix_share)


def _bigram_codes(s: str) -> np.ndarray:
    c = kernels.code_points(s)
    return c[:0] if not len(c) else np.concatenate([c[:1], c[:-1]]) << 21 | c


@dataclass
class BiSim(Scorer):
    """Longest common subsequence of bigrams, the first letter doubled, over the larger number of bigrams."""

    case_insensitive: bool = True

    def similarity(self, x: Column, y: Column) -> Column:
        x, y = folded(x, self.case_insensitive), folded(y, self.case_insensitive)
        return _shared_share(_pair_udf(_bigram_codes, kernels.common_subsequence)(x, y), F.char_length(x), F.char_length(y))


@dataclass
class NGram(Scorer):
    """Similarity of padded character n-grams by one of five metrics.

    ``metric`` is dice, jaccard, overlap, cosine or ``{"tversky": {"alpha": a, "beta": b}}``.
    """

    n: int = 2
    before_padding: int = 1
    after_padding: int = 1
    case_insensitive: bool = True
    metric: str | dict = "dice"

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        if self.n < 1:
            raise InvalidNGramSize(f"n is {self.n}")
        for k in ("alpha", "beta") if isinstance(self.metric, dict) else ():
            if not math.isfinite(v := self.metric["tversky"][k]) or v < 0:
                raise InvalidTverskyParameter(f"{k} is {v}")

    @property
    def name(self) -> str:
        return f"NGram_{self.n}_{self.before_padding}_{self.after_padding}"

    def similarity(self, x: Column, y: Column) -> Column:
        if self.metric != "cosine":
            kernel = kernels.gram_share(self.n, self.before_padding, self.after_padding, self._share)
            return _string_udf(kernel)(folded(x, self.case_insensitive), folded(y, self.case_insensitive))
        a, b = (grams(folded(s, self.case_insensitive), self.n, self.before_padding, self.after_padding) for s in (x, y))
        # One struct holds both lists of grams, so the nested counts do not make them anew for each gram.
        held = F.array(F.struct(a.alias("a"), b.alias("b")))
        return _known_or_null(clip(F.get(F.transform(held, lambda s: self._cosine(s["a"], s["b"])), F.lit(0))), a, b)

    def _share(self, both: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.metric == "dice":
            above, below = 2 * both, m + n
        elif self.metric == "jaccard":
            above, below = both, m + n - both
        elif self.metric == "overlap":
            above, below = both, np.minimum(m, n)
        else:
            t = self.metric["tversky"]
            above, below = both, both + float(t["alpha"]) * (m - both) + float(t["beta"]) * (n - both)
        return np.where(below == 0, 1.0, np.clip(above / np.where(below == 0, 1, below), 0.0, 1.0))

    def _cosine(self, a: Column, b: Column) -> Column:
        times = lambda grams_, g: F.size(F.filter(grams_, lambda x: x == g)).cast("double")
        total = lambda of: F.aggregate(of, F.lit(0.0), lambda s, v: s + v)
        norm = lambda s: total(F.transform(F.array_distinct(s), lambda g: times(s, g) * times(s, g)))
        dot = total(F.transform(F.array_intersect(a, b), lambda g: times(a, g) * times(b, g)))
        empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
        return F.when(empty == 2, F.lit(1.0)).when(empty == 1, F.lit(0.0)).otherwise(dot / (F.sqrt(norm(a)) * F.sqrt(norm(b))))


# Letters that sound alike.
LETTER_GROUPS = ["aehiouwy", "bp", "ckq", "dt", "lr", "mn", "gj", "fpv", "sxz", "csz"]


def _letter_groups() -> dict[str, list[int]]:
    return {c: [k for k, g in enumerate(LETTER_GROUPS) if c in g] for c in sorted(set("".join(LETTER_GROUPS)))}


@dataclass
class Editex(Scorer):
    """Phonetic edit distance over groups of letters; case and other characters are ignored.

    ``strict`` raises for letters without a group when the data is read; otherwise such pairs give null.
    """

    costs: dict[str, float] = field(default_factory=lambda: {"same": 1.0, "diff": 2.0})
    group: dict[str, list[int]] = field(default_factory=_letter_groups)
    strict: bool = True

    def _checked(self, s: Column, side: str = "the string") -> Column:
        t = letters(s)
        fine, error = _unknown(chars(t), lambda c: c.isin(*self.group) if self.group else F.lit(False), "Editex", "letter", side)
        return F.when(fine, t) if not self.strict else F.when(~fine, error.cast("string")).otherwise(t)

    def _matrices(self) -> tuple[np.ndarray, np.ndarray]:
        same, diff = float(self.costs["same"]), float(self.costs["diff"])
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        near = np.array([[bool(set(self.group.get(a, ())) & set(self.group.get(b, ()))) for b in alphabet] for a in alphabet])
        gap = np.where(near, same, diff)
        swap = np.where(np.eye(26, dtype=bool), 0.0, gap)
        return gap, swap

    def kernel_udf(self) -> Callable[[Column, Column], Column]:
        """The distance of two strings of lower-case letters."""
        gap, swap = self._matrices()
        kernel = kernels.grouped_edit_distance(gap, swap, float(self.costs["diff"]))
        return _pair_udf(lambda s: kernels.code_points(s) - 97, kernel)

    def distance(self, x: Column, y: Column) -> Column:
        return self.kernel_udf()(self._checked(x, "x"), self._checked(y, "y"))

    def _most(self, s: Column, side: str = "the string") -> Column:
        """Cost of deleting all letters."""
        t = chars(self._checked(s, side))
        n = F.size(t)
        # Each letter with the next; the last has none and counts for nothing.
        both = F.zip_with(t, F.slice(t, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))
        close = F.size(F.filter(both, lambda g: g.isin(self.near_letters())))
        return F.when(n == 0, F.lit(0.0)).when(n > 0, F.lit(float(self.costs["diff"])) * (n - close) + F.lit(float(self.costs["same"])) * close)

    def near_letters(self) -> list[str]:
        """Pairs of letters that share a group."""
        return [a + b for a in self.group for b in self.group if set(self.group[a]) & set(self.group[b])]

    def normalized_distance(self, x: Column, y: Column) -> Column:
        # Bound once: neither side's letters nor the alignment are made anew for each branch.
        both = F.array(F.struct(self.distance(x, y).alias("d"), (self._most(x, "x") + self._most(y, "y")).alias("m")))
        return F.get(F.transform(both, lambda p: F.when(p["m"] == 0, F.lit(0.0)).otherwise(clip(p["d"] / p["m"]))), F.lit(0))

    def similarity(self, x: Column, y: Column) -> Column:
        return F.get(F.transform(F.array(self.normalized_distance(x, y)), lambda v: clip(1 - v)), F.lit(0))


@dataclass
class Aline(Scorer):
    """Articulatory-feature alignment of transcriptions, over the larger self score."""

    tables: AlineTables = field(default_factory=AlineTables)
    strict: bool = True
    requires_transcription: ClassVar[bool] = True

    def validate(self) -> None:
        self.tables.validate()

    def to_dict(self) -> dict:
        return self.tables.to_dict()

    def _checked(self, s: Column, side: str = "the string") -> Column:
        t = sounds(s)
        fine, error = _unknown(t, lambda g: g.isin(*self.tables.sounds), "Aline", "sound", side)
        return F.when(fine, t) if not self.strict else F.when(~fine, error.cast("array<string>")).otherwise(t)

    def kernel_udf(self) -> Callable[[Column, Column], Column]:
        """The similarity of two arrays of sounds."""
        symbols, delta, vowel = self.tables.matrices()
        costs = self.tables.costs
        swap = costs["substitute"] - delta - vowel[:, None] - vowel[None, :]

        def widen(one: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
            return costs["expand_compress"] - delta[one, before] - delta[one, at] - vowel[one] - np.maximum(vowel[before], vowel[at])

        number = {s: k for k, s in enumerate(symbols)}
        encode = lambda tokens: np.array([number[t] for t in tokens], np.int64)
        align = kernels.local_alignment(float(costs["skip"]), swap, widen)

        def relative(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
            most = np.maximum(kernels.alone(align, a, m), kernels.alone(align, b, n))
            return np.where(most == 0, 0.0, align(a, m, b, n) / np.where(most == 0, 1.0, most))

        return _pair_udf(encode, relative)

    def similarity(self, x: Column, y: Column) -> Column:
        return self.kernel_udf()(self._checked(x, "x"), self._checked(y, "y"))


SCORERS = {c.__name__: c for c in (Aline, BiSim, Editex, JaroWinkler, LCS, LCSuf, Levenshtein, NGram, Prefix)}
