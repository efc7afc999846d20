"""Errors of configurations (raised when a plan is built) and of data."""

from __future__ import annotations


class LexisimError(ValueError):
    """The root of all errors raised here."""


def _kind(name: str, doc: str) -> type[LexisimError]:
    return type(name, (LexisimError,), {"__doc__": doc, "__module__": __name__})


UnknownToken = _kind("UnknownToken", "A token is not in the scorer's inventory.")
InvalidFeatureSum = _kind("InvalidFeatureSum", "A table of feature values does not sum to 1, or a count is out of range.")
NegativeEpsilon = _kind("NegativeEpsilon", "A tolerance or step is negative.")
InvalidPrefixScale = _kind("InvalidPrefixScale", "A prefix scale is not within 0 and 0.25.")
DistanceNotSupported = _kind("DistanceNotSupported", "The scorer has no distance.")
InvalidNGramSize = _kind("InvalidNGramSize", "An n-gram size is below 1.")
InvalidTverskyParameter = _kind("InvalidTverskyParameter", "A Tversky coefficient is negative or not finite.")
EmptyEnsemble = _kind("EmptyEnsemble", "An ensemble has no components.")
NonFiniteWeight = _kind("NonFiniteWeight", "A weight is not finite.")
NegativeWeight = _kind("NegativeWeight", "A weight is negative where the mode forbids it.")
WeightsDoNotSumToOne = _kind("WeightsDoNotSumToOne", "Weights do not sum to 1 where the mode asks for it.")
InvalidWeight = _kind("InvalidWeight", "Weights sum to 0.")
InvalidExtension = _kind("InvalidExtension", "A file has another extension than its format.")
TomlError = _kind("TomlError", "A TOML file can't be read or written.")
InvalidDatasetShape = _kind("InvalidDatasetShape", "A table or fraction does not have the shape asked for.")
MissingTranscription = _kind("MissingTranscription", "A scorer needs transcriptions and a row has none.")
