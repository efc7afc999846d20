"""Articulatory-feature alignment of transcriptions: sound inventory, feature values and scores."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np

from lexisim.errors import InvalidFeatureSum, NegativeEpsilon

BINARY = ("syllabic", "voice", "nasal", "retroflex", "lateral", "aspirated", "long", "round")

# Costs, saliences and feature values.
COSTS = {"skip": -10, "substitute": 35, "expand_compress": 45, "vowel_consonant": 5}
SALIENCE = {
    "syllabic": 5, "place": 40, "manner": 50, "voice": 5, "nasal": 20, "retroflex": 10, "lateral": 10, "aspirated": 5,
    "long": 0, "high": 3, "back": 2, "round": 2, "phonation": 10, "airstream": 10, "secondary": 10,
}
VALUES = {
    "place": {
        "bilabial": 1.0, "labiodental": 0.95, "linguolabial": 0.92, "dental": 0.9, "alveolar": 0.85, "retroflex": 0.8, "palato_alveolar": 0.75, "alveolo_palatal": 0.72,
        "palatal": 0.7, "velar": 0.6, "uvular": 0.5, "pharyngeal": 0.3, "epiglottal": 0.2, "glottal": 0.1, "labiovelar": 1.0, "vowel": -1.0,
    },
    "manner": {
        "stop": 1.0, "affricate": 0.9, "fricative": 0.85, "lateral_fricative": 0.8, "trill": 0.7, "tap": 0.65, "lateral_flap": 0.6, "approximant": 0.6,
        "high_vowel": 0.4, "mid_vowel": 0.2, "low_vowel": 0.0, "vowel": 0.5,
    },
    "high": {"high": 1.0, "near_high": 0.85, "high_mid": 0.65, "mid": 0.5, "low_mid": 0.35, "near_low": 0.15, "low": 0.0},
    "back": {"front": 1.0, "near_front": 0.75, "central": 0.5, "near_back": 0.25, "back": 0.0},
    "binary": {"plus": 1.0, "minus": 0.0},
    "phonation": {"modal": 1.0, "breathy": 0.75, "creaky": 0.5, "stiff": 0.25, "slack": 0.0},
    "airstream": {"pulmonic": 1.0, "ejective": 0.66, "implosive": 0.33, "click": 0.0},
    "secondary": {"none": 1.0, "labialized": 0.75, "palatalized": 0.5, "velarized": 0.25, "pharyngealized": 0.0},
}

# Vowels as "back high: symbols (+ features)"; all are syllabic and voiced, place and manner vowel.
VOWELS = """
back high +round: u ʊ
back high +round +long: U
back high: ɯ
back low +round: ɒ
back low: ɑ
back mid +round: o o̞ ɔ
back mid +round +long: O
back mid: ɤ ɤ̞ ʌ
central high +round: ʉ
central high: ɨ
central low: ä ɐ
central mid +round: ɞ ɵ
central mid: ɘ ə ɜ
front high +long: I
front high +round: y ʏ
front high: i
front low +long: A
front low +round: ɶ
front low: a æ
front mid +long: E
front mid +round: ø ø̞ œ
front mid: e e̞ ɛ
"""
# Consonants as "place manner: symbols (+ features)"; none is syllabic or aspirated.
CONSONANTS = """
alveolar approximant +voice: ɹ
alveolar approximant +voice +lateral: l
alveolar fricative +lateral: ɬ
alveolar fricative +voice: z
alveolar fricative +voice +lateral: ɮ
alveolar fricative: s
alveolar stop +voice: d
alveolar stop +voice +nasal: n
alveolar stop: t
alveolar tap +voice: ɾ
alveolar trill +voice +retroflex: r
bilabial fricative +voice: β
bilabial fricative: ɸ
bilabial stop +voice: b
bilabial stop +voice +nasal: m
bilabial stop: p
bilabial trill +voice: B ʙ
dental fricative +voice: ð
dental fricative: θ
glottal fricative +voice: ɦ
glottal fricative: h
glottal stop: ʔ
labiodental approximant +voice: ʋ
labiodental fricative +voice: v
labiodental fricative: f
labiodental stop +voice +nasal: ɱ
labiovelar approximant +voice: w
palatal approximant +voice: j
palatal fricative +voice: ʝ
palatal fricative: ç
palatal stop +voice: ɟ
palatal stop +voice +nasal: ɲ
palatal stop: c
palato_alveolar affricate +voice: ʤ
palato_alveolar affricate: ʧ
palato_alveolar fricative +voice: ʒ
palato_alveolar fricative: ʃ
pharyngeal fricative +voice: ʕ
pharyngeal fricative: ħ
retroflex approximant +voice +retroflex: ɻ
retroflex fricative +retroflex: ʂ
retroflex fricative +voice +retroflex: ʐ
retroflex stop +retroflex: ʈ
retroflex stop +voice +nasal +retroflex: ɳ
retroflex stop +voice +retroflex: ɖ
retroflex tap +voice +retroflex: ɽ
uvular fricative +voice: ʁ
uvular fricative: χ
uvular stop +voice: ɢ
uvular stop +voice +nasal: N ɴ
uvular stop: q
uvular trill +voice: R ʀ
velar approximant +voice: ɰ
velar fricative +voice: ɣ
velar fricative: x
velar stop +voice: g
velar stop +voice +nasal: ŋ
velar stop: k
"""


def sound_inventory() -> dict[str, dict[str, str]]:
    """Each sound's features by name, from the two tables."""
    out: dict[str, dict[str, str]] = {}
    plain = {"phonation": "modal", "airstream": "pulmonic", "secondary": "none"}
    for kind, table in (("vowel", VOWELS), ("consonant", CONSONANTS)):
        for line in table.strip().splitlines():
            head, _, symbols = line.partition(":")
            names = head.split()
            given = {n[1:] for n in names if n[0] == "+"}
            flags = {b: "plus" if b in given else "minus" for b in BINARY}
            if kind == "vowel":
                flags |= {"syllabic": "plus", "voice": "plus"}
                own = {"type": kind, "place": "vowel", "manner": "vowel", "back": names[0], "high": names[1], **flags, **plain}
                own.pop("aspirated")
            else:
                own = {"type": kind, "place": names[0], "manner": names[1], **flags, **plain}
                own.pop("long")
                own.pop("round")
            for symbol in symbols.split():
                out[symbol] = dict(own)
    return out


#: Features that count when either sound is a consonant, and when both are vowels.
CONSONANT_FEATURES = ("place", "manner", "syllabic", "voice", "nasal", "retroflex", "lateral", "aspirated", "phonation", "airstream", "secondary")
VOWEL_FEATURES = ("back", "lateral", "long", "manner", "nasal", "place", "retroflex", "round", "syllabic", "voice", "phonation", "secondary")


@dataclass
class AlineTables:
    """Costs, saliences, feature values and sounds of the alignment."""

    costs: dict[str, int] = field(default_factory=lambda: dict(COSTS))
    salience: dict[str, int] = field(default_factory=lambda: dict(SALIENCE))
    values: dict[str, dict[str, float]] = field(default_factory=lambda: {k: dict(v) for k, v in VALUES.items()})
    sounds: dict[str, dict[str, str]] = field(default_factory=sound_inventory)
    epsilon: float = 0.001

    def validate(self) -> None:
        """Each table of values sums to 1 and epsilon is not negative; opt-in, as common tables do not sum to 1."""
        for name, table in self.values.items():
            if abs(sum(table.values()) - 1) > 1e-4:
                raise InvalidFeatureSum(f"values of {name} sum to {sum(table.values()):g}")
        if self.epsilon < 0:
            raise NegativeEpsilon(f"epsilon is {self.epsilon:g}")

    def matrices(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Symbols, their distances delta, and their vowel terms."""
        symbols = list(self.sounds)
        vowel = np.array([self.sounds[s]["type"] == "vowel" for s in symbols])

        def numbers(feature: str) -> np.ndarray:
            table = self.values["binary" if feature in BINARY else feature]
            return np.array([table[self.sounds[s].get(feature, "minus")] if feature in BINARY else table.get(self.sounds[s].get(feature), 0.0) for s in symbols])

        def total(features: tuple[str, ...]) -> np.ndarray:
            return sum(self.salience[f] * np.abs(numbers(f)[:, None] - numbers(f)[None, :]) for f in features)

        delta = np.where(vowel[:, None] & vowel[None, :], total(VOWEL_FEATURES), total(CONSONANT_FEATURES))
        return symbols, delta, np.where(vowel, float(self.costs["vowel_consonant"]), 0.0)

    def to_dict(self) -> dict:
        """The tables as plain dictionaries."""
        return asdict(self)
