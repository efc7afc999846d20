"""Scorers against values worked by hand, published alignment scores and plain recursive definitions."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lexisim import errors
from lexisim.functions.aline import AlineTables, sound_inventory
from lexisim.functions.scorers import LCS, SCORERS, Aline, BiSim, Editex, JaroWinkler, LCSuf, Levenshtein, NGram, Prefix

TVERSKY = {"tversky": {"alpha": 0.7, "beta": 0.3}}


def values(spark, pairs, *columns):
    """Each column's values over the pairs, in one job."""
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x string, y string")
    rows = df.select("k", *[c.alias(f"v{j}") for j, c in enumerate(columns)]).orderBy("k").collect()
    return [[r[f"v{j}"] for r in rows] for j in range(len(columns))]


X = Y = None  # columns need a session


@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(X=F.col("x"), Y=F.col("y"))


HAND = [
    (Levenshtein().distance, "kitten", "sitting", 3),
    (Levenshtein().normalized_distance, "kitten", "sitting", 3 / 7),
    (Levenshtein().similarity, "kitten", "sitting", 4 / 7),
    (JaroWinkler().jaro, "dixon", "dicksonx", 0.766667),
    (JaroWinkler().similarity, "dixon", "dicksonx", 0.813333),
    (JaroWinkler().jaro, "martha", "marhta", 17 / 18),
    (JaroWinkler().similarity, "martha", "marhta", 0.961111),
    (JaroWinkler().similarity, "abcdxx", "abqrst", 0.644444),
    (Editex().distance, "Smith", "Smyth", 1),
    (Editex().normalized_distance, "Smith", "Smyth", 0.05),
    (Editex().similarity, "S!m1i*t_h---", "Sm yth###42", 0.95),
    (BiSim().similarity, "Zantac", "Zantax", 5 / 6),
    (Prefix().similarity, "prefix", "prelude", 3 / 7),
    (NGram().similarity, "night", "nacht", 0.5),
    (NGram(metric="jaccard").similarity, "night", "nacht", 1 / 3),
    (NGram(metric="overlap").similarity, "night", "nacht", 0.5),
    (NGram(metric=TVERSKY).similarity, "night", "nacht", 0.5),
    (NGram(metric="cosine").similarity, "night", "nacht", 0.5),
    (LCS().similarity, "bananaphone", "bananabread", 7 / 11),
    (LCSuf().similarity, "bananaphone", "bananabread", 0),
    (LCSuf().similarity, "walking", "talking", 6 / 7),
    (Aline().similarity, "tu", "ty", 58 / 60),
    (Aline().similarity, "ke", "kwa", 50 / 95),
]


def test_values_worked_by_hand(spark):
    df = spark.range(1)
    row = df.select(*[of(F.lit(x), F.lit(y)).cast("double").alias(f"v{k}") for k, (of, x, y, _) in enumerate(HAND)]).first()
    for k, (_, x, y, want) in enumerate(HAND):
        assert row[k] == pytest.approx(want, abs=1e-6), (x, y)


# Published alignment scores (pairs of cognates).
ALIGNED = """
jo ʒə 0.7083; tu ty 0.9667; nosotros nu 0.24; kjen ki 0.3846; ke kwa 0.5263; todos tu 0.3871; una ən 0.6706; dos dø 0.6105; tres trwa 0.6538;
ombre om 0.3871; arbol arbrə 0.6903; pluma plym 0.8258; kabeθa kap 0.5; boka buʃ 0.6792; pje pje 1.0; koraθon kœr 0.4326; ber vwar 0.5808;
benir vənir 0.9323; deθir dir 0.5194; pobre povrə 0.9323; ðis dIzes 0.6; ðæt das 0.8211; wat vas 0.7684; nat nixt 0.6731; loŋ laŋ 0.9579;
mæn man 1.0; fleʃ flajʃ 0.7303; bləd blyt 0.9385; feðər fEdər 0.9387; hær hAr 1.0; ir Or 0.9333; aj awgə 0.4; nowz nAzə 0.6346;
mawθ munt 0.5423; təŋ tsuŋə 0.6097; fut fys 0.9; nij knI 0.6316; hænd hant 0.9615; hart herts 0.803; livər lEbər 0.9387; ænd ante 0.75;
æt ad 0.9167; blow flAre 0.5839; ir awris 0.3226; ijt edere 0.3103; fiʃ piʃkis 0.45; flow fluere 0.6389; staɾ stella 0.6184; ful plenus 0.2658;
græs gramen 0.5; hart kordis 0.4921; horn korny 0.6613; aj ego 0.4235; nij genU 0.4667; məðər mAter 0.8935; mawntən mons 0.4822; nejm nomen 0.5226;
njuw nowus 0.5484; wən unus 0.475; rawnd rotundus 0.48; sow suere 0.5517; sit sedere 0.5; θrij tres 0.7462; tuwθ dentis 0.4158; θin tenwis 0.45;
kinwawa kenuaʔ 0.5628; nina nenah 0.7742; napewa napɛw 0.8611; wapimini wapemen 0.8958; namesa namɛʔs 0.7632; okimawa okemaw 0.878; ʃiʃipa seʔsep 0.7211;
ahkohkwa ahkɛh 0.604; pematesiweni pematesewen 0.9306; asenja aʔsɛn 0.6111
"""


def test_published_alignment_scores(spark):
    cases = [c.split() for c in ALIGNED.replace("\n", " ").split(";")]
    assert len(cases) == 75
    got, own = values(spark, [(a, b) for a, b, _ in cases], Aline().similarity(X, Y), Aline().similarity(X, X))
    for (a, b, want), v, s in zip(cases, got, own, strict=True):
        assert v == pytest.approx(float(want), abs=1e-3), (a, b)
        assert s == 1


def test_inventory_and_validation():
    assert len(sound_inventory()) == 98
    with pytest.raises(errors.InvalidFeatureSum):
        AlineTables().validate()


EMPTY = {
    "Levenshtein": (1, 0), "JaroWinkler": (1, 0), "LCS": (1, 0), "LCSuf": (1, 0), "Prefix": (1, 0), "BiSim": (1, 0), "NGram": (1, 0), "Editex": (1, 0), "Aline": (0, 0),
}


def test_empty_sides_and_nulls(spark):
    pairs = [("", ""), ("", "ab"), ("ab", ""), (None, "a"), ("a", None), (None, ""), (None, None)]
    columns = [SCORERS[n]().similarity(X, Y) for n in EMPTY] + [NGram(metric="overlap", before_padding=0, after_padding=0).similarity(X, Y), NGram(metric="cosine", before_padding=0, after_padding=0).similarity(X, Y), Levenshtein().distance(X, Y), Editex().distance(X, Y)]
    got = values(spark, pairs, *columns)
    for (name, (both, one)), v in zip(EMPTY.items(), got, strict=False):
        assert v == [both, one, one, None, None, None, None], name
    assert got[len(EMPTY)] == [1, 1, 1, None, None, None, None]
    assert got[len(EMPTY) + 1] == [1, 0, 0, None, None, None, None]
    assert got[-2][:3] == [0, 2, 2] and got[-2][3:] == [None] * 4


def test_whitespace_case_and_code_points(spark):
    got = values(spark, [(" t u", "ˈty"), ("\U0001d400b", "\U0001d401b"), ("ÉCOLE", "école")], Aline(strict=False).similarity(X, Y), Levenshtein().distance(X, Y), Levenshtein(case_insensitive=True).distance(X, Y), LCS(case_insensitive=True).similarity(X, Y), Prefix(case_insensitive=True).similarity(X, Y))
    assert got[0][0] == pytest.approx(58 / 60)
    assert got[1][1] == 1 and got[2][2] == 0 and got[3][2] == 1 and got[4][2] == 1


def test_unknown_tokens(spark):
    df = spark.createDataFrame([("a1", "b")], "x string, y string")
    assert df.select(Aline(strict=False).similarity(F.lit("東"), Y)).first()[0] is None
    with pytest.raises(Exception, match="UnknownToken"):
        df.select(Aline().similarity(F.lit("東"), Y)).collect()
    with pytest.raises(Exception, match="UnknownToken"):
        df.select(Editex(group={"a": [0]}).similarity(X, Y)).collect()


def test_configurations_are_checked():
    for made, error in ((lambda: JaroWinkler(prefix_scale=0.3), errors.InvalidPrefixScale), (lambda: NGram(n=0), errors.InvalidNGramSize), (lambda: NGram(metric={"tversky": {"alpha": -1, "beta": 0}}), errors.InvalidTverskyParameter)):
        with pytest.raises(error):
            made()
    for name in ("Aline", "BiSim", "LCS", "LCSuf", "NGram", "Prefix"):
        with pytest.raises(errors.DistanceNotSupported):
            SCORERS[name]().distance(X, Y)
    assert NGram(3, 2, 1).name == "NGram_3_2_1" and LCSuf().name == "LCSuf"


# Plain definitions to hold the kernels against.
def edit(x, y, ins, dele, sub):
    @lru_cache(None)
    def d(i, j):
        if i == 0 or j == 0:
            return i * dele + j * ins
        return min(d(i - 1, j) + dele, d(i, j - 1) + ins, d(i - 1, j - 1) + (0 if x[i - 1] == y[j - 1] else sub))

    return d(len(x), len(y))


def lcs(x, y):
    @lru_cache(None)
    def d(i, j):
        if i == 0 or j == 0:
            return 0
        return d(i - 1, j - 1) + 1 if x[i - 1] == y[j - 1] else max(d(i - 1, j), d(i, j - 1))

    return d(len(x), len(y))


def jaro(x, y):
    if not x and not y:
        return 1
    w, free, hits = max(0, max(len(x), len(y)) // 2 - 1), [True] * len(y), []
    for i, c in enumerate(x):
        for j in range(max(0, i - w), min(i + w + 1, len(y))):
            if free[j] and y[j] == c:
                free[j] = False
                hits.append(c)
                break
    if not hits:
        return 0
    t = sum(a != b for a, b in zip(hits, [c for c, f in zip(y, free, strict=True) if not f], strict=True)) // 2
    c = len(hits)
    return (c / len(x) + c / len(y) + (c - t) / c) / 3


def test_kernels_against_plain_definitions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(400)] + [("a" * 300, "ab" * 100)]
    got = values(spark, pairs, Levenshtein({"insert": 1, "delete": 2, "substitute": 1.5}).distance(X, Y), LCS().similarity(X, Y), JaroWinkler().jaro(X, Y), BiSim(False).similarity(X, Y))
    for k, (x, y) in enumerate(pairs):
        m = max(len(x), len(y))
        assert got[0][k] == pytest.approx(edit(x, y, 1, 2, 1.5))
        assert got[1][k] == pytest.approx(lcs(x, y) / m if x and y else float(x == y))
        assert got[2][k] == pytest.approx(jaro(x, y))
        grams = lambda s: tuple(zip(s[:1] + s, s, strict=False))
        assert got[3][k] == pytest.approx(lcs(grams(x), grams(y)) / m if x and y else float(x == y))
