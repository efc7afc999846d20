"""Scorers in SQL give what the same scorers give on columns."""

import pytest
from pyspark.sql import functions as F

from lexisim import sql
from lexisim.functions.scorers import LCS, Aline, BiSim, Editex, JaroWinkler, LCSuf, Levenshtein, NGram, Prefix
from lexisim.plans.growing import ODD

TVERSKY = {"tversky": {"alpha": 0.7, "beta": 0.3}}
FORMS = {
    "lev_similarity(x, y)": Levenshtein().similarity, "lev_distance(x, y)": Levenshtein().distance, "lev_normalized_distance(x, y)": Levenshtein().normalized_distance,
    "prefix_similarity(x, y)": Prefix().similarity, "lcsuf_similarity(x, y)": LCSuf().similarity, "lcs_similarity(x, y)": LCS().similarity, "bisim_similarity(x, y)": BiSim().similarity,
    "jaro_winkler_similarity(x, y)": JaroWinkler().similarity, "jaro_winkler_distance(x, y)": JaroWinkler().distance,
    "ngram_dice(x, y)": NGram().similarity, "ngram_jaccard(x, y)": NGram(metric="jaccard").similarity, "ngram_overlap(x, y)": NGram(metric="overlap").similarity,
    "ngram_cosine(x, y)": NGram(metric="cosine").similarity, "ngram_tversky(x, y, 0.7D, 0.3D)": NGram(metric=TVERSKY).similarity,
    "editex_distance(x, y)": Editex().distance, "editex_normalized_distance(x, y)": Editex().normalized_distance, "editex_similarity(x, y)": Editex().similarity,
    "aline_similarity(x, y)": Aline().similarity,
}


def test_scorers_in_sql(spark):
    sql.register(spark)
    plain = [p for p in ODD if all(s is None or s.isascii() for s in p)] + [("dallas", "de las 9"), ("\u0130x", "ix"), ("kitten", "sitting")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(plain)], "k int, x string, y string")
    for form, of in FORMS.items():
        sound = rows.where("k >= 0") if "aline" not in form else rows.where("x is null or y is null or (x rlike '^[a-z 9]*$' and y rlike '^[a-z 9]*$')")
        got = sound.select("k", F.expr(form).alias("a"), of(F.col("x"), F.col("y")).cast("double").alias("b")).collect()
        for r in got:
            assert (r["a"] is None) == (r["b"] is None), (form, r)
            assert r["a"] is None or r["a"] == pytest.approx(r["b"]), (form, plain[r["k"]], r)
    with pytest.raises(Exception, match="UnknownToken"):
        spark.sql("SELECT aline_similarity('a\u6771', 'b')").collect()
