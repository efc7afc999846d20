"""Queries over pairs of words against their SQL, and how their pairs are dealt out."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexisim.functions.scorers import JaroWinkler
from lexisim.operators import near
from lexisim.plans import oracle, pairs
from lexisim.plans.queries import ENSEMBLES, POPULATION, QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql(POPULATION, ENSEMBLES)


@pytest.mark.parametrize("name", ["lev_words", "jw_words"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(f"SELECT x_1, x_2, value FROM ({SQL[name]})").fetchall()
    rows = [(r.x_1, r.x_2, r.value) for r in QUERIES[name](spark, FOLDER).select("x_1", "x_2", "value").collect()]
    assert len(rows) > 1000 and sorted(map(repr, rows)) == sorted(map(repr, want))


def test_pairs_are_dealt_out_by_more_than_the_words_bytes(spark):
    """Words are few bytes, which Spark would put together in one task with all their pairs."""
    assert pairs.word_pairs(spark, FOLDER).rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism


def test_no_link_is_left_out(spark):
    """Words of all lengths and alphabets against all pairs, in one block and between several."""
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for letters in ("ab", "abcde", "éab", "aeinrst", "東a") for _ in range(120)}
    words |= {"colour", "color", "thecolour", "strasse", "straße", "a" * 70, "a" * 69 + "b"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    both = df.select(F.col("w").alias("x_1")).join(df.select(F.col("w").alias("x_2")), F.col("x_1") < F.col("x_2"))
    for threshold in (0.75, 0.9):
        got = {(r.x_1, r.x_2, r.value) for r in near.jaro_winkler_join(df, threshold).collect()}
        value = F.round(F.round(JaroWinkler().similarity(F.col("x_1"), F.col("x_2")), 9), 6).alias("value")
        want = {(r.x_1, r.x_2, r.value) for r in both.select("x_1", "x_2", value).where(F.col("value") >= threshold).collect()}
        assert got == want and ("color", "colour") in {g[:2] for g in got} and ("strasse", "straße") in {g[:2] for g in got}
