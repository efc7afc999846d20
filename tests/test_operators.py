"""Ensembles, matrices, splits, losses, the genetic search, sources, sinks, SQL and streams."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisim import errors
from lexisim.functions.scorers import LCS, Aline, BiSim, Editex, JaroWinkler, LCSuf, Levenshtein, NGram, Prefix
from lexisim.operators.ensemble import Ensemble, Mode, WeightedFunction
from lexisim.operators.genetic import GeneticConfig, optimize
from lexisim.operators.loss import LOSSES, loss, population_losses
from lexisim.operators.matrix import Row, as_vectors, ensemble_matrix, from_precomputed, pairs, score_columns, unique_names, weight_text
from lexisim.operators.split import split_rows
from lexisim.sources import configs, sinks
from lexisim.sources.schema import CSVOptions, read_pairs
from lexisim.sql import register
from lexisim.streaming.scoring import read_pairs_stream, score_stream


def fixed(name, weight, value, transcribed=False):
    return WeightedFunction.from_function(name, weight, transcribed, lambda x, y: F.lit(value))


def test_ensemble_value(spark):
    e = Ensemble([WeightedFunction.from_normalized_distance(Levenshtein(), 0.6), WeightedFunction.from_similarity(JaroWinkler(), 0.4)], Mode.CONVEX)
    assert spark.range(1).select(e.similarity(F.lit("dixon"), F.lit("dickson"))).first()[0] == pytest.approx(0.590095, abs=1e-6)
    nested = Ensemble([WeightedFunction.from_similarity(e, 1.0)])
    assert spark.range(1).select(nested.similarity(F.lit("dixon"), F.lit("dickson"))).first()[0] == pytest.approx(0.590095, abs=1e-6)


def test_ensemble_rules():
    for weights, mode, error in (
        ([], Mode.LINEAR, errors.EmptyEnsemble), ([math.nan], Mode.LINEAR, errors.NonFiniteWeight), ([1, -1], Mode.LINEAR, errors.InvalidWeight), ([2, -1], Mode.CONICAL, errors.NegativeWeight),
        ([0, 0], Mode.CONICAL, errors.InvalidWeight), ([0.5, 0.4], Mode.AFFINE, errors.WeightsDoNotSumToOne), ([1.5, -0.5], Mode.CONVEX, errors.NegativeWeight), ([0.5, 0.4], Mode.CONVEX, errors.WeightsDoNotSumToOne),
    ):
        with pytest.raises(error):
            Ensemble([fixed("a", w, 0.5) for w in weights], mode)
        Ensemble([fixed("a", w, 0.5) for w in weights], mode, validate=False)
    Ensemble([fixed("a", 1.5, 0.5), fixed("b", -0.5, 0.5)], Mode.AFFINE)


def test_zero_weights_are_not_evaluated_by_similarity(spark):
    bad = WeightedFunction.from_function("bad", 0.0, False, lambda x, y: F.raise_error(F.lit("evaluated")).cast("double"))
    assert spark.range(1).select(Ensemble([bad, fixed("a", 1.0, 0.5)]).similarity(F.lit("x"), F.lit("y"))).first()[0] == 0.5


def test_ensemble_matrix_layout(spark):
    e = Ensemble([fixed("aline", 0.8, 0.0), fixed("b", 0.1, 0.1), fixed("c", 0.1, 0.2)], Mode.CONVEX)
    m = ensemble_matrix(pairs(spark, [Row("x", "y").labelled(0.5)]), e)
    assert m.columns == ["x_1", "x_2", "label", "ensemble", "aline_0.8", "b_0.1", "c_0.1"]
    assert list(m.first())[3:] == pytest.approx([0.03, 0.0, 0.1, 0.2])
    assert as_vectors(m).first()["scores"] == pytest.approx([0.0, 0.1, 0.2])
    assert weight_text(1.0) == "1" and unique_names(["a", "b", "a"]) == ["a", "b", "a__2"]


def test_transcriptions_are_routed(spark):
    rows = pairs(spark, [Row("x", "y").transcribed("tu", "ty")])
    assert score_columns(rows, [Aline(), Prefix()]).select("Aline").first()[0] == pytest.approx(58 / 60)
    missing = pairs(spark, [Row("x", "y")])
    with pytest.raises(Exception, match="MissingTranscription"):
        score_columns(missing, [Aline()]).collect()
    assert score_columns(missing, [Aline()], strict=False).select("Aline").first()[0] is None
    with pytest.raises(errors.InvalidDatasetShape):
        from_precomputed(rows, ["score"])


CSV = "x_1,x_2,label\n" + "\n".join(f"a{k},b{k},{'0.' if k == 3 else 0.9 if k < 9 else 0.2}" for k in range(17)) + "\n"


def test_csv_and_split(spark, tmp_path):
    path = str(tmp_path / "pairs.csv")
    (tmp_path / "pairs.csv").write_text("y,x,label\n b,,\nc,a,0.\n")
    got = read_pairs(spark, path).orderBy("x_1").collect()
    assert [tuple(r)[:3] for r in got] == [("", " b", None), ("a", "c", 0.0)] and got[0]["t_1"] is None
    (tmp_path / "bad.csv").write_text("x_1,label\na,1\n")
    with pytest.raises(errors.InvalidDatasetShape):
        read_pairs(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "semi.csv").write_text("a;b;1;;\n")
    assert tuple(read_pairs(spark, str(tmp_path / "semi.csv"), CSVOptions(";", False)).first())[:3] == ("a", "b", 1.0)

    rows = spark.createDataFrame([(k, 0.9 if k < 9 else 0.1) for k in range(17)], "row_id long, label double")
    train, test = split_rows(rows, 0.8, 67)
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    assert len(ids(train)) == 13 and len(ids(test)) == 4 and sorted(ids(train) + ids(test)) == list(range(17))
    assert sum(k < 9 for k in ids(train)) == 7
    assert ids(split_rows(rows, 0.8, 67)[0]) == ids(train) != ids(split_rows(rows, 0.8, 68)[0])
    balanced, rest = split_rows(rows, 0.8, 67, balance=True)
    assert len(ids(balanced)) == 12 and set(ids(balanced)) < set(ids(train)) and ids(rest) == ids(test)
    one = spark.createDataFrame([(1, None)], "row_id long, label double")
    assert split_rows(one, 0.8)[0].count() == 0 and split_rows(one, 0.8)[1].count() == 1
    assert split_rows(rows, 0.8, 1, stratify=False)[0].count() == 14
    with pytest.raises(errors.InvalidDatasetShape):
        split_rows(rows, 1.0)


def test_losses(spark):
    data = [([0.2, 0.4], 1.0), ([0.9, 0.8], 0.0), ([0.5, 0.5], None)]
    rows = spark.createDataFrame(data, "scores array<double>, label double")
    p = [0.3, 0.85]
    assert loss(rows, [0.5, 0.5]) == pytest.approx(((p[0] - 1) ** 2 + p[1] ** 2) / 2)
    assert loss(rows, [0.5, 0.5], "mae") == pytest.approx((0.7 + 0.85) / 2)
    assert loss(rows, [0.5, 0.5], "bce") == pytest.approx(-(math.log(0.3) + math.log(0.15)) / 2)
    assert loss(rows.where("label is null"), [0.5, 0.5]) == math.inf
    found = {r["ind"]: r["loss"] for r in population_losses(rows, [[0.5, 0.5], [9.0, 0.0]], "mae").collect()}
    assert found == pytest.approx({0: 0.775, 1: 0.5})


@pytest.mark.parametrize("of", ["mse", LOSSES["mse"]])
def test_genetic_search_prefers_the_better_scorer(spark, of):
    rows = [("abcdef", "axbycz", 0.5), ("hello", "hxexlxlxo", 0.56), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)]
    data = pairs(spark, [Row(x, y, v) for x, y, v in rows])
    e = Ensemble([WeightedFunction.from_similarity(LCS(), 0.5), WeightedFunction.from_similarity(LCSuf(), 0.5)], Mode.CONVEX)
    small = of != "mse"
    best, value = optimize(e, GeneticConfig(20 if small else 100, 5 if small else 50, 0.2, 0.1, 5, 2), data, of, seed=5)
    assert best.weights[0] > best.weights[1] and value < 0.05
    if not small:
        assert best.weights[0] > 0.8
    with pytest.raises(errors.LexisimError):
        optimize(e, GeneticConfig(elite_count=500), data)


def test_configs(tmp_path):
    for scorer in (Levenshtein(case_insensitive=True), JaroWinkler(), NGram(metric={"tversky": {"alpha": 0.7, "beta": 0.3}}), NGram(), Prefix(), Editex()):
        path = configs.save(scorer, str(tmp_path / type(scorer).__name__), append_extension=True)
        again = configs.load(type(scorer).__name__, path)
        assert {k: v for k, v in again.to_dict().items() if k != "strict"} == {k: v for k, v in scorer.to_dict().items() if k != "strict"}
    path = configs.save(Aline(), str(tmp_path / "aline.toml"))
    assert configs.load(Aline, path).tables == Aline().tables
    with pytest.raises(errors.InvalidExtension):
        configs.save(Prefix(), str(tmp_path / "prefix.json"))
    (tmp_path / "jw.toml").write_text("prefix_scale = 9.0\nmax_prefix_length = 4\ncase_insensitive = false\n")
    with pytest.raises(errors.InvalidPrefixScale):
        configs.load("JaroWinkler", str(tmp_path / "jw.toml"))
    assert configs.load("JaroWinkler", str(tmp_path / "jw.toml"), validate=False).prefix_scale == 9
    (tmp_path / "bad.toml").write_text("a = = 1")
    with pytest.raises(errors.TomlError):
        configs.load("Prefix", str(tmp_path / "bad.toml"))


def test_sinks(spark, tmp_path):
    m = score_columns(pairs(spark, [Row("a", "a", 1.0), Row("a", "b")]), [Levenshtein(), Prefix()])
    sinks.export(m, str(tmp_path / "m.arrow"))
    table = pa.ipc.open_file(str(tmp_path / "m.arrow")).read_all()
    assert table.column_names == m.columns and table.schema.field("Levenshtein").type == pa.float32() and table.num_rows == 2
    sinks.export(m, str(tmp_path / "m.csv"))
    text = sorted(line for f in (tmp_path / "m.csv").glob("part*") for line in f.read_text().splitlines())
    assert "a,a,1,1,1" in text and "a,b,,0,0" in text and "x_1,x_2,label,Levenshtein,Prefix" in text
    sinks.export(m, str(tmp_path / "m.parquet"))
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 2
    with pytest.raises(errors.InvalidExtension):
        sinks.export(m, str(tmp_path / "m.xlsx"))


def test_sql_and_stream(spark, tmp_path):
    register(spark)
    row = spark.sql("select lev_similarity('kitten', 'sitting'), jaro('dixon', 'dicksonx'), lcs_length('banana', 'bnna')").first()
    assert list(row) == pytest.approx([4 / 7, 0.766667, 4], abs=1e-6)
    scorers = {"lev": Levenshtein(), "prefix": Prefix(), "lcsuf": LCSuf(), "lcs": LCS(), "bisim": BiSim(), "jaro_winkler": JaroWinkler()}
    table = spark.createDataFrame([("Zantac", "zantax"), ("", "a"), ("", ""), ("talk", "walk"), (None, "a")], "x string, y string")
    for name, scorer in scorers.items():
        both = table.select(F.expr(f"{name}_similarity(x, y)").alias("v"), scorer.similarity(F.col("x"), F.col("y")).alias("w")).collect()
        for r in both:
            assert r["v"] == (None if r["w"] is None else pytest.approx(r["w"])), name
    row = spark.sql("select ngram_dice('night', 'nacht'), ngram_jaccard('night', 'nacht'), editex_letters('smith', 'smyth'), aline_sounds(array('t', 'u'), array('t', 'y'))").first()
    assert list(row) == pytest.approx([0.5, 1 / 3, 1, 58 / 60])
    pairs(spark, [Row("kitten", "sitting"), Row("a", "a")]).write.parquet(str(tmp_path / "in"))
    score_stream(read_pairs_stream(spark, str(tmp_path / "in")), [Levenshtein()], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r["x_1"]: r["Levenshtein"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({"kitten": 4 / 7, "a": 1.0})


def test_column_pruning_reaches_scorers(spark):
    plan = score_columns(pairs(spark, [Row("a", "b")]), [LCS(), Prefix()]).select("Prefix")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "PythonUDF" not in plan
