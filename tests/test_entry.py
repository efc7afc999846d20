"""The registry: it imports without the optional parts, and queries agree with their SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexisim.plans import oracle
from lexisim.plans.queries import ENSEMBLES, POPULATION, QUERIES

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql(POPULATION, ENSEMBLES)
QUICK = ["topk_pairs", "lev_weighted", "jaro_winkler", "lcs", "lcsuf", "prefix", "bisim", "ngram_jaccard", "ngram_cosine", "editex_sim", "aline", "ensemble_affine", "ensemble_mixed_distance", "score_matrix_ensemble", "transcription_routing", "split_counts", "balance_counts", "bce", "population_fitness"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_names():
    assert set(SQL) == set(QUERIES) - {"unknown_sounds", "ga_weights"}


def test_imports_without_optional_parts(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'aline' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
