"""Scorers for ``spark.sql``: SQL functions that Catalyst inlines, over Arrow UDFs where an alignment is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexisim.functions import kernels
from lexisim.functions.scorers import Aline, Editex, _bigram_codes, _pair_udf
from lexisim.functions.text import IGNORED_PATTERN

_MOST = "greatest(char_length(x), char_length(y))"
_BOTH = "x IS NULL OR y IS NULL"


def _share(shared: str, x: str = "x", y: str = "y") -> str:
    """shared over the longer length; 1 for two empty strings, 0 for one."""
    m, n = f"char_length({x})", f"char_length({y})"
    return f"CASE WHEN {_BOTH} THEN NULL WHEN greatest({m}, {n}) = 0 THEN 1D WHEN least({m}, {n}) = 0 THEN 0D ELSE {shared} / greatest({m}, {n}) END"


def _prefix(x: str, y: str, most: str) -> str:
    places = f"CASE WHEN {most} > 0 THEN sequence(1, {most}) ELSE cast(array() AS array<int>) END"
    return f"coalesce(get(filter({places}, i -> substring({x}, i, 1) <> substring({y}, i, 1)), 0) - 1, {most})"


def _all_grams(s: str) -> str:
    return f"transform(sequence(1, char_length(lower({s})) + 1), i -> substring(concat(' ', lower({s}), ' '), i, 2))"


def _grams(s: str) -> str:
    return f"array_distinct({_all_grams(s)})"


_LEAST = "least(char_length(x), char_length(y))"
_C, _A, _B = f"size(array_intersect({_grams('x')}, {_grams('y')}))", f"size({_grams('x')})", f"size({_grams('y')})"


def _known(value: str) -> str:
    return f"CASE WHEN {_BOTH} THEN NULL ELSE {value} END"


def _cosine() -> str:
    """Over one struct of both lists, so that counts do not make them anew for each gram."""
    times = lambda of: f"size(filter(s.{of}, v -> v = g))"
    total = lambda of, each: f"aggregate(transform({of}, g -> cast({each} AS double)), 0D, (t, v) -> t + v)"
    norm = lambda of: f"sqrt({total(f'array_distinct(s.{of})', f'{times(of)} * {times(of)}')})"
    share = f"{total('array_intersect(s.a, s.b)', f'{times("a")} * {times("b")}')} / ({norm('a')} * {norm('b')})"
    return f"get(transform(array(named_struct('a', {_all_grams('x')}, 'b', {_all_grams('y')})), s -> {share}), 0)"


def _letters(s: str) -> str:
    return f"lower(regexp_replace({s}, '[^A-Za-z]', ''))"


def _most_letters(s: str, editex: Editex) -> str:
    """Cost of deleting all letters."""
    near = ", ".join(f"'{g}'" for g in editex.near_letters())
    t = _letters(s)
    both = f"CASE WHEN char_length({t}) > 1 THEN transform(sequence(1, char_length({t}) - 1), i -> substring({t}, i, 2)) ELSE cast(array() AS array<string>) END"
    return f"({editex.costs['diff']}D * char_length({t}) - {editex.costs['diff'] - editex.costs['same']}D * size(filter({both}, g -> g IN ({near}))))"


def _clip(value: str) -> str:
    return f"least(1D, greatest(0D, {value}))"


def _bodies(editex: Editex, aline: Aline) -> dict[str, str]:
    """SQL bodies of similarities and distances of strings under the usual configurations."""
    jaro = f"get(transform(array(jaro(x, y)), j -> CASE WHEN j = 0 THEN 0D ELSE j + {_prefix('x', 'y', f'least({_LEAST}, 4)')} * 0.1D * (1D - j) END), 0)"
    most = f"({_most_letters('x', editex)} + {_most_letters('y', editex)})"
    letters = f"editex_letters({_letters('x')}, {_letters('y')})"
    editex_norm = f"CASE WHEN {most} = 0 THEN 0D ELSE {_clip(f'{letters} / {most}')} END"
    ignored = IGNORED_PATTERN.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"')
    heard = lambda s: f"filter(regexp_extract_all({s}, '\\\\X', 0), g -> NOT g RLIKE '{ignored}')"
    known = ", ".join(f"'{g}'" for g in aline.tables.sounds)
    checked = lambda s: f"transform({heard(s)}, g -> CASE WHEN g IN ({known}) THEN g ELSE raise_error(concat('UnknownToken: Aline knows no sound ', g)) END)"
    return {
        "lev_similarity": f"CASE WHEN {_BOTH} THEN NULL WHEN {_MOST} = 0 THEN 1D ELSE 1D - levenshtein(x, y) / {_MOST} END",
        "lev_distance": "cast(levenshtein(x, y) AS double)",
        "lev_normalized_distance": f"CASE WHEN {_BOTH} THEN NULL WHEN {_MOST} = 0 THEN 0D ELSE levenshtein(x, y) / {_MOST} END",
        "prefix_similarity": _share(_prefix("x", "y", _LEAST)),
        "lcsuf_similarity": _share(_prefix("reverse(x)", "reverse(y)", _LEAST)),
        "lcs_similarity": _share("lcs_length(x, y)"),
        "bisim_similarity": _share("bisim_length(lower(x), lower(y))", "lower(x)", "lower(y)"),
        "jaro_winkler_similarity": _known(jaro),
        "jaro_winkler_distance": _known(f"1D - {jaro}"),
        "ngram_dice": _known(f"2D * {_C} / ({_A} + {_B})"),
        "ngram_jaccard": _known(f"{_C} / ({_A} + {_B} - {_C})"),
        "ngram_overlap": _known(f"{_C} / least({_A}, {_B})"),
        "ngram_cosine": _known(_clip(_cosine())),
        "editex_distance": _known(letters),
        "editex_normalized_distance": _known(editex_norm),
        "editex_similarity": _known(f"1D - {editex_norm}"),
        "aline_similarity": _known(f"aline_sounds({checked('x')}, {checked('y')})"),
    }


_TVERSKY = _known(f"{_clip(f'{_C} / ({_C} + alpha * ({_A} - {_C}) + beta * ({_B} - {_C}))')}")


def register(spark: SparkSession) -> list[str]:
    """Registers the scorers for SQL in this session; gives their names."""
    editex, aline = Editex(), Aline()
    made = {
        "jaro": _pair_udf(kernels.code_points, kernels.jaro),
        "lcs_length": _pair_udf(kernels.code_points, kernels.common_subsequence),
        "bisim_length": _pair_udf(_bigram_codes, kernels.common_subsequence),
        "editex_letters": editex.kernel_udf(),
        "aline_sounds": aline.kernel_udf(),
    }
    for name, udf in made.items():
        spark.udf.register(name, udf)
    bodies = _bodies(editex, aline)
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING, y STRING) RETURNS DOUBLE RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ngram_tversky(x STRING, y STRING, alpha DOUBLE, beta DOUBLE) RETURNS DOUBLE RETURN {_TVERSKY}")
    return [*made, *bodies, "ngram_tversky"]
