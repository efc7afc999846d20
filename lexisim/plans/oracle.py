"""DuckDB SQL of the queries, written independently of them: recursive tables walk the dynamic programmes row by row."""

from __future__ import annotations

import json

from lexisim.functions.aline import AlineTables
from lexisim.functions.scorers import LETTER_GROUPS

_P = "p AS (SELECT a.p_name AS x_1, b.p_name AS x_2 FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name)"
_PREFIX = "len(list_filter(range(1, least(length({x}), length({y})) + 1), lambda k: substr({x}, 1, k) = substr({y}, 1, k)))"
_MOST = "greatest(length(x_1), length(x_2))"
_LEV = f"(1 - levenshtein(x_1, x_2) / {_MOST})"
_PRE = f"({_PREFIX.format(x='x_1', y='x_2')} / {_MOST})"
_SUF = f"({_PREFIX.format(x='reverse(x_1)', y='reverse(x_2)')} / {_MOST})"
_JARO = "jaro_similarity(x_1, x_2)"
_JW = f"({_JARO} + least(4, {_PREFIX.format(x='x_1', y='x_2')}) * 0.1::DOUBLE * (1 - {_JARO}))"
_GRAMS = "list_transform(range(1, length({x}) + 2), lambda i: substr(' ' || {x} || ' ', i, 2))"
_A, _B = _GRAMS.format(x="x_1"), _GRAMS.format(x="x_2")


def _clip(v: str) -> str:
    return f"least(1, greatest(0, {v}))"


def _plain(value: str, extra: str = "") -> str:
    return f"WITH {_P}{extra} SELECT x_1, x_2, {value} AS value FROM p"


def _rounded(value: str) -> str:
    return _plain(f"round(round(({value})::DOUBLE, 9), 6)")


def _sets(value: str) -> str:
    """value over the distinct grams a, b and their common part c."""
    return f"""WITH {_P}, g AS (SELECT x_1, x_2, list_distinct({_A}) AS a, list_distinct({_B}) AS b FROM p),
s AS (SELECT x_1, x_2, len(a) AS a, len(b) AS b, len(list_intersect(a, b)) AS c FROM g) SELECT x_1, x_2, round(({value})::DOUBLE, 6) AS value FROM s"""


_TIMES = "len(list_filter({of}, lambda h: h = g))::DOUBLE"
_COSINE = f"""WITH {_P}, g AS (SELECT x_1, x_2, {_A} AS a, {_B} AS b FROM p)
SELECT x_1, x_2, round(coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda g: {_TIMES.format(of="a")} * {_TIMES.format(of="b")})), 0)
 / (sqrt(list_sum(list_transform(list_distinct(a), lambda g: {_TIMES.format(of="a")} * {_TIMES.format(of="a")})))
  * sqrt(list_sum(list_transform(list_distinct(b), lambda g: {_TIMES.format(of="b")} * {_TIMES.format(of="b")})))), 6) AS value FROM g"""


def _table(start: str, first: str, cell: str, answer: str, x: str = "x_1", y: str = "x_2") -> str:
    """A dynamic programme: x over rows, y along them; row is the one before, acc the one being made."""
    return f"""WITH RECURSIVE {_P}, t AS (SELECT x_1, x_2, {x} AS x, {y} AS y FROM p),
d AS (SELECT x_1, x_2, x, y, 0 AS i, {start} AS row FROM t
 UNION ALL SELECT x_1, x_2, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, {cell}), [{first}]) FROM d WHERE i < length(x))
SELECT x_1, x_2, round(round(({answer})::DOUBLE, 9), 6) AS value FROM d WHERE i = length(x)"""


_SAME = "substr(x, i + 1, 1) = substr(y, j, 1)"
_ZEROS = "list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT)"
_LCS = _table(_ZEROS, "0::BIGINT", f"CASE WHEN {_SAME} THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END", f"row[length(y) + 1] / {_MOST}")
_SAME_BI = "substr(substr(x, 1, 1) || x, i + 1, 2) = substr(substr(y, 1, 1) || y, j, 2)"
_BISIM = _table(_ZEROS, "0::BIGINT", f"CASE WHEN {_SAME_BI} THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END", f"row[length(y) + 1] / {_MOST}", "lower(x_1)", "lower(x_2)")
_WEIGHTED = _table("list_transform(range(0, length(y) + 1), lambda j: j * 1.0::DOUBLE)", "(i + 1) * 2.0::DOUBLE", f"least(row[j + 1] + 2, acc[-1] + 1, row[j] + CASE WHEN {_SAME} THEN 0 ELSE 1.5 END)::DOUBLE", "row[length(y) + 1]")


def _near(a: str, b: str) -> str:
    return f"len(list_filter({LETTER_GROUPS}, lambda g: contains(g, {a}) AND contains(g, {b}))) > 0"


def _gap(s: str, at: str) -> str:
    return f"(CASE WHEN {at} = 1 THEN 2 WHEN {_near(f'substr({s}, {at}, 1)', f'substr({s}, {at} - 1, 1)')} THEN 1 ELSE 2 END)::DOUBLE"


def _editex(answer: str) -> str:
    swap = f"(CASE WHEN {_SAME} THEN 0 WHEN {_near('substr(x, i + 1, 1)', 'substr(y, j, 1)')} THEN 1 ELSE 2 END)::DOUBLE"
    start = f"list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, acc[-1] + {_gap('y', 'j')}), [0::DOUBLE])"
    cell = f"least(row[j + 1] + {_gap('x', '(i + 1)')}, acc[-1] + {_gap('y', 'j')}, row[j] + {swap})"
    return _table(start, f"row[1] + {_gap('x', '(i + 1)')}", cell, answer, "regexp_replace(x_1, '[^a-z]', '', 'g')", "regexp_replace(x_2, '[^a-z]', '', 'g')")


def _total(s: str) -> str:
    return f"list_sum(list_transform(range(1, length({s}) + 1), lambda k: {_gap(s, 'k')}))"


_EDITEX = "row[length(y) + 1]"
_EDITEX_NORM = f"{_clip(f'{_EDITEX} / ({_total("x")} + {_total("y")})')}"


def _aline_scores(pairs: str) -> str:
    """WITH clauses that end in ``scored`` (x_1, x_2, value) over ``pairs``, a query of names of a-z and spaces."""
    tables = AlineTables()
    symbols, delta, vowel = tables.matrices()
    at = [symbols.index(c) for c in "abcdefghijklmnopqrstuvwxyz"]
    c = tables.costs
    code = lambda s, k: f"ascii(substr({s}, {k}, 1)) - 96"
    x, y, x0, y0 = code("x", "i + 1"), code("y", "j"), code("x", "i"), code("y", "j - 1")
    swap = f"{c['substitute']} - delta[{x}][{y}] - vowel[{x}] - vowel[{y}]"
    wide = lambda one, before, here: f"{c['expand_compress']} - delta[{one}][{before}] - delta[{one}][{here}] - vowel[{one}] - greatest(vowel[{before}], vowel[{here}])"
    cell = (
        f"greatest(0, row[j + 1] + {c['skip']}, acc[-1] + {c['skip']}, row[j] + {swap}, "
        f"CASE WHEN i > 0 THEN older[j] + {wide(y, x0, x)} ELSE 0 END, CASE WHEN j > 1 THEN row[j - 1] + {wide(x, y0, y)} ELSE 0 END)::DOUBLE"
    )
    step = f"list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, {cell}), [0::DOUBLE])"
    zeros = "list_transform(range(0, length(y) + 1), lambda j: 0::DOUBLE)"
    return f"""WITH RECURSIVE {_P}, q AS ({pairs}),
m AS (SELECT {json.dumps([[float(delta[a, b]) for b in at] for a in at])}::DOUBLE[][] AS delta, {json.dumps([float(vowel[a]) for a in at])}::DOUBLE[] AS vowel),
t AS (SELECT DISTINCT replace(x_1, ' ', '') AS x, replace(x_2, ' ', '') AS y FROM q UNION SELECT replace(x_1, ' ', ''), replace(x_1, ' ', '') FROM q UNION SELECT replace(x_2, ' ', ''), replace(x_2, ' ', '') FROM q),
d AS (SELECT x, y, 0 AS i, {zeros} AS older, {zeros} AS row, 0::DOUBLE AS best FROM t
 UNION ALL SELECT x, y, i + 1, row, made, greatest(best, list_max(made)) FROM (SELECT d.*, {step} AS made FROM d, m WHERE i < length(x))),
r AS (SELECT x, y, best FROM d WHERE i = length(x)),
scored AS (SELECT q.x_1, q.x_2, CASE WHEN greatest(a.best, b.best) = 0 THEN 0 ELSE c.best / greatest(a.best, b.best) END AS value FROM q
 JOIN r a ON a.x = replace(q.x_1, ' ', '') AND a.y = a.x JOIN r b ON b.x = replace(q.x_2, ' ', '') AND b.y = b.x
 JOIN r c ON c.x = replace(q.x_1, ' ', '') AND c.y = replace(q.x_2, ' ', ''))"""


_ALL = "SELECT x_1, x_2 FROM p"
_ALINE = f"{_aline_scores(_ALL)} SELECT x_1, x_2, round(round(value + 1e-8, 9), 6) AS value FROM scored"
_ROUTED = f"{_aline_scores(_ALL)} SELECT upper(x_1) AS x_1, upper(x_2) AS x_2, round(round(value + 1e-8, 9), 6) AS aline, round({_PRE}::DOUBLE, 6) AS prefix FROM scored"
_DRUGS = f"""{_aline_scores(_ALL)}, bi AS ({_BISIM.replace("round(round((", "((").replace(")::DOUBLE, 9), 6) AS value", ")::DOUBLE) AS value")})
SELECT s.x_1, s.x_2, round(round({_clip(f"0.25::DOUBLE * s.value + 0.25::DOUBLE * bi.value + 0.25::DOUBLE * {_LEV.replace('x_', 's.x_')} + 0.25::DOUBLE * {_PRE.replace('x_', 's.x_')}")}::DOUBLE, 9), 6) AS ensemble
FROM scored s JOIN bi ON s.x_1 = bi.x_1 AND s.x_2 = bi.x_2"""
_WORDS = """w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) BETWEEN 5 AND 12),
p AS (SELECT a.w AS x_1, b.w AS x_2 FROM w a JOIN w b ON substr(a.w, 1, 5) = substr(b.w, 1, 5) AND a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1)"""


def _weighted(weights: tuple[float, float, float]) -> str:
    total = " + ".join(f"{w}::DOUBLE * {s}" for w, s in zip(weights, (_LEV, _PRE, _SUF), strict=True) if w)
    return _clip(f"({total}) / {sum(map(abs, weights))}::DOUBLE")


_LABELLED = f"""WITH {_P}, v AS (SELECT {_LEV}::DOUBLE AS a, {_SUF}::DOUBLE AS b, (string_split(x_1, ' ')[-1] = string_split(x_2, ' ')[-1])::INT::DOUBLE AS y FROM p)"""


def _loss(each: str) -> str:
    return f"{_LABELLED}, q AS (SELECT {_clip('0.6::DOUBLE * a + 0.4::DOUBLE * b')}::DOUBLE AS p, y FROM v) SELECT round(avg({each}), 6) AS loss, count(*) AS n FROM q"


#: Code points beyond ASCII that the tables or the unusual strings have. The engine's edit distances count bytes;
#: mapped to bytes that nothing else uses, such letters count once.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíïñóöúü東京"


def _bytes(s: str) -> str:
    return f"translate({s}, '{_WIDE}', {' || '.join(f'chr({k})' for k in [*range(1, 9), *range(14, 32)][: len(_WIDE)])})"


_LONGEST = "greatest(length({x}), length({y}))"


def _edits(x: str, y: str) -> str:
    most = _LONGEST.format(x=x, y=y)
    return f"CASE WHEN {most} = 0 THEN 1 WHEN {x} IS NULL OR {y} IS NULL THEN NULL ELSE 1 - levenshtein({_bytes(x)}, {_bytes(y)}) / {most} END"


def _winkler(x: str, y: str) -> str:
    jaro = f"(CASE WHEN {x} = '' AND {y} = '' THEN 1 ELSE jaro_similarity({_bytes(x)}, {_bytes(y)}) END)"
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {jaro} = 0 THEN 0 ELSE {jaro} + least(4, {_PREFIX.format(x=x, y=y)}) * 0.1::DOUBLE * (1 - {jaro}) END"


#: All pairs of words of 0.9 at least. A common prefix of four letters makes up for 0.4 of what Jaro's similarity lacks, so less than 0.8 of that never reaches it.
_NEAR_WORDS = f"""WITH w AS (SELECT DISTINCT w, {_bytes("w")} AS b FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents)),
p AS (SELECT x.w AS x_1, y.w AS x_2, jaro_similarity(x.b, y.b) AS j FROM w x JOIN w y ON x.w < y.w),
v AS (SELECT x_1, x_2, round(round((j + least(4, {_PREFIX.format(x="x_1", y="x_2")}) * 0.1::DOUBLE * (1 - j))::DOUBLE, 9), 6) AS value FROM p WHERE j >= 0.8)
SELECT x_1, x_2, value FROM v WHERE value >= 0.9"""


def _affix(x: str, y: str) -> str:
    most = _LONGEST.format(x=x, y=y)
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {most} = 0 THEN 1 ELSE {_PREFIX.format(x=x, y=y)} / {most} END"


def _set_share(x: str, y: str, n: int, before: int, after: int, overlap: bool) -> str:
    """Jaccard or overlap of the different padded n-grams; 1 where there is nothing to share."""
    grams = lambda v: f"list_distinct(list_transform(range(1, length({v}) + {before + after - n + 2}), lambda i: substr('{' ' * before}' || {v} || '{' ' * after}', i, {n})))"
    a, b = grams(x), grams(y)
    both = f"len(list_intersect({a}, {b}))"
    below = f"least(len({a}), len({b}))" if overlap else f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {below} = 0 THEN 1 ELSE {both} / {below} END"


def _six(**values: str) -> str:
    return ", ".join(f"round(round(({v})::DOUBLE, 9), 6) AS {k}" for k, v in values.items())


_NEIGHBOURS = """WITH w AS (SELECT regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS s FROM w), p AS (SELECT s.a AS x_1, s.b AS x_2 FROM s)"""
_DICE = "2 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


def _raw_dice(x: str, y: str) -> str:
    a, b = (f"list_distinct(list_transform(range(1, length({v}) + 1), lambda i: substr({v} || ' ', i, 2)))" for v in (x, y))
    return _DICE.format(a=a, b=b)


def growing_sql(odd: list[tuple]) -> dict[str, str]:
    """Name -> SQL for neighbouring words, unusual strings and the precomputed matrix."""
    quoted = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    rows = ", ".join(f"({k}, {quoted(a)}, {quoted(b)})" for k, (a, b) in enumerate(odd))
    low = ("lower(x_1)", "lower(x_2)")
    raw = ("x_1", "x_2")
    unusual = _six(
        levenshtein=_edits(*raw), folded=_edits(*low), jaro_winkler=_winkler(*raw), prefix=_affix(*raw), lcsuf=_affix("reverse(x_1)", "reverse(x_2)"),
        trigrams=_set_share(*low, 3, 2, 0, False), letters=_set_share(*low, 1, 0, 0, True),
    )
    single = {
        "aline": _ALINE, "bisim": _BISIM, "editex": _editex(f"1 - {_EDITEX_NORM}"), "jaro_winkler": _rounded(_JW), "lcs": _LCS, "lcsuf": _rounded(_SUF),
        "levenshtein": _rounded(_LEV), "dice": _sets("2 * c / (a + b)"), "jaccard": _plain(f"round(({_set_share(*raw, 3, 2, 2, False)})::DOUBLE, 6)"), "prefix": _rounded(_PRE),
    }
    named = ", ".join(f"s_{k} AS (SELECT x_1, x_2, value AS {k} FROM ({v}))" for k, v in single.items())
    joined = " JOIN ".join(f"s_{k}" if n == 0 else f"s_{k} USING (x_1, x_2)" for n, k in enumerate(single))
    return {
        "neighbour_edits": f"{_NEIGHBOURS} SELECT x_1, x_2, {_six(levenshtein=_edits(*raw), jaro_winkler=_winkler(*raw))} FROM p",
        "neighbour_affixes": f"{_NEIGHBOURS} SELECT x_1, x_2, {_six(prefix=_affix(*raw), lcsuf=_affix('reverse(lower(x_1))', 'reverse(lower(x_2))'))} FROM p",
        "neighbour_grams": f"{_NEIGHBOURS} SELECT x_1, x_2, {_six(trigrams=_set_share(*low, 3, 2, 0, False), letters=_set_share(*low, 1, 0, 0, True), raw=_raw_dice(*raw))} FROM p",
        "odd_strings": f"WITH p(row_id, x_1, x_2) AS (VALUES {rows}) SELECT row_id, {unusual} FROM p",
        "mass_precompute": f"WITH {named} SELECT x_1, x_2, {', '.join(single)} FROM {joined}",
    }


_STRATA = "s AS (SELECT CASE WHEN quality IS NULL THEN 'unlabeled' WHEN quality >= 0.5 THEN 'positive' ELSE 'negative' END AS stratum, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"
_TRAIN = "greatest(least(greatest(round(n * 0.8::DOUBLE), 1), n - 1), 0)::BIGINT"
_SPLIT = f"WITH {_STRATA}, t AS (SELECT stratum, n, {_TRAIN} AS k FROM s)"


def oracle_sql(population: list[list[float]], ensembles: dict[str, tuple]) -> dict[str, str]:
    """Name -> SQL for the queries that SQL can express."""
    people = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(population))
    q = "(CASE WHEN p < 1e-7 THEN 1e-7 WHEN p > 1 - 1e-7 THEN 1 - 1e-7 ELSE p END)"
    return {
        "topk_pairs": f"WITH {_P} SELECT x_1, x_2, round({_LEV}::DOUBLE, 6) AS score FROM p ORDER BY score DESC, x_1, x_2 LIMIT 20",
        "lev_distance": _plain("levenshtein(x_1, x_2)::BIGINT"),
        "lev_norm": _rounded(f"levenshtein(x_1, x_2) / {_MOST}"),
        "lev_sim": _rounded(_LEV),
        "lev_weighted": _WEIGHTED,
        "lev_case_insensitive": _plain("levenshtein(x_1, x_2)::BIGINT"),
        "lev_words": f"WITH {_WORDS} SELECT x_1, x_2, round({_LEV}::DOUBLE, 6) AS value FROM p",
        "jaro": _rounded(_JARO),
        "jaro_winkler": _rounded(_JW),
        "jw_distance": _rounded(f"1 - {_JW}"),
        "jw_words": _NEAR_WORDS,
        "lcs": _LCS,
        "lcsuf": _rounded(_SUF),
        "prefix": _rounded(_PRE),
        "bisim": _BISIM,
        "ngram_dice": _sets("2 * c / (a + b)"),
        "ngram_jaccard": _sets("c / (a + b - c)"),
        "ngram_overlap": _sets("c / least(a, b)"),
        "ngram_tversky": _sets("c / (c + 0.7::DOUBLE * (a - c) + 0.3::DOUBLE * (b - c))"),
        "ngram_cosine": _COSINE,
        "editex_tokens": _plain("length(regexp_replace(x_1 || x_2, '[^a-z]', '', 'g'))::BIGINT"),
        "editex_distance": _editex(_EDITEX),
        "editex_norm": _editex(_EDITEX_NORM),
        "editex_sim": _editex(f"1 - {_EDITEX_NORM}"),
        "aline": _ALINE,
        **{name: _rounded(_weighted(weights)) for name, (_, weights) in ensembles.items()},
        "ensemble_mixed_distance": _rounded(f"0.6::DOUBLE * levenshtein(x_1, x_2) / {_MOST} + 0.4::DOUBLE * {_JW}"),
        "ensemble_function": _rounded(_clip("0.5::DOUBLE * levenshtein(x_1, x_2) + 0.5::DOUBLE * (length(x_1) = length(x_2))::INT")),
        "score_matrix_slice": f"""WITH {_P}, g AS (SELECT x_1, x_2, list_distinct({_A}) AS a, list_distinct({_B}) AS b FROM p)
SELECT x_1, x_2, round({_LEV}::DOUBLE, 6) AS levenshtein, round({_PRE}::DOUBLE, 6) AS prefix, round({_SUF}::DOUBLE, 6) AS lcsuf, round((2 * len(list_intersect(a, b)) / (len(a) + len(b)))::DOUBLE, 6) AS ngram FROM g""",
        "score_matrix_ensemble": f"WITH {_P} SELECT x_1, x_2, round({_weighted((0.5, 0.25, 0.25))}::DOUBLE, 6) AS ensemble, round({_LEV}::DOUBLE, 6) AS levenshtein, round({_PRE}::DOUBLE, 6) AS prefix, round({_SUF}::DOUBLE, 6) AS lcsuf FROM p",
        "from_precomputed": f"WITH {_P} SELECT x_1, x_2, (length(x_1) - length(x_2))::DOUBLE AS size FROM p",
        "transcription_routing": _ROUTED,
        "drug_name_ensemble": _DRUGS,
        "split_counts": f"{_SPLIT} SELECT 'train' AS part, stratum, k AS n FROM t WHERE k > 0 UNION ALL SELECT 'test', stratum, n - k FROM t WHERE n > k",
        "balance_counts": f"""{_SPLIT}, c AS (SELECT stratum, n, k, CASE WHEN stratum = 'unlabeled' THEN k ELSE (SELECT min(k) FROM t WHERE stratum <> 'unlabeled') END AS b FROM t)
SELECT 'train' AS part, stratum, b AS n FROM c WHERE b > 0 UNION ALL SELECT 'test', stratum, n - k FROM c WHERE n > k""",
        "split_unstratified": f"WITH s AS (SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT n, {_TRAIN} AS k FROM s) SELECT 'train' AS part, k AS n FROM t UNION ALL SELECT 'test', n - k FROM t",
        "mse": _loss("(p - y) * (p - y)"),
        "mae": _loss("abs(p - y)"),
        "bce": _loss(f"-(y * ln({q}) + (1 - y) * ln(1 - {q}))"),
        "population_fitness": f"{_LABELLED}, w(ind, u, w) AS (VALUES {people}) SELECT ind::BIGINT AS ind, round(avg(({_clip('u * a + w * b')} - y) * ({_clip('u * a + w * b')} - y)), 6) AS loss FROM v, w GROUP BY ind",
    }
