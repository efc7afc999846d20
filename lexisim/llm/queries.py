"""Queries of the training-data operators: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisim.llm import fingerprint, licenses, mixing, ngram_jaccard, quality_classifier, quality_rules, sentencepiece, token_counts, url_filter, warc

#: The rules of op8: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 3-word shingle sets with a similarity of 0.9 or more."""
    return ngram_jaccard.join(_table(spark, folder, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document's quality."""
    return quality_classifier.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled piece ids of every document, and whether decoding gives its text again."""
    return sentencepiece.encode(_table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(_table(spark, folder, "documents"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprint.compare_with_edits(_table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives written from all pages say of each page."""
    back = warc.round_trip(_table(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality_rules.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts.count(_table(spark, folder, "documents")).select("doc_id", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_ngram_jaccard, op3_quality_classifier, op4_sentencepiece, op5_licenses, op6_fingerprints, op7_warc, op8_url_filter, op9_quality_rules, op10_token_counts)}

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex),
b AS (SELECT h.*, first_id, unhex(h.hex)::BIT::VARCHAR AS bits FROM h JOIN f USING (hex))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
       + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


#: Levels that the SQL of op8 has; the tables' paths are not deeper.
LEVELS = 8


def _op8() -> str:
    """The template tree level by level, and its branches merged, as ``url_filter`` does it."""
    levels, last = [], "leaf0"
    for k in range(1, LEVELS + 1):
        levels.append(f"""
part{k} AS (SELECT *, coalesce(string_split(key, '/')[{k}], '') AS part FROM {last}),
rare{k} AS (SELECT host, template, part FROM (SELECT host, template, part, sum(pages) AS m, count(*) OVER (PARTITION BY host, template) AS fan FROM part{k} WHERE part <> '' GROUP BY host, template, part)
  WHERE fan > {url_filter.FANOUT} AND m < {url_filter.SUPPORT}),
leaf{k} AS (SELECT p.host, p.key, p.b, p.l, p.pages, CASE WHEN p.part = '' THEN p.template WHEN w.host IS NULL THEN p.template || '/' || p.part ELSE p.template || '/*' END AS template
  FROM part{k} p LEFT JOIN rare{k} w ON p.host = w.host AND p.template = w.template AND p.part = w.part),""")
        last = f"leaf{k}"
    z, agree = url_filter.Z, url_filter.AGREE
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM s),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{url_filter.VARIABLE}') THEN '*' ELSE x END) AS parts FROM j),
r AS (SELECT page_id, host, path, rule, said, array_to_string(parts, '/') AS key FROM v),
leaf0 AS (SELECT host, key, count(*) FILTER (said = 'block') AS b, count(said) AS l, count(*) AS pages, '' AS template FROM r GROUP BY host, key),
{"".join(levels)}
n AS (SELECT host, template, regexp_extract(template, '^/([^/]*)', 1) AS head, regexp_replace(template, '^/[^/]*', '') AS tail, sum(b)::BIGINT AS b, sum(l)::BIGINT AS l, sum(pages)::BIGINT AS n FROM {last} GROUP BY host, template),
o AS (SELECT host, tail, sum(n) AS tn, sum(b) AS pb, sum(l) AS pl FROM n GROUP BY ALL),
h AS (SELECT host, head, sum(n) AS hn FROM n GROUP BY ALL),
a AS (SELECT host, sum(tn) AS all_n, count(*) - 1 AS free FROM o GROUP BY ALL),
k AS (SELECT host, head, sum(n.n::DOUBLE * n.n * all_n / (hn::DOUBLE * tn)) - any_value(hn) <= any_value(free) + {z!r} * sqrt(2.0 * any_value(free)) + {url_filter.SLACK!r} AS alike
  FROM n JOIN o USING (host, tail) JOIN h USING (host, head) JOIN a USING (host) GROUP BY host, head),
c AS (SELECT n.*, k.alike AND (b * pl - pb * l)::DOUBLE * (b * pl - pb * l)::DOUBLE <= {z**2!r} * pb::DOUBLE * (pl - pb)::DOUBLE * l::DOUBLE AS same FROM n JOIN o USING (host, tail) JOIN k USING (host, head)),
m AS (SELECT host, tail, sum(b) AS mb, sum(l) AS ml, count(*) AS mk FROM c WHERE same AND l > 0 GROUP BY ALL),
w AS (SELECT host, sum(b) AS wb, sum(l) AS wl, count(DISTINCT head) AS wk FROM c WHERE same AND l > 0 GROUP BY ALL),
q AS (SELECT c.host, c.template, CASE WHEN NOT same THEN (b + 1)::DOUBLE / (l + 2) WHEN l > 0 OR mk >= {agree} THEN (mb + 1)::DOUBLE / (ml + 2) WHEN wk >= {agree} THEN (wb + 1)::DOUBLE / (wl + 2) ELSE 0.5 END AS purity
  FROM c LEFT JOIN m ON c.host = m.host AND c.tail = m.tail LEFT JOIN w ON c.host = w.host)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity >= {url_filter.PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN {last} x ON r.host = x.host AND r.key = x.key JOIN q ON q.host = x.host AND q.template = x.template
"""


_OP2 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p, q FROM i WHERE 100 * c >= 90 * (n + m - c)),
b AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
r AS (SELECT doc_id AS d, doc_id AS to_id FROM s UNION SELECT r.d, b.q FROM r JOIN b ON r.to_id = b.p)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.to_id) AS component_id FROM s JOIN r ON r.d = s.doc_id GROUP BY ALL
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op7_warc": _OP7, "op8_url_filter": _op8()}
