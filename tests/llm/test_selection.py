"""Mixing, classifier, rules and URL filters against plain definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexisim.llm import mixing, quality_classifier, quality_rules, url_filter
from lexisim.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rate = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * rate > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * rate for s in order}
        full |= over


def test_mixing(docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)  # several blocks and levels
    monkeypatch.setattr(mixing, "FAN", 3)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes, largest, taken = Counter(), Counter(), Counter()
    source = {}
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    target = wanted_targets(dict(sizes))
    for r in got:
        source[r["doc_id"]] = r["source"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    key = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows)
    assert key(mixing.mix(docs.repartition(3)).collect()) == key(got)
    assert mixing.mix(no_docs).count() == 0
    clash = docs.withColumn("target", F.lit("x")).withColumn("copies", F.lit("y")).withColumn("_row", F.lit(1))
    mixed = mixing.apply(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r["copies"] for r in got)


def test_pivotal_rounding_keeps_marginals_and_totals():
    sizes, p = [1, 2, 3, 4, 50, 7], [0.3, 0.8, 0.5, 0.1, 0.25, 0.6]
    fields = [f.split() for f in mixing._OUT.split(", ")][:-1]
    rows = [dict(doc_id=k, source="s", size=s, h=k * 7919, whole=0, p=q, block=0) for k, (s, q) in enumerate(zip(sizes, p, strict=True))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], mixing._TYPES[t]) for n, t in fields], [n for n, _ in fields])
    total, seen, n = sum(s * q for s, q in zip(sizes, p, strict=True)), np.zeros(len(sizes)), 4000
    for seed in range(n):
        got = {r["doc_id"]: r["more"] for b in mixing._settle(True, seed)(iter([batch])) for r in b.to_pylist()}
        assert abs(sum(sizes[k] * m for k, m in got.items()) - total) <= max(sizes)
        seen += [got[k] for k in range(len(sizes))]
    assert seen / n == pytest.approx(p, abs=0.04)


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    d = quality_classifier.WORDS + quality_classifier.N_STATS
    m = quality_classifier.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, 3)))
    bucket, value, stats = np.array([5, 9, 77]), rng.normal(size=3), rng.normal(size=(1, quality_classifier.N_STATS))
    x = np.zeros(d)
    x[bucket], x[quality_classifier.WORDS :] = value, stats[0]
    g = m.v @ m.v.T
    want = 0.3 + m.w @ x + sum(g[i, j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert m.raw(np.array([0, 3]), bucket, value, stats)[0][0] == pytest.approx(want)


def test_classifier(spark, docs, no_docs, labels):
    got = quality_classifier.score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("?"))
    assert sorted(r["score"] for r in quality_classifier.score(other, labels).collect()) == sorted(r["score"] for r in got)
    assert {r["score"] for r in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(no_docs, labels).count() == 0
    kept = quality_classifier.keep(docs.withColumn("score", F.lit(9)).withColumn("_row", F.lit(1)), labels)
    assert kept.columns[-2:] == ["score", "_row"] and kept.count() == sum(r["predicted"] for r in got)


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_classifier.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def base(text):
    w = WORD.findall(text)
    at, covered = defaultdict(list), set()
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    for places in at.values():
        if len(places) > 1:
            covered.update(j for k in places for j in range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text):
    h = [spark_hash(w.encode()) for w in WORD.findall(text)]
    return [x % quality_rules.BUCKETS for x in h + [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]]


def test_rules(spark, docs, no_docs, labels):
    line = "a line that is said again and again by all of them here"
    extra = spark.createDataFrame([(200, f"{line}\n{line}\n# x | y\n\n{line} now", "en", "s", 1), (201, "w " * 9, "en", "s", 1), (202, "q " * 40, "en", "s", 1), (203, "w " * 8, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows = docs.collect()
    said = defaultdict(list)
    for r in labels.collect():
        said[r["doc_id"]].append(r["quality"])
    good = {k for k, v in said.items() if k is not None and min((q for q in v if q is not None), default=0) == 1}
    raw, target = Counter(), Counter()
    for r in rows:
        g = grams(r["text"] or "")
        raw.update(g)
        if r["doc_id"] in good:
            target.update(g)
    b = quality_rules.BUCKETS
    ratio = lambda k: math.log((target[k] + 1) / (sum(target.values()) + b)) - math.log((raw[k] + 1) / (sum(raw.values()) + b))
    want = []
    for r in rows:
        counts, g = base(r["text"] or ""), grams(r["text"] or "")
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, *counts, failed, not failed and score >= quality_rules.THRESHOLD, round(score, 6)))
    got = quality_rules.score(docs.withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(1)), labels).collect()
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], round(r["score"], 6)) for r in got]
    assert sorted(got) == sorted(want)
    assert any(g[4] for g in got) and any(g[5] for g in got)
    assert quality_rules.score(no_docs, labels).count() == 0
    kept = quality_rules.keep(docs.withColumn("kept", F.lit("mine")), labels)
    assert kept.columns[-1] == "kept" and kept.count() == sum(g[7] for g in got)
    assert quality_rules.score(docs, labels.limit(0)).where("kept <> (not base_failed)").count() == 0


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_run_no_python(docs, labels):
    assert not re.search("Python|Pandas|Arrow", plan_text(quality_rules.score(docs, labels)))


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/1?x#y", "http://com", "http://xcom/a", "https://www.example.com/en/5", "http://shop.net/es/1", "ftp://a.net/fr/2#t", "x://É.net/es/ñ", "a://b://c.com/d", "http://h.org/a\nb?c"]
    urls += [f"http://hot.net/{p}/{k}.html" for k in range(30) for p in ("es", "en")] + [f"http://hot.net/slug-{k}/x" for k in range(40)] * 2
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(pages, URL_RULES).orderBy("page_id").collect()
    assert len(got) == len(urls)
    for r, u in zip(got, urls, strict=True):
        host, path = parsed(u)
        rule = ruled(host, path)
        assert (r["host"], r["path"]) == (host, path), u
        assert r["rule"] == (rule and rule[1] + rule[2]) and r["verdict"] == (rule[0] if rule else "allow"), u
    assert {r["template"] for r in got if "slug-" in (r["path"])} == {"/*/x"}
    # What the rules label rejects unlabelled pages of the same template.
    own = [("block", "spam.org", "/buy/2")]
    more = spark.createDataFrame([(k, f"http://spam.org/buy/{k}") for k in range(200, 300)] + [(k, f"http://spam.org/buy/{k}") for k in range(300, 310)] + [(k, f"http://spam.org/read/{k}") for k in range(5)], "page_id long, url string")
    found = {(r["path"], r["verdict"]) for r in url_filter.judge(more, own).collect()}
    assert ("/buy/301", "block") in found and ("/read/1", "allow") in found
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
