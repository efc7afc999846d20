"""The likelihood ratio's table and threshold follow the corpus."""

import random

from lexisim.llm import quality_rules


def test_table_grows_and_threshold_is_fitted(spark, monkeypatch):
    assert quality_rules.n_buckets(1000) == quality_rules.BUCKETS
    assert quality_rules.n_buckets(quality_rules.BUCKETS * quality_rules.LOAD * 5) == 8 * quality_rules.BUCKETS
    rng = random.Random(3)
    text = lambda kind: " ".join(f"{kind}{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60))
    rows = [(k, text("good" if k % 3 else "junk")) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(450)], "doc_id long, quality int")
    monkeypatch.setattr(quality_rules, "BLOCKS", 4)
    for buckets in (32, 1 << 16):  # a crowded table, where all ratios are near 0, and a wide one
        got = quality_rules.score(docs, labels, buckets).collect()
        right = sum(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
        assert len(got) == 900 and right >= 890, (buckets, right)


def test_large_tables_give_the_same_scores(spark, docs, labels, monkeypatch):
    """Beyond its bounds nothing is sent to all tasks but hot buckets; the result is the same."""
    key = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], round(r["score"], 9), r["kept"]) for r in df.collect())
    want, kept = key(quality_rules.score(docs, labels)), quality_rules.keep(docs, labels).count()
    monkeypatch.setattr(quality_rules, "BROADCAST", 0)
    monkeypatch.setattr(quality_rules, "FEW", 0)
    assert key(quality_rules.score(docs, labels)) == want
    assert quality_rules.keep(docs, labels).count() == kept


def test_labels_that_ngrams_do_not_tell_apart_cost_no_clean_documents(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60))
    docs = spark.createDataFrame([(k, text()) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(200)], "doc_id long, quality int")
    fitted = quality_rules._sums(quality_rules.with_base_counts(docs).drop("text"), *quality_rules.fit_ratios(docs, labels))
    assert quality_rules.fit_threshold(fitted, labels) == quality_rules.THRESHOLD
