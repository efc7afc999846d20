"""The chain of stages on odd rows, each stage against a plain version of it."""

from collections import Counter

from pyspark.sql import functions as F
from test_selection import wanted_targets
from test_texts import WORD, brute_components

import corpus_pipeline
from lexisim.llm import quality_classifier, quality_rules, sentencepiece

FOLDER = "/root/testdata/sf0.001"


def key(rows):
    return Counter((r["doc_id"], r["text"], r["source"], r["_row"]) for r in rows)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("_row", F.lit("clash")).withColumn("score", F.lit(7))
    first = docs.orderBy("doc_id").limit(40)
    odd = first.withColumn("doc_id", F.lit(None).cast("long")).limit(3).unionByName(first.limit(5)).unionByName(first.limit(4).withColumn("source", F.lit(None).cast("string")))
    odd = odd.unionByName(first.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(first.limit(2).withColumn("text", F.lit("")))
    odd = odd.unionByName(first.limit(1).withColumn("doc_id", F.lit(10**6)).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 300)))
    odd = odd.unionByName(first.orderBy(F.desc("doc_id")).limit(1).withColumn("doc_id", F.lit(0)))  # one id, two texts
    (tmp_path / "t").mkdir()
    docs.unionByName(odd).write.parquet(f"{tmp_path}/t/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    labels.unionByName(labels.limit(2).withColumn("quality", F.lit(None).cast("int"))).write.parquet(f"{tmp_path}/t/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/t/labels.parquet")

    now, kept = spark.read.parquet(f"{tmp_path}/t/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, f"{tmp_path}/t")
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, now)
        assert name == "sentencepiece" or now.columns == before.columns

    before, after = kept["quality_classifier"]
    machine = quality_classifier.fit(before, labels)
    rows = before.collect()
    score = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        parts = quality_classifier.features(quality_classifier.np.frombuffer(raw, "u1"), quality_classifier.np.array([0, len(raw)]))
        score[r["text"]] = float(machine.score(*parts)[0])
    assert key(after.collect()) == key(r for r in rows if score[r["text"]] >= quality_classifier.THRESHOLD)

    before, after = kept["quality_rules"]
    good = Counter()
    for r in quality_rules.score(before, labels).where("kept").collect():
        good[r["doc_id"]] += 1
    assert Counter(r["doc_id"] for r in after.collect()) == good

    before, after = kept["ngram_jaccard_join"]
    groups = brute_components(before.collect(), 5, 80)
    assert after.count() == len({c for _, size, c in groups if size}) + sum(v for (_, size, _), v in groups.items() if not size)
    assert {r["doc_id"] for r in after.collect()} >= {c for _, size, c in groups if size and c is not None}

    before, after = kept["mixing"]
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in before.collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in after.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    target = wanted_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in sizes)
    assert set(key(after.collect())) <= set(key(before.collect()))

    before, after = kept["sentencepiece"]
    texts = Counter((r["doc_id"], r["text"]) for r in sentencepiece.decode(after).collect())
    assert texts == Counter((r["doc_id"], r["text"]) for r in before.collect())


def test_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
