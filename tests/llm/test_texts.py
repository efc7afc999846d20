"""N-gram join, tokenisers, license scan, fingerprints and archives against plain definitions."""

import gzip
import hashlib
import itertools
import math
import random
import re
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisim.llm import components, fingerprint, licenses, ngram_jaccard, sentencepiece, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingles(r["text"], n) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(k)] = min(least.get(root(k), 1 << 62), r["doc_id"])
    return Counter((r["doc_id"], len(sets[k]), least.get(root(k))) for k, r in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, no_docs, n, percent):
    rows = docs.collect()
    found = ngram_jaccard.join(docs.withColumn("node", F.lit("clash")), n, percent)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())
    assert got == brute_components(rows, n, percent)
    kept = ngram_jaccard.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    n_groups = len({c for _, size, c in got if size}) + sum(v for (_, size, _), v in got.items() if not size)
    assert kept.count() == n_groups
    assert ngram_jaccard.join(no_docs, n, percent).count() == 0


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    rng = random.Random(8)
    one, two = (" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(2))
    rows = [(3, one, "a"), (5, one, "b"), (5, two, "c"), (5, two, "d"), (7, two, "e"), (None, "alone in the world of ids", "f"), (9, None, "g"), (9, " ", "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, note string")
    for _ in range(2):  # in any order
        got = sorted((r["doc_id"] or 0, r["text"] or "", r["note"]) for r in ngram_jaccard.keep_one(table).collect())
        assert [(i, t) for i, t, _ in got] == [(0, rows[5][1]), (3, one), (5, two), (9, ""), (9, " ")]
        assert got == sorted((r["doc_id"] or 0, r["text"] or "", r["note"]) for r in ngram_jaccard.keep_one(table.repartition(3, "note")).collect())
    plain = table.where("doc_id in (3, 7) or note = 'b'")
    assert sorted(r["doc_id"] for r in ngram_jaccard.keep_one(plain).collect()) == [3, 7]


def test_ngram_join_of_random_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT", 5)  # salted buckets
    monkeypatch.setattr(ngram_jaccard, "MEMBERS", 4)
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 90]))] for _ in range(6)]
    rows = []
    for k in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(30)}"
        rows.append((k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(table, 3, 80).collect())
    assert got == brute_components(table.collect(), 3, 80)


def test_trie_walk():
    rng = np.random.default_rng(2)
    for _ in range(40):
        universe = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        pick = lambda: np.sort(rng.choice(universe, rng.integers(1, 40), replace=False))  # noqa: B023, E731
        probes = [pick() for _ in range(3)]
        members = [(int(g), p if rng.random() < 0.2 else np.sort(rng.permutation(p)[: max(1, len(p) - rng.integers(0, 3))])) for g, p in ((g, probes[g]) for g in rng.integers(0, 3, 12))] + [(0, pick())]
        got = ngram_jaccard.walk(probes, members, 80)
        for ok, (g, m) in zip(got, members, strict=True):
            both = len(np.intersect1d(m, probes[g]))
            assert ok == (100 * both >= 80 * (len(m) + len(probes[g]) - both))


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    for a, b in links:
        if a != b:
            up.setdefault(a, {a}).add(b)
            up.setdefault(b, {b}).add(a)
    for node in up:
        seen, todo = {node}, [node]
        while todo:
            for x in up[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)


def test_sentencepiece_round_trip(docs, no_docs):
    found = sentencepiece.encode(docs.withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1)))
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r["lossless"] is not False for r in rows) and sum(r["lossless"] is None for r in rows) == 1
    again = Counter((r["doc_id"], tuple(r["ids"] or ())) for r in sentencepiece.encode(docs.repartition(3)).collect())
    assert again == Counter((r["doc_id"], tuple(r["ids"] or ())) for r in rows)
    texts = Counter((r["doc_id"], r["text"]) for r in sentencepiece.decode(found).collect())
    assert texts == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert sentencepiece.encode(no_docs).count() == 0


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepiece.MODEL, "rb") as f:
        return sentencepiece.Pieces(f.read(), 0.6)


def test_samples_follow_the_lattice(pieces):
    """Frequencies of sampled segmentations against all segmentations' exact probabilities."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    size = sp.vocab_size()
    real = [k for k in range(size) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    rank = {sp.id_to_piece(k): j for j, k in enumerate(sorted(real, key=lambda k: -sp.get_score(k)))}
    logp = {t: 0.6 * (-math.log(r + sentencepiece.SHIFT) - math.log(math.log(size))) for t, r in rank.items()}
    unit = "\u2581thern"
    mass = {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(unit[at:k])
                at = k
        if all(p in logp for p in parts):
            mass[tuple(parts)] = math.exp(sum(logp[p] for p in parts))
    total = sum(mass.values())
    n = 20_000
    ids = sentencepiece.encode_chunk(pieces, ["thern"] * n, np.arange(n, dtype=np.uint64), 1)
    seen = Counter(tuple(sp.id_to_piece(int(k)) for k in x) for x in ids)
    assert set(seen) <= set(mass)
    for parts, m in mass.items():
        assert seen[parts] / n == pytest.approx(m / total, abs=0.015)


def test_long_words_stay_in_range(pieces):
    texts = ["ab" * 3000, "東" * 500, "\U0001f600" * 300, "q\n" * 200]
    for text, ids in zip(texts, sentencepiece.encode_chunk(pieces, texts, np.arange(4, dtype=np.uint64), 1), strict=True):
        assert sentencepiece.decode_ids(pieces, ids.tolist()).decode() == text


def test_licenses(spark, docs, no_docs):
    mit = dict(t[::-1] for t in licenses.TEMPLATES if len(t[1]) > 400)
    long = next(iter(mit))
    filler = "words go here and there " * 40
    rows = [(k, f"{filler}{t}\n{filler}") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    cut = long.split()
    rows += [(500, filler + " ".join(cut[: len(cut) * 9 // 10])), (501, filler + " ".join(cut[: len(cut) // 2])), (502, f"{filler} released under the mit license, {filler} Released under the MIT License.")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(table.withColumn("spans", F.lit(1))).collect()}
    index = licenses.Index(licenses.TEMPLATES)
    for k, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = set(licenses.shingles(raw, np.array([0, len(raw)]))[0].tolist())
        names = {name for name, s in zip(index.names, index.sets, strict=True) if len(x & set(s.tolist())) >= 0.8 * len(s)}
        assert set(filter(None, got[k]["licenses"].split(","))) == names, text[:200]
    assert got[500]["n_licenses"] == 1 and got[501]["n_licenses"] == 0
    assert [s["license"] for s in got[502]["spans"]] == ["MIT", "MIT"]
    assert sum(r["n_licenses"] for r in licenses.scan(docs).collect()) == 0 and licenses.scan(no_docs).count() == 0


def plain_anchors(raw):
    h = [int(x) for x in fingerprint._smer_hashes(np.frombuffer(raw, np.uint8))]
    w = fingerprint.K - fingerprint.S + 1
    return [k for k in range(len(raw) - fingerprint.K + 1) if h[k : k + w].index(min(h[k : k + w])) in (0, w - 1)]


def test_anchors_are_closed_syncmers():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 5, 15, 16, 17, 200, 900)]
    data, off = fingerprint._packed(texts)
    at, _ = fingerprint.anchors(data, off)
    want = [int(off[k]) + a for k, t in enumerate(texts) for a in plain_anchors(t)]
    assert at.tolist() == want


def test_fingerprints(docs, no_docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 9)
    rows = sorted(docs.collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -1), (r["text"] or "").encode()))
    want = Counter()
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, nxt = r["text"] or "", after["text"] or ""
        cut = len(text) // 3
        want[r["doc_id"], len(text), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    got = fingerprint.compare_with_edits(docs.withColumn("block", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    own = {}
    for r in docs.collect():
        own[r["doc_id"], len(r["text"] or "")] = r["text"] or ""
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["near_edited"] == fingerprint.likeness(fingerprint.decode(r["fingerprint"]), fingerprint.decode(r["edited_fingerprint"]))
        text = own[r["doc_id"], r["n_chars"]]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] > 500 and r["doc_id"] not in (107,)]
    assert min(r["near_edited"] for r in long) > 0.25
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert all(alone[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] not in (5, None))
    assert fingerprint.compare_with_edits(no_docs).count() == 0
    one = docs.where("doc_id = 7")
    assert fingerprint.compare_with_edits(one).count() == 1


def test_warc(spark, tmp_path):
    big = "<p>päge</p>" * 9000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/\r\nx", ""), (5, "u", "<html>\r\n\r\nWARC/1.1\r\n"), (5, "t", "<html>\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (None, "n", big), (9, "z", "0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "archive")
    warc.write(pages, path, segment=2048)
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "archive").glob("*.gz")))
    assert raw.count(b"WARC-Type: continuation") > 20 and raw.endswith(b"\r\n\r\n")
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    sha = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    seen = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]) for r in got)
    size = lambda t: len((t or "").encode())
    text = [r[2] for r in rows]
    want = [(1, "response", None, 0), (2, "revisit", 1, 1), (3, "response", None, 2), (4, "revisit", 3, 3), (5, "response", None, 4), (5, "revisit", 5, 5), (None, "response", None, 6), (None, "revisit", 1, 7), (9, "response", None, 8)]
    assert seen == Counter((p, kind, of, sha(text[k]), size(text[k])) for p, kind, of, k in want)
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["payload"] is not None}[1] == big.encode()
    assert warc.round_trip(pages, least=100).where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(pages.limit(0)).count() == 0
    # A lost segment is noticed.
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    parts = raw.split(b"WARC/1.1\r\nWARC-Type: ")
    gone = next(k for k, p in enumerate(parts) if b"WARC-Segment-Number: 3\r\n" in p)
    (damaged / "a.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: ".join(parts[:gone] + parts[gone + 1 :])))
    with pytest.raises(Exception, match="segments"):
        warc.read(spark, str(damaged)).collect()


def test_many_pages_pass_through_segments(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    warc.write(pages, str(tmp_path / "a"))
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "a").glob("*.gz"))
    assert raw.count(b"WARC-Segment-Number: 1\r\n") > 40
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read(spark, str(tmp_path / "a")).where("record_type = 'response'").collect()}
    assert all(r["html"].encode() == back[r["page_id"]] for r in pages.collect() if r["page_id"] in back) and len(back) > 100


def test_token_counts(spark, docs, no_docs, tmp_path):
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder = token_counts._encoder(f.read(), token_counts.PATTERN)
    want = Counter((r["doc_id"], len(encoder.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count(docs).collect()) == want
    assert token_counts.count(no_docs).count() == 0
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 5000).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    lengths = [len(x) for x in "".join(chr(97 + k) for k in ids).split("f")]
    want = [(k, n, True) for k, n in enumerate(lengths[:-1])] + ([(len(lengths) - 1, lengths[-1], False)] if lengths[-1] else [])
    for block in (1, 7, 64, 10_000):
        got = token_counts.scan(spark, str(tmp_path), 5, block).collect()
        assert sorted((r["place"], r["n_tokens"], r["ended"]) for r in got) == want
    # Ranges of a few bytes: documents, ids and separators lie across their edges. A byte order mark is no token less.
    (tmp_path / "b.bin").write_bytes(b"\xef\xbb\xbf\x00\x05\x05\x05\x00" * 9 + b"\x01\x00")
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", "4097", before):
        spark.conf.set(name, size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = token_counts.scan(spark, str(tmp_path), 5).collect()
        assert sorted((r["place"], r["n_tokens"], r["ended"]) for r in rows if r["file"].endswith("a.bin")) == sorted(want), size
        assert sorted((r["place"], r["n_tokens"], r["ended"]) for r in rows if r["file"].endswith("b.bin")) == [*((k, 3, True) for k in range(9)), (9, 1, False)], size
    spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "b.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="half a token"):
        token_counts.scan(spark, str(tmp_path)).collect()


def test_file_numbers_are_not_taken_from_names(spark, docs, monkeypatch):
    """Spark's file names hold a UUID, which may itself have a group like a file number."""
    real = token_counts.scan

    def renamed(*args):
        return real(*args).withColumn("file", F.regexp_replace("file", r"(part-\d+)-[0-9a-f-]+-(c\d+)", "$1-f7b1e955-c896-4ba7-c123-0123456789ab-$2"))

    monkeypatch.setattr(token_counts, "scan", renamed)
    monkeypatch.setattr(token_counts, "PER_FILE", 7)
    assert token_counts.count(docs).count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "mixing", "sentencepiece"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert counts[0] < 200 and counts[2] < counts[1] < counts[0] and counts[4] == counts[3] > 0
    assert docs.where("not lossless").count() == 0
