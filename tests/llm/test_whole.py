"""Cases that operators once left out."""

import random
from collections import Counter

from lexisim.llm import fingerprint, licenses


def test_every_template_is_found(spark):
    rows = [(k, t) for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(500, "before it spdx-license-identifier: mit, after")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(name in got[k]["licenses"].split(",") for k, (name, _) in enumerate(licenses.TEMPLATES))
    assert [(s["license"], s["first_word"], s["last_word"]) for s in got[500]["spans"]] == [("MIT", 2, 5)]
    none = licenses.scan(spark.createDataFrame([(1, "spdx license identifier"), (2, "mit")], "doc_id long, text string"))
    assert sum(r["n_licenses"] for r in none.collect()) == 0


def test_texts_of_unequal_length_keep_their_matches():
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(3000)).encode()
    for other in (text[: len(text) * 2 // 3], text + text[::-1][: len(text) // 2]):
        (a, b), both = (list(fingerprint.sketches(*fingerprint._packed([text, other])))), []
        for t in (text, other):
            at, h = fingerprint.anchors(*fingerprint._packed([t]))
            both.append(set((h >> 32).tolist()))
        truth = len(both[0] & both[1]) / len(both[0] | both[1])
        assert abs(fingerprint.likeness(a, b) - truth) < 0.12, (fingerprint.likeness(a, b), truth)
        same = [fingerprint.decode(fingerprint.encode(x)) for x in (a, b)]
        assert fingerprint.likeness(*same) == fingerprint.likeness(a, b)


def plain_multiset(raw):
    at, h = fingerprint.anchors(*fingerprint._packed([raw]))
    return Counter((h >> 32).tolist())


def test_repetitive_texts_are_judged_by_all_their_anchors(spark):
    rng = random.Random(4)
    lines = [" ".join(str(rng.randrange(10**4)) for _ in range(12)) + "\n" for _ in range(6)]
    text = "".join(rng.choice(lines) for _ in range(200)).encode()
    other = text[: len(text) * 2 // 3] + " ".join(str(rng.randrange(10**6)) for _ in range(len(text) // 21)).encode()
    a, b = plain_multiset(text), plain_multiset(other)
    truth = sum((a & b).values()) / sum((a | b).values())
    assert truth > 0.35
    for kept in (None, fingerprint.KEPT):
        x, y = fingerprint.sketches(*fingerprint._packed([text, other]), kept)
        assert fingerprint.likeness(x, x, kept) == 1.0
        assert abs(fingerprint.likeness(x, y, kept) - truth) < (0.02 if kept is None else 0.15), kept
    rows = spark.createDataFrame([(1, text.decode())], "doc_id long, text string")
    whole = fingerprint.fingerprints(rows, None).first()["fingerprint"]
    assert int(whole.partition(":")[0]) > 1000 and int(fingerprint.fingerprints(rows).first()["fingerprint"].partition(":")[0]) == fingerprint.KEPT
