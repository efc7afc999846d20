"""Small tables of documents, odd cases included."""

import random

import pytest

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text, lang, source, n_chars) with near copies, copies, nulls, empty and long texts and repeated rows."""
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, make(rng.randrange(1, 120)), "en", f"s{k % 4}" if k % 7 else None))
    base = make(150).split()
    for k in range(60, 90):  # one group of near copies
        own = list(base)
        own[rng.randrange(len(own))] = f"edit{k}"
        rows.append((k, " ".join(own), "en", "s0"))
    rows += [(k, rows[3][1], "en", "s1") for k in range(90, 100)]  # copies
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t ", "en", "s2"), (103, "one", "en", "s2"), (104, "ONE", "en", "s2"), (105, "two words", "en", "s2")]
    rows += [(106, make(20_000), "en", "s3"), (107, "x" * 50_000, "en", "s3"), (108, "naïve 東京 \U0001f600 ▁mark\u2581 \x00 tail\r\n\nend ", "fr", "s3"), (5, rows[5][1], "en", "s1"), (None, make(50), "en", "s1")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 100, 2)] + [(0, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
