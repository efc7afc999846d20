"""Quality rules [native]: base counts and a hashed n-gram log-likelihood ratio.

Every expression is a built-in DataFrame function; no Python runs on the
executors. The trusted target and the raw corpus are multinomials over hashed
word unigrams and bigrams. A document's score is the mean over its n-grams of
``ln p_target - ln p_raw`` (in steps of ``1 / SCALE``, so sums are exact in any
order); it is kept at ``threshold`` or above, so equal texts always meet the
same verdict.

The table of ratios grows with the corpus: it has a bucket for each ``LOAD``
different words, ``BUCKETS`` at least. It is a joined table, sent to all tasks
up to ``BROADCAST`` buckets and dealt by bucket beyond; none of it reaches the
driver. The threshold is fitted: it parts the documents labelled 0 best from
the trusted ones, each n-gram of these scored as if it were not in the target
(both of ``MIN_WORDS`` words or more).

Defined cases: a null text counts as empty; a text without words has score 0
and fails the base rules (fewer than ``MIN_WORDS`` words); rows that repeat
count each time in the corpus and get the same verdict; a null ``doc_id`` is
never trusted; a document is trusted if it has labels and all are 1; without
trusted or without any documents every ratio is 0, so the base rules alone
decide; with fewer than ``LABELLED`` documents of either kind, or where they
can't be told apart, the threshold is ``THRESHOLD``. Further columns of the input are left out of the result (``score``)
or carried through unchanged (``keep``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisim.llm import common
from lexisim.llm.common import materialise, release

#: Base rules and the fitted part's parameters.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.08
#: Different words to a bucket (above BUCKETS buckets), and labelled documents that fit a threshold.
LOAD, LABELLED = 16, 20
#: Share of trusted documents that a fitted threshold keeps, and least difference of shares that makes a fit.
KEEP, PART = 0.999, 0.5
#: Buckets (of some 40 bytes) and keys (8 bytes) that are sent to all tasks, at most.
BROADCAST, FEW = 1 << 21, common.FEW
#: Tasks that count n-grams, for each core of the cluster.
TASKS = 2
#: A bucket is hot that has a BLOCKS-th of all n-grams; steps of a ratio; steps of the threshold.
BLOCKS, SCALE, STEPS = 64, 1 << 32, 1000

WHITE = " \\t-\\r"  # in a regular expression's class: x20 and x09-x0D


def _joined(name: str, step: int) -> Column:
    """Hashes of each entry with the one ``step`` further on; ``step`` entries fewer."""
    rest = F.slice(name, F.lit(1 + step), F.greatest(F.size(name) - step, F.lit(0)))
    both = F.zip_with(name, rest, lambda x, y: F.xxhash64(x, y))
    return F.slice(both, F.lit(1), F.greatest(F.size(name) - step, F.lit(0)))


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_t`` (text, null as empty), ``_w`` (words), ``_h`` and ``_h2`` (hashes of words and word pairs)."""
    spaced = F.regexp_replace("_t", "[\\t-\\r]", " ")
    return (
        docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_w", F.array_remove(F.split(spaced, " "), ""))
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_h2", _joined("_h", 1))
    )


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (and ``_h``, ``_h2``)."""
    none = F.array().cast("array<bigint>")
    df = _with_words(docs, text)
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{WHITE}]")))
    df = df.select(
        *[c for c in df.columns if c not in ("_t", "_w", "_lines")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows of WINDOW words by doubling. One that occurs twice repeats WINDOW / 2 + 1 windows of half its
    # length, so whole windows are formed only where that many of those repeat.
    half = WINDOW // 2
    df = df.withColumn("_h4", _joined("_h2", half // 2))
    lost = F.size("_h4") - F.size(F.array_distinct("_h4"))
    df = df.withColumn("_win", F.when(lost > half, _joined("_h4", half)).otherwise(none))
    keyed = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_key", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), keyed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    found = F.filter("_key", lambda x, k: same(x, F.get("_key", k - 1)) | same(x, F.get("_key", k + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    spans = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1), p + WINDOW) - p))
    df = df.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_h4", "_win", "_key", "_at")


def _trusted(labels: DataFrame) -> DataFrame:
    """doc_id and good (1: all labels are 1; else 0) of each labelled document; sent to all if there are FEW at most."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce((F.min("quality") == 1).cast("int"), F.lit(0)).alias("good"))
    return F.broadcast(said) if said.count() <= FEW else said


def _grams(rows: DataFrame) -> DataFrame:
    """A row for each n-gram of ``rows`` (with ``_h`` and ``_h2``), its hash as ``_g``; one with null for rows without."""
    return rows.select(*[c for c in rows.columns if c not in ("_h", "_h2")], F.explode_outer(F.concat("_h", "_h2")).alias("_g"))


def _bucket(size: int) -> Column:
    return F.pmod("_g", F.lit(size)).cast("int").alias("b")


def n_buckets(distinct: int, least: int = BUCKETS) -> int:
    """Buckets for so many different words: ``least``, doubled until there is one for each LOAD of them."""
    while least * LOAD < distinct:
        least *= 2
    return least


def fit_ratios(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING) -> tuple[DataFrame, int, int] | None:
    """b, x (n-grams of the corpus), ratio and without (the ratio without one of its trusted n-grams) of each bucket, in
    steps of 1 / SCALE; the number of buckets; and of n-grams. None where no document is trusted.

    N-grams are counted where they are, by bucket, and only counts are dealt out; the trusted documents alone are
    looked for by id. A task may deal out a count for every bucket, so there are no more tasks than TASKS a core: what
    is dealt out grows with the table, not with the table times the corpus. Three numbers reach the driver.
    """
    tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    words = _with_words(docs.select("text"), "text")
    size = buckets or n_buckets(words.select(F.explode("_h").alias("h")).agg(F.approx_count_distinct("h").alias("d")).first()["d"])
    count = lambda rows, name: _grams(rows).where("_g is not null").groupBy(_bucket(size)).agg(F.count(F.lit(1)).alias(name))
    good = docs.select("doc_id", "text").join(_trusted(labels).where("good = 1").select("doc_id"), "doc_id")
    raw, target = (count(_with_words(x.coalesce(tasks), "text").select("_h", "_h2"), name) for x, name in ((docs.select("text"), "x"), (good, "y")))
    table = materialise(raw.join(target, "b", "left").select("b", "x", F.coalesce("y", F.lit(0)).cast("long").alias("y")), "counts")
    total = table.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    if not total["y"]:
        release(table)
        return None
    shift = math.log((total["x"] + smoothing * size) / (total["y"] + smoothing * size))
    ratio = lambda y: F.round((F.log(y + smoothing) - F.log(F.col("x") + smoothing) + shift) * SCALE).cast("long")
    return table.select("b", "x", ratio(F.col("y")).alias("ratio"), ratio(F.greatest(F.col("y") - 1, F.lit(0))).alias("without")), size, total["x"]


def _sums(rows: DataFrame, table: DataFrame, size: int, n: int) -> DataFrame:
    """``rows`` without their n-grams, with _n (n-grams), _total and _held (sums of ratio and without).

    A table of BROADCAST buckets at most goes to all tasks. A larger one stays dealt by bucket and the n-grams go to
    it, but for the buckets with more than a BLOCKS-th of all n-grams, which are fewer than BLOCKS and go to all tasks.
    """
    keys = [c for c in rows.columns if c not in ("_h", "_h2")]
    grams = _grams(rows).withColumn("b", _bucket(size)).drop("_g")
    if size <= BROADCAST:
        found = grams.join(F.broadcast(table), "b", "left").select(*keys, "ratio", "without")
    else:
        hot = F.col("x") > n // BLOCKS
        found = grams.join(F.broadcast(table.where(hot).select("b", "ratio", "without")), "b", "left")
        rest = found.where("ratio is null").drop("ratio", "without").join(table.where(~hot), "b", "left").select(*keys, "ratio", "without")
        found = found.where("ratio is not null").select(*keys, "ratio", "without").unionByName(rest)
    return found.groupBy(*keys).agg(F.count("ratio").alias("_n"), F.coalesce(F.sum("ratio"), F.lit(0)).alias("_total"), F.coalesce(F.sum("without"), F.lit(0)).alias("_held"))


def fit_threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The threshold with the largest share of trusted less share of others at or above it; the middle of equal ones.

    It keeps a share of KEEP of the trusted at least. Where the shares then differ by less than PART, the labels are
    not told apart by their n-grams (what a classifier has left of the rejected, for example): THRESHOLD.
    ``scores`` has doc_id, _n, _total and _held. A histogram by steps reaches the driver.
    """
    step = F.floor(F.when(F.col("good") == 1, F.col("_held")).otherwise(F.col("_total")) / F.col("_n") / SCALE * STEPS)
    labelled = scores.where(F.col("_n") >= 2 * MIN_WORDS - 1).select("doc_id", "_n", "_total", "_held").distinct().join(_trusted(labels), "doc_id")
    rows = labelled.groupBy((F.col("good") == 1).alias("good"), step.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    good, bad = ({r["at"]: r["n"] for r in rows if r["good"] == is_good} for is_good in (True, False))
    goods, bads = sum(good.values()), sum(bad.values())
    if min(goods, bads) < LABELLED:
        return THRESHOLD
    most, best, g, b = -1, [], goods, bads
    for at in range(min([*good, *bad]), max([*good, *bad]) + 1):  # g and b are at or above ``at``
        worth = g * bads - b * goods
        if g < KEEP * goods:
            break
        if worth > most:
            most, best = worth, [at]
        elif worth == most and best[-1] == at - 1:
            best.append(at)
        g, b = g - good.get(at, 0), b - bad.get(at, 0)
    return best[len(best) // 2] / STEPS if most >= PART * goods * bads else THRESHOLD


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _judged(docs: DataFrame, labels: DataFrame, buckets: int | None, threshold: float | None) -> DataFrame:
    """doc_id, _mark (hash of id and text), the base counts, base_failed, score and kept of each row of ``docs``."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_mark")
    fitted = fit_ratios(docs, labels, buckets)
    rows = with_base_counts(docs.select("doc_id", "text", key)).drop("text")
    if fitted is None:
        return rows.drop("_h", "_h2").withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    scores = materialise(_sums(rows, *fitted), "scores")
    least = threshold if threshold is not None else fit_threshold(scores, labels)
    out = scores.withColumn("score", F.when(F.col("_n") > 0, F.col("_total") / F.col("_n") / SCALE).otherwise(F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def score(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float | None = None) -> DataFrame:
    """doc_id with the base counts, base_failed, score and kept, a row for each row of ``docs``."""
    return _judged(docs, labels, buckets, threshold).select("doc_id", *_COUNTS, "score", "kept")


def keep(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep.

    Verdicts are matched by a hash of id and text; where FEW rows or fewer stay, no text is dealt out for it.
    """
    kept = _judged(docs, labels, buckets, threshold).where("kept").select("_mark").distinct()
    kept = materialise(kept, "kept")
    kept = F.broadcast(kept) if kept.count() <= FEW else kept
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_k"))
    return packed.join(kept, F.col("_k") == F.col("_mark"), "left_semi").select("_row.*")
