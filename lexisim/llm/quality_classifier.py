"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``y = b + sum w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j``, the pairwise part in
linear time by the sum-of-squares identity ``1/2 sum_f ((sum v_if x_i)^2 -
sum v_if^2 x_i^2)``. The features are the damped counts of ``WORDS`` hash
buckets of words, scaled to unit length, and statistics of the text's make-up
and size; labels, language, source and ids are not among them.

The machine is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows
(those with the smallest hash of their id, and ``4 * TRAIN_ROWS`` different
texts under these ids), the only bounded part; every text is scored whole. The same rows and seed give the same model.

Defined cases: null texts are empty, and empty texts are scored as any other;
a document with several labels counts as good if all of them are; labels
without value or document are not used; without labels every score is 0.5, with
labels of one kind only it is their smoothed rate; a null ``doc_id`` is not held
out; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, chunks, span_hashes, text_bytes, word_spans

WORDS, RANK, TRAIN_ROWS, EPOCHS, SEED = 1 << 12, 8, 4000, 24, 3
THRESHOLD, FOLDS = 0.3, 5
#: Statistics besides the words.
N_STATS = 17


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 marks of markup, 5 other marks, 6 white, 7 non-ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_CLASS[list(b"#*$%&|<>!")] = 4
_CLASS[[32, *range(9, 14)]] = 6


def _ratios(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x / np.maximum(y, 1)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, buckets and values of each row's words, and its statistics."""
    n = len(off) - 1
    starts, ends, words = word_spans(data, off)
    h = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(words))
    key, count = np.unique(row * WORDS + (h >> np.uint64(40)).astype(np.int64) % WORDS, return_counts=True)
    value = np.log1p(count)
    edge = np.searchsorted(key, np.arange(n + 1) * WORDS)
    square = np.bincount(key // WORDS, value**2, n)
    value = value / np.sqrt(np.maximum(square, 1e-12))[key // WORDS]

    size, n_words = np.diff(off).astype(float), np.diff(words).astype(float)
    of = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(of * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    length = ends - starts
    # Words by how they end and how they are written.
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = np.bincount(row, _CLASS[last] == 4, n)
    lone = np.bincount(row, (length == 1) & (_CLASS[last] >= 4), n)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASS[data] == 1, out=upper[1:])
    shouted = np.bincount(row, (upper[ends] - upper[starts] >= 2), n)
    different = np.bincount(np.unique(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)).astype(np.int64) >> 40, minlength=n).astype(float)
    lines = np.flatnonzero(data == 10)
    n_lines = np.searchsorted(lines, off[1:]) - np.searchsorted(lines, off[:-1]) + 1.0
    # Lines that occur before: hashes of the spans between line ends.
    cut = np.unique(np.concatenate([off[:-1], lines + 1, off[-1:]]))
    a, b = cut[:-1], cut[1:]
    line_row = np.searchsorted(off, a, "right") - 1
    line_hash = span_hashes(data, a, b)
    distinct = np.bincount(np.unique(line_row.astype(np.uint64) << np.uint64(40) | line_hash >> np.uint64(24)).astype(np.int64) >> 40, minlength=n)
    repeated = _ratios(np.bincount(line_row, minlength=n) - distinct, n_lines)
    long_words = np.bincount(row, length > 15, n)
    stats = [np.log1p(n_words) / 5, np.log1p(size) / 7, _ratios(size, n_words) / 10, *(_ratios(kinds[:, k], size) * 4 for k in range(1, 8)), _ratios(marked, n_words) * 2, _ratios(lone, n_words) * 2]
    stats += [_ratios(shouted, n_words) * 2, _ratios(different, n_words), np.minimum(_ratios(n_lines, n_words), 2), repeated * 2, _ratios(long_words, n_words) * 4]
    return edge, key % WORDS, value, np.stack(stats, 1)


class Machine:
    """Parameters of the fitted machine; the statistics are features WORDS and on."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def raw(self, edge: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's y, and its sums of v x by factor."""
        w, v = self.w, self.v
        s = _row_sums(v[bucket] * value[:, None], edge) + stats @ v[WORDS:]
        q = _row_sums((v**2)[bucket] * (value**2)[:, None], edge) + stats**2 @ (v[WORDS:] ** 2)
        linear = _row_sums((w[bucket] * value)[:, None], edge)[:, 0] + stats @ w[WORDS:]
        return self.bias + linear + 0.5 * (s**2 - q).sum(1), s

    def score(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*rows)[0], -30, 30)))


def _row_sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of x, one for each pair of edges."""
    out = np.zeros((len(edge) - 1, x.shape[1]))
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        out[full] = np.add.reduceat(x, edge[full])
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Fits by Adam on the logistic loss, in small batches; rows are (buckets, values, statistics)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(rows)
    rate = (labels.sum() + 1) / (n + 2) if n else 0.5
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(WORDS + N_STATS), np.zeros((WORDS + N_STATS, RANK)))
    if not n or labels.min() == labels.max():
        return m
    m.v = rng.normal(0, 0.02, m.v.shape)
    params = [np.array([m.bias]), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 100
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, size):
            own = order[lo : lo + size]
            edge = np.zeros(len(own) + 1, np.int64)
            np.cumsum([len(rows[k][0]) for k in own], out=edge[1:])
            bucket, value = (np.concatenate([rows[k][c] for k in own]) for c in (0, 1))
            stats = np.stack([rows[k][2] for k in own])
            m.bias, m.w, m.v = float(params[0][0]), params[1], params[2]
            y, s = m.raw(edge, bucket, value, stats)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[own]) / len(own)
            # d y / d v_i = x_i (s - v_i x_i)
            of = np.repeat(np.arange(len(own)), np.diff(edge))
            gx = g[of] * value
            gw, gv = np.zeros_like(m.w), np.zeros_like(m.v)
            gw[:WORDS] = np.bincount(bucket, gx, WORDS)
            gw[WORDS:] = g @ stats
            each = gx[:, None] * (s[of] - m.v[bucket] * value[:, None])
            for f in range(RANK):
                gv[:WORDS, f] = np.bincount(bucket, each[:, f], WORDS)
            gv[WORDS:] = stats.T @ (g[:, None] * s) - (g @ stats**2)[:, None] * m.v[WORDS:]
            step += 1
            pace = 0.02 * (1 - epoch / epochs)
            for p, grad, a, b in zip(params, (np.array([g.sum()]), gw + 2e-5 * m.w, gv + 1e-4 * m.v), first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """The machine fitted on at most ``rows`` labelled documents that are not held out."""
    bound_batches(docs.sparkSession)
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))
    chosen = good.where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(rows).collect()
    label_of = {r["doc_id"]: float(r["quality"] > 0) for r in chosen}
    if not label_of:
        return train([], np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                edge, bucket, value, stats = features(*text_bytes(batch.column(1)))
                bits = [[bucket[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], [value[a:b].astype(np.float32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], [s.tobytes() for s in stats]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(b, pa.binary()) for b in bits)], ["doc_id", "bucket", "value", "stats"])

    picked = docs.where(F.col("doc_id").isin(list(label_of))).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bucket binary, value binary, stats binary")
    # Texts under one id are examples each; of more than 4 * rows different ones, those of the smallest hash.
    picked = picked.distinct().orderBy(F.xxhash64("doc_id", "bucket", "value", "stats"), "doc_id").limit(4 * rows)
    picked = sorted((r["doc_id"], bytes(r["bucket"]), bytes(r["value"]), bytes(r["stats"])) for r in picked.collect())
    sets = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), np.frombuffer(s, float)) for _, b, v, s in picked]
    return train(sets, np.array([label_of[d] for d, *_ in picked]))


def _scored(docs: DataFrame, machine: Machine, extra: str) -> DataFrame:
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for whole in batches:
            for batch in chunks(whole):
                got = m.score(*features(*text_bytes(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], [extra, "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema[extra], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    machine = fit(docs, labels)
    rows = _scored(docs.select("doc_id", "text"), machine, "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier predicts to be good."""
    machine = fit(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return _scored(packed, machine, "_row").where(F.col("score") >= threshold).select("_row.*")
