"""Document fingerprints from closed syncmers.

A k-mer of UTF-8 bytes is a closed syncmer if the smallest hash of its s-mers
(leftmost of equals) is at its first or last place: a choice by content alone,
so equal passages choose equal anchors wherever they stand. An anchor that
occurs again counts again: its second, third, ... occurrence is an anchor of
its own, so a text's anchors are a multiset. A fingerprint is the ``KEPT``
smallest hashes of a text's anchors, or all of them where ``kept`` is None,
each with its place (in bytes), as hexadecimal text: ``size:hash+place...``.

``likeness`` compares two fingerprints: the anchors are matched over the
smallest hashes of the union (a bottom-k estimate of the Jaccard similarity of
the multisets; exact with all anchors), and a match counts if its places agree
with the others, that is if their shift is near the median shift.

Defined cases: null texts are empty; texts under k bytes have one anchor, their
whole; an empty text has an empty list (likeness 1 to another empty one, 0 to
others); equal texts have equal fingerprints, wherever and however often they
occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, mix64, text_bytes

K, S, KEPT = 16, 6, 128
#: Places agree within so many 256ths of the longer text (up to its last kept anchor).
NEAR = 24


def _smer_hashes(data: np.ndarray) -> np.ndarray:
    x = np.zeros(max(0, len(data) - S + 1), np.uint64)
    for k in range(S):
        x |= data[k : k + len(x)].astype(np.uint64) << np.uint64(8 * k)
    return mix64(x)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the closed syncmers that lie within one row each, and their k-mer hashes."""
    n, w = len(data), K - S + 1  # w s-mers of a k-mer
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _smer_hashes(data)
    # The smallest of w hashes by doubling; ties go to the left as only the first and last place are compared.
    low, span = h, 1
    while span * 2 <= w - 2:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    count = len(h) - w + 1
    inner = np.minimum(low[1 : 1 + count], low[w - 1 - span : w - 1 - span + count])  # places 1 to w - 2
    first, last = h[:count], h[w - 1 : w - 1 + count]
    closed = (first <= np.minimum(inner, last)) | (last < np.minimum(inner, first))
    at = np.flatnonzero(closed)
    row = np.searchsorted(off, at, "right") - 1
    at = at[at + K <= off[row + 1]]
    # Two overlapping s-mer hashes and a middle one cover the k-mer's bytes.
    x = h[at] ^ mix64(h[at + w - 1] + np.uint64(1)) ^ mix64(h[at + (w - 1) // 2] + np.uint64(2))
    return at, mix64(x)


def sketches(data: np.ndarray, off: np.ndarray, kept: int | None = KEPT) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the ``kept`` smallest 32-bit anchor hashes (all without), in order, and their places (in bytes)."""
    at, h = anchors(data, off)
    h = (h >> np.uint64(32)).astype(np.uint32)
    row = np.searchsorted(off, at, "right") - 1
    length = np.diff(off)
    short = np.flatnonzero((length > 0) & (np.bincount(row, minlength=len(length)) == 0))
    if len(short):  # no k-mer fits, or none is closed: the whole text
        whole = [int.from_bytes(hashlib.blake2b(data[off[r] : off[r + 1]].tobytes(), digest_size=4).digest(), "big") for r in short]
        at, h, row = np.append(at, off[short]), np.append(h, np.array(whole, np.uint32)), np.append(row, short)
    place = (at - off[row]).astype(np.uint64)
    # One sort by row, hash, place.
    key = (h.astype(np.uint64) << np.uint64(32)) | place
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, key = row[order], key[order]
    # The occurrences of an anchor, in the order of the text, are told apart by number.
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(_first(row, key), np.arange(len(key)), 0)) if len(key) else key.astype(np.int64)
    again = np.flatnonzero(nth)
    if len(again):
        other = mix64((key[again] & ~np.uint64(0xFFFFFFFF)) + nth[again].astype(np.uint64))
        key[again] = (other & ~np.uint64(0xFFFFFFFF)) | (key[again] & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        row, key = row[order], key[order]
        new = _first(row, key)  # two that share a hash by chance are one
        row, key = row[new], key[new]
    edge = np.searchsorted(row, np.arange(len(length) + 1))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        part = key[a : b if kept is None else min(b, a + kept)]
        out.append(((part >> np.uint64(32)).astype(np.uint32), (part & np.uint64(0xFFFFFFFF)).astype(np.int64)))
    return out


def _first(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its row's equal hashes."""
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | ((key[1:] >> np.uint64(32)) != (key[:-1] >> np.uint64(32)))
    return new


def encode(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """A sketch as text: the number of anchors, then 8 hexadecimal digits of hash and 8 of place for each."""
    h, place = sketch
    raw = np.zeros((len(h), 8), np.uint8)
    raw[:, :4] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    raw[:, 4:] = place.astype(">u4").view(np.uint8).reshape(-1, 4)
    return f"{len(h)}:{raw.tobytes().hex()}"


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sketch that ``encode`` wrote."""
    raw = np.frombuffer(bytes.fromhex(text.partition(":")[2]), np.uint8).reshape(-1, 8)
    return raw[:, :4].copy().view(">u4").ravel().astype(np.uint32), raw[:, 4:].copy().view(">u4").ravel().astype(np.int64)


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], kept: int | None = KEPT) -> float:
    """0 to 1: share of the union's smallest anchors (all without ``kept``) that both have at agreeing places."""
    (a, p), (b, q) = x, y
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    twin = np.flatnonzero(ranked[1:] == ranked[:-1])
    distinct = len(ranked) - len(twin)
    # Lists below ``kept`` are complete, so the similarity is exact; else it is over the smallest of the union.
    size = distinct if kept is None or len(a) < kept and len(b) < kept else min(kept, distinct)
    # Rank among the distinct values of the union, for the pairs.
    rank = twin - np.arange(len(twin))
    twin = twin[rank < size]
    if not len(twin):
        return 0.0
    shift = p[order[twin]] - q[order[twin + 1] - len(a)]
    near = NEAR / 256 * max(p.max(), q.max(), 1)
    return float(np.count_nonzero(np.abs(shift - np.median(shift)) <= near) / size)


def fingerprints(docs: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """doc_id and fingerprint of each row's text; with all its anchors where ``kept`` is None."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in _in_pieces(data, off, kept=kept)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _in_pieces(data: np.ndarray, off: np.ndarray, most: int = 1 << 19, kept: int | None = KEPT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    start, n = 0, len(off) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield from sketches(data[off[start] : off[stop]], off[start : stop + 1] - off[start], kept)
        start = stop


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


#: Documents of one range of ids, at the least.
BLOCK = 4000
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come block by block in descending order, each block ended by a copy of the next block's first row."""
    held: tuple | None = None  # the last row, whose next one is still to come
    names = [f.split()[0] for f in _OUT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _OUT.split(", ")])

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, hashes, texts, edits = [], [], [], [], []
        for doc, text, after in rows:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            ids.append(doc)
            sizes.append(len(text))
            edits.append(edited.encode())
            texts.append(text.encode())
            hashes.append(hashlib.sha256(edits[-1]).hexdigest())
        own = list(_in_pieces(*_packed(texts)))
        new = list(_in_pieces(*_packed(edits)))
        ends = [after.encode() for k, (_, _, after) in enumerate(rows) if k + 1 == len(rows) or rows[k + 1][1] is not after]
        extra = iter(_in_pieces(*_packed(ends)))
        nxt = [own[k + 1] if k + 1 < len(rows) and rows[k + 1][1] is rows[k][2] else next(extra) for k in range(len(rows))]
        columns = [ids, sizes, hashes, [encode(s) for s in own], [encode(s) for s in new], [likeness(a, b) for a, b in zip(own, new, strict=True)], [likeness(a, b) for a, b in zip(own, nxt, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        rows, size = [], 0
        for block, halo, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "halo", "doc_id", "text")), strict=True):
            if held is not None and held[0] == block:
                if held[1] is None:  # the copy of the next block's first row has been met
                    continue
                rows.append((held[2], held[3], text))
                size += len(text)
                if size >= 1 << 20:
                    yield judged(rows)
                    rows, size = [], 0
            held = (block, None if halo else True, doc, text)
        if rows:
            yield judged(rows)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text is the text with its last third replaced by the first code points of the next document in
    descending ``doc_id`` (nulls last; equal ids by text; after the last comes the first). Texts are dealt once
    into ranges of ids; each range also gets a copy of the row that follows it, so no text is sent twice but these.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    blocks = min(2048, max(1, n // BLOCK))  # a bound on what the driver keeps: two ids of each block
    edges = rows.where("doc_id is not null").stat.approxQuantile("doc_id", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    edges = sorted({int(e) for e in edges})
    # Descending blocks: 0 has the largest ids, the last has the smallest and the null ones.
    block = F.lit(len(edges))
    if edges:
        array = F.array(*[F.lit(e).cast("long") for e in edges])
        block = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(F.aggregate(array, F.lit(0), lambda a, e: a + (F.col("doc_id") < e).cast("int")))
    tops = rows.select("doc_id", block.alias("block")).groupBy("block").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r["block"], r["top"]) for r in tops)
    befores = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}  # the first id of a block -> the block before
    before = F.lit(None).cast("int")
    known = {k: v for k, v in befores.items() if k is not None}
    if known:
        before = F.element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)]), F.col("doc_id"))
    if None in befores:
        before = F.when(F.col("doc_id").isNull(), F.lit(befores[None])).otherwise(before)
    places = F.array(F.struct(block.alias("block"), F.lit(0).alias("halo")), F.struct(before.alias("block"), F.lit(1).alias("halo")))
    dealt = rows.select("doc_id", "text", F.explode(F.filter(places, lambda x: x["block"].isNotNull())).alias("at")).select("at.block", "at.halo", "doc_id", "text")
    dealt = dealt.repartition(max(1, len(tops)), "block").sortWithinPartitions("block", "halo", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_compare, _OUT)
