"""Mixing sources to target weights by pivotal dependent rounding.

Sources, ordered by code point (null last), weigh ``weights`` in turn and share
all words of the corpus; a target stops at ``MOST`` times its source's words
and the excess is shared again by weight. A document of a source with target
``t`` and ``s`` words is to be taken ``c = t / s`` times: always ``floor(c)``
times, and once more with a fractional probability that pivotal rounding
decides. Two open documents exchange mass so that the expected words stay
exactly the same, until one of them is settled; what is left open of each
block goes up a reduction tree of fan-in ``FAN``, so only the last open
document of a source is drawn on its own and a source's words miss their
target by less than one document.

Documents are dealt into blocks by a hash of their key, a block for each
``BLOCK`` documents of their source, so no block grows; a block is streamed
in the order of another hash, with one open document of state. The draws are
functions of the key and the seed: reruns agree.

Defined cases: null or empty texts have size 0 and are taken 0 times (they add
no words); a null source is a source of its own, the last; repeated rows are
documents of their own; an empty table gives an empty result; a null ``doc_id``
is a key like any other. Only ``doc_id``, ``source`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, few, materialise

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, 17
#: Documents of a block, and blocks whose residuals meet in one block of the next level.
BLOCK, FAN = 1000, 64


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    The ranks come from range partitions and their counts, and each round of
    sharing is one aggregate, so the sources are never gathered.
    """
    sizes = materialise(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()).select("source", "source_size", "_p"), "sources")
    # An edge that all copies of a boundary value share keeps partitions in order; one row per source, so ranks are unique.
    counts = sorted((r["_p"], r["n"]) for r in sizes.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not total:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("_p"))
    rank = offset + F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(sizes.select("source", "source_size", weight.alias("weight")), "weights")
    words = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate = None  # words per unit of weight, for the sources that are not full
    full = F.lit(False)
    while True:
        cap = most * F.col("source_size")
        row = ranked.agg(F.sum(F.when(full, cap).otherwise(0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if not row["open"]:
            break
        last, rate = rate, (words - row["used"]) / row["open"]
        if rate == last:
            break
        full = F.col("weight") * F.lit(rate) > cap
    target = F.col("weight") * F.lit(rate or 0.0)
    return ranked.select("source", "source_size", F.least(target, (most * F.col("source_size")).cast("double")).alias("target"))


def _uniform(seed: int, *key: int) -> float:
    x = seed & 0xFFFFFFFFFFFFFFFF
    for k in key:
        x = (x ^ (k & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


_TINY = 1e-9
_OUT = "doc_id long, source string, size long, h long, whole int, p double, block long, more int"


def _settle(last: bool, seed: int):
    """Folds the ordered rows of each (source, block); more is 1 or 0 once settled, null for the one left open."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the open row
        for batch in batches:
            names = batch.schema.names
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = dict(zip(names, row, strict=True))
                if held is not None and (held["source"], held["block"]) != (x["source"], x["block"]):
                    done.append(_close(held, last, seed))
                    held = None
                if not _TINY < x["p"] < 1 - _TINY:
                    done.append({**x, "more": int(x["p"] > 0.5)})
                elif held is None:
                    held = x
                else:
                    a, b = held, x
                    # Move words d from b to a, or e from a to b: the sum of size * p stays; marginals stay in expectation.
                    d = min((1 - a["p"]) * a["size"], b["p"] * b["size"])
                    e = min(a["p"] * a["size"], (1 - b["p"]) * b["size"])
                    step = d if _uniform(seed, a["h"], b["h"], a["size"], b["size"]) * (d + e) < e else -e
                    a = {**a, "p": a["p"] + step / a["size"]}
                    b = {**b, "p": b["p"] - step / b["size"]}
                    held = None
                    for y in (a, b):
                        if _TINY < y["p"] < 1 - _TINY and held is None:
                            held = y
                        else:
                            done.append({**y, "more": int(y["p"] > 0.5)})
            if done:
                yield _batch(done)
        if held is not None:
            yield _batch([_close(held, last, seed)])

    return fold


def _close(x: dict, last: bool, seed: int) -> dict:
    return {**x, "more": int(_uniform(seed + 1, x["h"], x["size"]) < x["p"]) if last else None}


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    fields = [f.split() for f in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[t]) for n, t in fields], [n for n, _ in fields])


def _level(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    keys = ["source", "block"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "h", "doc_id", "size")
    return dealt.mapInArrow(_settle(last, seed), _OUT)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each row of ``docs``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count_if(F.col("size") > 0) / BLOCK).cast("long").alias("blocks")), "counts")
    wanted = targets(sources.select("source", "source_size"), weights, most).select(F.col("source").alias("_s"), "source_size", "target")
    wanted = wanted.join(sources.select("source", "blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    wanted = materialise(wanted, "targets")
    # A source has as many blocks as its size asks for, so that a block has about BLOCK documents.
    blocks = max(1, wanted.agg(F.max("blocks")).first()[0] or 1)
    share = F.col("target") / F.col("source_size")
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed))
    open_rows = rows.where("size > 0").join(few(wanted), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    open_rows = open_rows.select(
        "doc_id", "source", "size", h.alias("h"), F.floor(share).cast("int").alias("whole"), (share - F.floor(share)).alias("p"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed + 1)), F.col("blocks")).alias("block"),
    )
    parts, left, now = [], open_rows, blocks
    while True:
        last = now == 1
        done = materialise(_level(left, last, seed), "settled")
        parts.append(done.where("more is not null"))
        if last:
            break
        now = -(-now // FAN)
        left = done.where("more is null").drop("more").withColumn("block", F.floor(F.col("block") / FAN))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    none = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).alias("copies"))
    out = out.select("doc_id", "source", "size", (F.col("whole") + F.col("more")).alias("copies")).unionByName(none)
    out = out.join(few(wanted), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` as mixed: each row as many times as it is taken, with its own columns.

    Rows are matched by ``doc_id``; rows that share a ``doc_id`` are taken as often as the mix takes them together.
    Where FEW documents or fewer are taken, no text is dealt out for it.
    """
    taken = mix(docs, weights, most, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
    taken = materialise(taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_all", "_rows"), "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_o"), n_words(F.col("text")).alias("_n"))
    rows = rows.join(few(taken), F.col("_d").eqNullSafe(F.col("_id")) & F.col("_o").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_z")))
    copies = F.col("_all")
    if not taken.where("_rows > 1").isEmpty():  # rows that share a key: the rest goes by a hash order within the key
        nth = F.row_number().over(Window.partitionBy("_id", "_s", "_z").orderBy(F.xxhash64("_row")))
        copies = F.floor(F.col("_all") / F.col("_rows")) + (nth <= F.col("_all") % F.col("_rows")).cast("long")
    rows = rows.withColumn("_k", copies.cast("long")).where("_k > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))).select("_row.*")
