"""Token counts of documents in flat token files, by a separator scan.

A flat file is the documents' token ids (16-bit, little endian) with an
end-of-document id after each and no index. ``scan`` reads byte ranges of files,
finds the separators of a block in one vectorised comparison, and stitches
documents that cross ranges by a prefix scan over the ranges' summaries: the
number of separators before a range numbers its documents, the place of the
last one before it gives the length of the document that is open at its start.
A file of any size is read by as many tasks as it has ranges.
``pack`` writes such files with Spark's own text source, whose line separator
is the end-of-document id, so any file system that Spark knows will do.

Defined cases: a null or empty text is a document of 0 tokens; an empty table
or file has no documents; tokens after the last separator are one more document
whose ``ended`` is false; a file with half a token raises, as does a separator of two equal bytes; repeated rows and
null ids are documents like any other; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, drop_path, materialise, new_path, text_bytes

#: Where the vocabulary is; the end-of-document id, free in it; the split pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that one search sees at least (where a range has them), and documents of a file.
BLOCK, PER_FILE = 1 << 16, 4000


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _encode(ranks: Broadcast, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            ids = [np.asarray(encoder.encode_ordinary(t or ""), "<u2").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["value"])

    return run


def pack(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END) -> None:
    """Writes the texts of ``docs`` as flat token files into the new folder ``path``, in the order of its partitions.

    The vocabulary file is read by the driver and broadcast; it does not grow with the data.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    tokens = docs.select("text").mapInArrow(_encode(ranks, pattern), "value binary")
    separator = end.to_bytes(2, "little").decode("latin-1")
    tokens.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", PER_FILE).text(path)


def _separators(end: int, block: int):
    """The separator's byte pair in byte ranges of files, by vectorised search: a row for each, numbered by parity.

    Rows (file, start, size, value) are the stretches between such pairs, range by range. Where a range lies in its
    file is not known yet, nor whether its ids begin at even or odd places: the places count from its first stretch.
    """
    low, high = end & 255, end >> 8
    names = ["file", "start", "size", "odd", "nth", "before", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, count, last = None, 0, [0, 0], [None, None]
        for batch in batches:
            data, off = text_bytes(batch.column(3))
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < batch.num_rows:
                key = (files[lo], starts[lo])
                if key != held:
                    held, place, count, last = key, 0, [0, 0], [None, None]
                    if batch.column(2)[lo].as_py() % 2:
                        raise ValueError(f"{files[lo]} has half a token")
                hi = lo + 1
                while hi < batch.num_rows and (files[hi], starts[hi]) == key and off[hi] - off[lo] < 2 * block:
                    hi += 1
                n = hi - lo
                raw = np.empty(int(off[hi] - off[lo]) + 2 * n, np.uint8)
                cut = off[lo + 1 : hi + 1] - off[lo] + 2 * np.arange(n)  # where the stretches' own pairs go back
                raw[cut], raw[cut + 1] = low, high
                keep = np.ones(len(raw), bool)
                keep[cut] = keep[cut + 1] = False
                raw[keep] = data[off[lo] : off[hi]]
                at = np.flatnonzero((raw[:-1] == low) & (raw[1:] == high)) + place
                for odd in (0, 1):
                    own = at[at % 2 == odd]
                    if len(own):
                        before = pa.array([last[odd], *own[:-1].tolist()], pa.int64())
                        columns = [pa.array([key[0]] * len(own)), pa.array(np.full(len(own), key[1])), batch.column(2).slice(lo, 1).take(pa.array(np.zeros(len(own), np.int64)))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(own), odd, np.int32)), pa.array(count[odd] + np.arange(len(own))), before, pa.array(own)], names)
                        count[odd], last[odd] = count[odd] + len(own), int(own[-1])
                place, lo = place + len(raw), hi

    return run


def scan(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, place (from 0), n_tokens and ended of every document in the flat files under ``path``.

    Spark's text source serves byte ranges of any file (``spark.sql.files.maxPartitionBytes``), cut where the
    separator's two bytes stand, at whatever place. A prefix scan over the ranges' summaries gives where each lies
    in its file, so which of its pairs are separators (those at even places), how many documents ended before it,
    and where the last one did.
    """
    if end & 255 == end >> 8:
        raise ValueError("the separator's two bytes must differ")
    bound_batches(spark)
    separator = end.to_bytes(2, "little").decode("latin-1")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    found = materialise(lines.mapInArrow(_separators(end, block), "file string, start long, size long, odd int, nth long, before long, at long"), "separators")

    of = lambda name, odd: F.max(F.when(F.col("odd") == odd, F.col(name)))
    ranges = found.groupBy("file", "start", "size").agg(
        (F.max("at") + 2).alias("n"), *[x.alias(f"{name}{odd}") for odd in (0, 1) for name, x in (("docs", F.coalesce(of("nth", odd) + 1, F.lit(0))), ("last", of("at", odd)))]
    )
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A byte order mark is not served: a file that begins with its three bytes comes out short by them.
    missing = F.when(F.sum("n").over(Window.partitionBy("file")) < F.col("size"), 3).otherwise(0)
    ranges = ranges.withColumn("begin", missing + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    own = lambda name: F.when(F.col("begin") % 2 == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    ranges = ranges.select("file", "start", "begin", own("docs").alias("docs"), (F.col("begin") + own("last")).alias("last"))
    ranges = ranges.select("file", "start", "begin", (F.col("begin") % 2).cast("int").alias("odd"), F.coalesce(F.sum("docs").over(upto), F.lit(0)).alias("docs"), F.coalesce(F.max("last").over(upto), F.lit(-2)).alias("last"))
    docs = found.join(ranges, ["file", "start", "odd"])
    # What the source takes for a stretch's end at a file's end is none there: the document is open.
    at, before = F.col("begin") + F.col("at"), F.coalesce(F.col("begin") + F.col("before"), F.col("last"))
    docs = docs.select("file", (F.col("docs") + F.col("nth")).cast("long").alias("place"), ((at - before - 2) / 2).cast("long").alias("n_tokens"), (at + 2 <= F.col("size")).alias("ended"))
    return docs.where("ended or n_tokens > 0")


def count(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END) -> DataFrame:
    """doc_id, n_tokens, part and place of each row of ``docs``, packed into flat files and counted there.

    A flat file has no ids: they are matched by the order of rows in each partition, which ``docs`` must give again
    (a table that is read and filtered does; else write it first). A row without its count fails the query.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    pack(docs, path, vocabulary, pattern, end)
    place = F.monotonically_increasing_id()
    listed = docs.select("doc_id", F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    listed = listed.select(F.lit(True).alias("_listed"), F.col("doc_id").cast("long").alias("doc_id"), "part", "place")
    number = lambda form: F.regexp_extract("file", form, 1).cast("long")
    found = scan(spark, path, end).select(number(r"part-(\d+)-[^/]*$").cast("int").alias("part"), (number(r"-c(\d+)(?:\.[^/]*)?$") * PER_FILE + F.col("place")).alias("place"), "n_tokens")
    drop_path(spark, path)  # what was found there is a table now
    both = listed.join(found, ["part", "place"], "full")
    lost = F.raise_error(F.lit("documents and flat files do not have the same rows")).cast("long")
    return both.select("doc_id", F.when(F.col("_listed").isNull() | F.col("n_tokens").isNull(), lost).otherwise(F.col("n_tokens")).alias("n_tokens"), "part", "place")
