"""Scores over streams of pairs: scorers keep no state, so a stream is scored as a table is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexisim.functions.scorers import Scorer
from lexisim.operators.matrix import score_columns
from lexisim.sources.schema import PAIR_SCHEMA


def read_pairs_stream(spark: SparkSession, folder: str, format: str = "parquet") -> DataFrame:
    """Pairs from files as they arrive in ``folder``."""
    return spark.readStream.schema(PAIR_SCHEMA).format(format).load(folder)


def score_stream(pairs: DataFrame, scorers: Sequence[Scorer], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the scores of a stream of pairs to Parquet files in ``path``."""
    writer = score_columns(pairs, scorers).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
