"""Sinks for score matrices: CSV, Arrow IPC and Parquet."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisim.errors import InvalidExtension


def _floats(matrix: DataFrame) -> DataFrame:
    """x_1, x_2 and 32-bit numbers."""
    return matrix.select(*[F.col(f"`{c}`") if c in ("x_1", "x_2") else F.col(f"`{c}`").cast("float").alias(c) for c in matrix.columns])


def _shortest(c: Column) -> Column:
    """A number as text without a final .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def export_csv(matrix: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; null labels are empty, whole numbers have no .0."""
    rows = _floats(matrix)
    rows.select(*[F.col(f"`{c}`") if c in ("x_1", "x_2") else _shortest(F.col(f"`{c}`")).alias(c) for c in rows.columns]).write.option("emptyValue", "").csv(path, header=True)


def export_arrow(matrix: DataFrame, path: str) -> None:
    """One Arrow IPC file with one batch, for tables that fit the driver; ``export_parquet`` is the distributed form."""
    table = _floats(matrix).toArrow().combine_chunks()
    table = table.cast(pa.schema([pa.field(f.name, f.type, nullable=f.name not in ("x_1", "x_2") and f.name == "label") for f in table.schema]))
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)


def export_parquet(matrix: DataFrame, path: str) -> None:
    """A folder of Parquet parts."""
    _floats(matrix).write.parquet(path)


def export(matrix: DataFrame, path: str) -> None:
    """By extension: .csv, .arrow or .ipc, .parquet."""
    made = {".csv": export_csv, ".arrow": export_arrow, ".ipc": export_arrow, ".parquet": export_parquet}.get(Path(path).suffix)
    if made is None:
        raise InvalidExtension(f"{path} is neither .csv, .arrow, .ipc nor .parquet")
    made(matrix, path)
