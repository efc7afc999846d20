"""The schema of pairs, and CSV tables read by the names of their headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisim.errors import InvalidDatasetShape

PAIR_SCHEMA = T.StructType([T.StructField("x_1", T.StringType()), T.StructField("x_2", T.StringType()), T.StructField("label", T.FloatType()), T.StructField("t_1", T.StringType()), T.StructField("t_2", T.StringType())])
#: Other names that headers may use.
ALIASES = {"x": "x_1", "y": "x_2"}


@dataclass
class CSVOptions:
    """How a CSV file is written; flexible accepts rows with too few or too many fields."""

    delimiter: str = ","
    has_headers: bool = True
    flexible: bool = False


def read_csv_as(spark: SparkSession, path: str, schema: T.StructType, options: CSVOptions | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``schema`` by header name (without headers: by place); missing nullable ones are null.

    Required strings (x_1, x_2) are empty where the field is empty; blanks are kept; a wrong field fails the job.
    """
    options = options or CSVOptions()
    mode = "PERMISSIVE" if options.flexible else "FAILFAST"
    reader = spark.read.option("sep", options.delimiter).option("mode", mode).option("header", str(options.has_headers).lower())
    if options.has_headers:
        names = reader.csv(path).columns  # reads the first line only
        told = [(aliases or {}).get(n, n) for n in names]
    else:
        told = [f.name for f in schema]
    raw = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in told])).csv(path)
    out = []
    for f in schema:
        if f.name not in told:
            if f.name in ("x_1", "x_2"):
                raise InvalidDatasetShape(f"{path} has no column {f.name}")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name in ("x_1", "x_2"):
            out.append(F.coalesce(F.col(f.name), F.lit("")).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return raw.select(*out)


def read_pairs(spark: SparkSession, path: str, options: CSVOptions | None = None) -> DataFrame:
    """A CSV file of pairs: x_1 (or x), x_2 (or y), and label, t_1, t_2 where it has them."""
    return read_csv_as(spark, path, PAIR_SCHEMA, options, ALIASES)
