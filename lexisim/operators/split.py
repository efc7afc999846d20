"""Train and test splits by a hashed order, stratified and balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisim.errors import InvalidDatasetShape


def stratum(label: Column) -> Column:
    """positive (0.5 or more), negative (any other label, NaN too) or unlabeled."""
    return F.when(label.isNull(), F.lit("unlabeled")).when(~F.isnan(label) & (label >= 0.5), F.lit("positive")).otherwise(F.lit("negative"))


def _train_size(n: Column, fraction: float) -> Column:
    return F.greatest(F.least(F.greatest(F.round(n * F.lit(fraction)), F.lit(1)), n - 1), F.lit(0))


#: Ranges of the hashed order that are ranked on their own.
RANGES = 1024


def _ranked(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the rank of each row within ``keys`` by ``order`` (a 64-bit hash), from the counts of its ranges.

    A key with most of the rows, or none at all, is ranked range by range, never in one task.
    """
    part = F.shiftrightunsigned(F.col(order), 54).cast("int")
    df = df.withColumn("_range", part)
    counts = df.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # RANGES rows a key
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.shiftleft(F.col(order), 10), order))
    return df.join(F.broadcast(counts), [*keys, "_range"]).withColumn(name, F.col("_before") + own).drop("_range", "_before")


def split_rows(df: DataFrame, train_fraction: float, seed: int = 0, stratify: bool = True, balance: bool = False, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test). Sizes are exact: round(n * fraction), 1 at least and n - 1 at most, a stratum of one row to test.

    ``row_id`` tells rows apart; the same seed gives the same split. ``balance`` drops rows of train's larger class.
    """
    if not 0 < train_fraction < 1:
        raise InvalidDatasetShape("train_fraction must be over 0 and under 1")
    columns = df.columns
    rows = df.withColumn("_stratum", stratum(F.col("label"))).withColumn("_order", F.xxhash64(F.lit(seed), F.col(row_id)))
    rows = rows.withColumn("_key", F.col("_stratum") if stratify else F.lit("all"))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))  # three rows at most
    rows = _ranked(rows, ["_key"], "_order", "_rank").join(F.broadcast(sizes), "_key")
    rows = rows.withColumn("_train", F.col("_rank") <= _train_size(F.col("_size"), train_fraction))
    train, test = rows.where("_train"), rows.where("not _train").select(*columns)
    if balance:
        train = balanced(train)
    return train.select(*columns), test


def balanced(train: DataFrame) -> DataFrame:
    """As many positive as negative rows, the larger class cut by its hashed order; rows without label (or NaN) as they are."""
    proper = F.col("label").isNotNull() & ~F.isnan("label")
    least = train.where(proper).agg(F.least(F.count(F.when(F.col("label") >= 0.5, 1)), F.count(F.when(F.col("label") < 0.5, 1))).alias("n")).first()["n"]
    ranked = _ranked(train.where(proper).drop("_rank"), ["_stratum"], "_order", "_rank").where(F.col("_rank") <= least)
    return ranked.unionByName(train.where(F.col("label").isNull()))
